"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field labels blank-separated words as outside, begin or inside of a kind. It is trained by
gradient ascent on a small labelled table and decoded by Viterbi for many segments at once in numpy. Words without a digit
or ``@`` cannot be part of any kind, so they are held at "outside"; by the Markov property that cuts a text into independent
segments of other words, and decoding them alone is exact. A decoded span is added if it holds what its kind
needs (``_plausible``) and overlaps no base span.

Defined cases: a null text counts as empty; texts without findings have no spans. Offsets are code points of the whole text, end
exclusive. All searches and the decoding are linear in a text's length. An empty labelled table adds no spans. Repeated rows give equal rows; an empty table gives an empty result. Only the id
and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import wordspans

KINDS = ("email", "ip", "card", "phone")
#: Every search is linear in the text: runs are possessive, a match starts at the beginning of its run, and an email is found
#: from its sign (``_emails``).
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL_PART = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LEAST_DIGITS = {"email": 0, "ip": 4, "card": 16, "phone": 8}
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
DECODE_WORDS = 1 << 15  # words of one padded Viterbi batch
LONG_SEGMENT = 1 << 12  # a longer segment is decoded by itself, its features block by block
LABELLED_ROWS = 20_000  # the most rows of a labelled table that training accepts
#: Own invention: sentences with marked spans. Shapes count, not words, so few sentences per layout are enough.
LABELLED = """
write to [email:anna.berg@mail.example.com] today
his address is [email:tom_99@example.org], he said
contact [email:info@shop.example.net].
mail [email:r.diaz+news@dept.example.co.uk] or call [phone:+44 20 7946 0018] now
from [email:x@example.com] to [email:y7@example.com]
mail [email:no-reply@localhost] for help
she answered from ([email:k.l@example.org])
log in at [ip:10.0.0.12] first
server [ip:192.168.10.254] is down, use [ip:172.16.4.9]
at [ip:203.0.113.7], port 8080
host [ip:8.8.4.4]
pay with [card:4111 1111 1111 1111] please
card [card:5500-0000-0000-0004] was refused
number [card:4012888888881881] ends soon
his card [card:3782 822463 10005] is lost
call [phone:+1 (212) 555-0147] at noon
call [phone:(212) 555-0147] at noon
phone [phone:+49 30 901820] or [phone:030 901820 44]
ring [phone:555-0147-223] later
dial [phone:212-555-0147] now
dial [phone:212.555.0147] now
my number is [phone:+33 1 70 18 99 00], thanks
reach me on [phone:(415) 555 0132].
fax [phone:+81-3-5555-0123] or mail [email:fax@example.jp]
in 2019 we sold 1,250 units at 3.50 each
version 2.4.1 came out in 2021
version 10.15.7 and 3.11 are old
see section 4.2.1 on page 118
the ratio was 16:9 and 4:3
on 2024-01-31 at 12:30:05 it ended
between 1914 and 1918 there were 4 years
room 101, floor 3, building 7
order 20394 shipped in 5 days
token a8f3c99e1b7d42ff was revoked
id 000123 has 7 items and 12 parts
chapter 12 verse 7
prices rose 3% to 12.50 in 1999
mp3 and h264 files of 700 mb
covid19 in 2020 and 2021
follow @handle on the site
the score was 3-2 after 90 minutes
1. first 2. second 3. third
a 100 200 300 400 table
x1 x2 x3 and y1 y2 y3
route 66 and highway 101
pi is 3.14159265 or so
sum 1000000 and 25000000 in total
isbn 978-3-16-148410-0 is a book
key 0x7ffde4b1 at line 4321
"""
_MARK = re.compile(r"\[(\w+):([^\]]+)\]")
_RUN = re.compile(r"(.)\1{3,}")
_SAME = re.compile(r"(.)\1+")
_CLASSES = str.maketrans({**{c: "X" for c in map(chr, range(65, 91))}, **{c: "x" for c in map(chr, range(97, 123))},
                          **{c: "d" for c in "0123456789"}})
DIGIT_OR_AT = wordspans.byte_set([*range(48, 58), 64])
DIGIT = wordspans.byte_set(range(48, 58))
SPACE = wordspans.byte_set(wordspans.SPACE_BYTES)


def labelled_table(spark: SparkSession, marked: str = LABELLED) -> DataFrame:
    """(sentence, words, tags) from lines with ``[kind:text]`` marks."""
    rows = []
    for n, line in enumerate(filter(None, marked.splitlines())):
        words, tags, at = [], [], 0
        for m in [*_MARK.finditer(line), None]:
            plain = line[at : m.start() if m else len(line)].split()
            glued = bool(words) and at > 0 and not line[at : at + 1].isspace() and bool(plain)
            if glued:  # punctuation right behind a span belongs to its last word
                words[-1] += plain.pop(0)
            words += plain
            tags += ["O"] * len(plain)
            if m:
                inner = m[2].split()
                if m.start() and not line[m.start() - 1].isspace() and tags and tags[-1] == "O" and words:
                    inner[0] = words.pop() + inner[0]
                    tags.pop()
                words += inner
                tags += [f"{'B' if i == 0 else 'I'}-{m[1]}" for i in range(len(inner))]
                at = m.end()
        rows.append((n, words, tags))
    return spark.createDataFrame(rows, "sentence int, words array<string>, tags array<string>")


def core(word: str) -> tuple[int, int]:
    """The part of a word without surrounding marks; an opening bracket, a plus and a matching closing bracket stay."""
    a, b = 0, len(word)
    while a < b and not (word[a].isalnum() or word[a] in "+("):
        a += 1
    opened = word.find("(", a)
    while b > a and not (word[b - 1].isalnum() or (word[b - 1] == ")" and 0 <= opened < b)):
        b -= 1
    if word[a : a + 1] == "(" and ")" not in word[a:b] and not word[a + 1 : a + 2].isdigit():
        a += 1
    return a, b


def shape(word: str) -> str:
    a, b = core(word)
    text = word[a:b].translate(_CLASSES)
    if not text.isascii():
        text = "".join(c if c.isascii() else "x" for c in text)
    return _RUN.sub(lambda m: m[1] * 4, text)


def features(words: Sequence[str], before: str | None = None, after: str | None = None) -> list[list[str]]:
    """The features of each word of a segment: its shape, coarse shape, digits, and the shapes beside it. ``before`` and ``after``
    are the words beside a part of a segment."""
    shapes = ["-" if before is None else shape(before), *map(shape, words), "-" if after is None else shape(after)]
    out = []
    for i, word in enumerate(words, 1):
        s, n = shapes[i], sum(c.isdigit() for c in word)
        coarse = _SAME.sub(r"\1", s)
        out.append([f"s={s}", f"c={coarse}", f"n={n if n < 4 else 4 + (n - 4) // 3}", f"p={_SAME.sub(r'\1', shapes[i - 1])}",
                    f"f={_SAME.sub(r'\1', shapes[i + 1])}", f"pc={_SAME.sub(r'\1', shapes[i - 1])}/{coarse}", f"at={'@' in s}"])
    return out


class Field:
    """A linear-chain conditional random field: weights per feature and tag, and between neighbouring tags."""

    def __init__(self, names: dict[str, int], emission: np.ndarray, transition: np.ndarray):
        self.names, self.emission, self.transition = names, emission, transition

    def scores(self, segments: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Tag scores, padded to the longest segment, and the lengths."""
        sizes = np.array([len(s) for s in segments])
        out = np.zeros((len(segments), max(sizes, default=0), len(TAGS)))
        for k, segment in enumerate(segments):
            for t, found in enumerate(segment):
                out[k, t] = self.emission[[self.names.get(f, 0) for f in found]].sum(axis=0)
        return out, sizes

    def decode(self, segments: list[list[list[str]]]) -> list[np.ndarray]:
        """The best tags of each segment; the words around a segment are outside."""
        scores, sizes = self.scores(segments)
        n, longest, _ = scores.shape
        best = self.transition[0][None, :] + scores[:, 0]
        back = np.zeros((longest, n, len(TAGS)), dtype=np.int8)
        for t in range(1, longest):
            step = best[:, :, None] + self.transition[None]
            back[t] = step.argmax(axis=1)
            live = (t < sizes)[:, None]
            best = np.where(live, step.max(axis=1) + scores[:, t], best)
        tag = (best + self.transition[:, 0][None, :]).argmax(axis=1)
        tags = np.zeros((n, longest), dtype=np.int8)
        rows = np.arange(n)
        for t in range(longest - 1, -1, -1):
            tags[:, t] = tag
            tag = np.where((t > 0) & (t < sizes), back[t, rows, tag], tag)
        return [tags[k, :size] for k, size in enumerate(sizes)]


    def decode_long(self, words: Sequence[str]) -> np.ndarray:
        """``decode`` of one segment of any length: the forward pass streams over blocks, and a byte per word and tag is kept."""
        n, size = len(words), len(TAGS)
        back = np.zeros((n, size), dtype=np.int8)
        best, across = None, np.arange(size)
        for at in range(0, n, LONG_SEGMENT):
            block = words[at : at + LONG_SEGMENT]
            scores, _ = self.scores([features(block, words[at - 1] if at else None, words[at + len(block)] if at + len(block) < n else None)])
            for t, score in enumerate(scores[0], at):
                if best is None:
                    best = self.transition[0] + score
                    continue
                step = best[:, None] + self.transition
                back[t] = step.argmax(axis=0)
                best = step[back[t], across] + score
        tags = np.zeros(n, dtype=np.int8)
        tag = int((best + self.transition[:, 0]).argmax())
        for t in range(n - 1, -1, -1):
            tags[t] = tag
            tag = back[t, tag]
        return tags


def _allowed() -> np.ndarray:
    """Penalty of forbidden neighbours: an inside tag follows its own begin or inside."""
    out = np.zeros((len(TAGS), len(TAGS)))
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            out[[i for i, before in enumerate(TAGS) if before[2:] != tag[2:]], j] = -1e4
    return out


def train(labelled: DataFrame, rounds: int = 150, rate: float = 0.2, ridge: float = 0.02) -> Field:
    """Maximises the penalised log-likelihood of the labelled sentences with batched forward-backward passes (Adam steps)."""
    rows = labelled.select("words", "tags").limit(LABELLED_ROWS + 1).collect()
    if len(rows) > LABELLED_ROWS:
        raise ValueError(f"the labelled table has more than {LABELLED_ROWS} rows")
    rows = sorted((tuple(r["words"]), tuple(r["tags"])) for r in rows if r["words"] and r["tags"])
    names: dict[str, int] = {"": 0}
    found = [features(words) for words, _ in rows]
    for segment in found:
        for word in segment:
            for f in word:
                names.setdefault(f, len(names))
    size, longest, width = len(TAGS), max(map(len, found), default=1), 7
    index = np.zeros((len(rows), longest, width), dtype=np.int64)
    gold = np.zeros((len(rows), longest), dtype=np.int64)
    live = np.zeros((len(rows), longest), dtype=bool)
    for k, (segment, (_, tags)) in enumerate(zip(found, rows, strict=True)):
        for t, word in enumerate(segment):
            index[k, t] = [names[f] for f in word]
            gold[k, t] = TAGS.index(tags[t])
            live[k, t] = True
    fixed = _allowed()
    field = Field(names, np.zeros((len(names), size)), np.zeros((size, size)))
    if not rows:
        field.transition = fixed
        return field
    ends = live.sum(axis=1) - 1
    pick = np.arange(len(rows))
    moments = [np.zeros_like(field.emission), np.zeros_like(field.emission), np.zeros((size, size)), np.zeros((size, size))]
    weights = [field.emission, field.transition]

    def soft(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for round_ in range(1, rounds + 1):
        scores = weights[0][index].sum(axis=2)
        trans = weights[1] + fixed
        ahead = np.zeros((longest, len(rows), size))
        ahead[0] = trans[0] + scores[:, 0]
        for t in range(1, longest):
            step = soft(ahead[t - 1][:, :, None] + trans[None], 1) + scores[:, t]
            ahead[t] = np.where(live[:, t, None], step, ahead[t - 1])
        total = soft(ahead[ends, pick] + trans[:, 0], 1)
        behind = np.zeros((longest, len(rows), size))
        behind[longest - 1] = trans[:, 0]
        pairs = np.zeros((size, size))
        for t in range(longest - 2, -1, -1):
            onward = scores[:, t + 1] + behind[t + 1]
            step = soft(trans[None] + onward[:, None, :], 2)
            on = live[:, t + 1]
            behind[t] = np.where(on[:, None], step, trans[:, 0])
            joint = np.exp(ahead[t][:, :, None] + trans[None] + onward[:, None, :] - total[:, None, None])
            pairs += joint[on].sum(axis=0)
        marginal = np.exp(ahead.transpose(1, 0, 2) + behind.transpose(1, 0, 2) - total[:, None, None]) * live[:, :, None]
        pairs[0] += marginal[:, 0].sum(axis=0)
        pairs[:, 0] += marginal[pick, ends].sum(axis=0)
        difference = -marginal
        difference[pick[:, None], np.arange(longest)[None, :], gold] += live
        grad_e = np.zeros_like(weights[0])
        np.add.at(grad_e, index.reshape(-1, width), difference.reshape(-1, 1, size))
        grad_t = -pairs
        chain = [(0, gold[:, 0], live[:, 0])] + [(gold[:, t - 1], gold[:, t], live[:, t]) for t in range(1, longest)]
        for a, b, on in chain:
            np.add.at(grad_t, (np.broadcast_to(a, b.shape)[on], b[on]), 1.0)
        np.add.at(grad_t, (gold[pick, ends], np.zeros(len(rows), dtype=np.int64)), 1.0)
        for k, grad in enumerate((grad_e, grad_t)):
            grad = grad - ridge * weights[k]
            first, second = moments[2 * k], moments[2 * k + 1]
            first *= 0.9
            first += 0.1 * grad
            second *= 0.999
            second += 0.001 * grad * grad
            weights[k] += rate * (first / (1 - 0.9**round_)) / (np.sqrt(second / (1 - 0.999**round_)) + 1e-8)
    weights[0][0] = 0.0
    return Field(names, weights[0], weights[1] + fixed)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _holds(kind: str, text: str) -> bool:
    """The condition on a match of a pattern."""
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in text.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        digits = _digits(text)
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return kind != "phone" or 8 <= len(_digits(text)) <= 15


def _plausible(kind: str, text: str) -> bool:
    """What a decoded span must hold to be added."""
    n = len(_digits(text))
    if kind == "email":
        return "@" in text.strip("@")
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isdigit() and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= n <= 19 and n == sum(c.isalnum() for c in text) and _luhn(_digits(text))
    return 7 <= n <= 15 and n == sum(c.isalnum() for c in text) and any(c in text for c in " -.()")


def _emails(text: str) -> list[tuple[int, int]]:
    """(start, end) of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, leftmost and not overlapping: from each sign the
    local part is the whole run before it, which holds no sign, so every sign looks at a run of its own."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        window, start = 64, at
        while start > done:
            low = max(done, at - window)
            start = low + len(text[low:at].rstrip(LOCAL_PART))
            if start > low:
                break
            window *= 4
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str, n_digits: int) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns."""
    out = []
    for k, kind in enumerate(KINDS):
        if n_digits >= LEAST_DIGITS[kind] and NEEDED[kind] in text:
            if kind == "email":
                out += [(k, a, b) for a, b in _emails(text)]
            else:
                out += [(k, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if _holds(kind, m[0])]
    return out


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words with a digit or ``@``: start, end, row, and whether the word before in the text is one too."""
    starts, ends, row = wordspans.word_bounds(data, offsets, SPACE)
    marks = np.concatenate([[0], np.cumsum(DIGIT_OR_AT[data])])
    flagged = np.flatnonzero(marks[ends] > marks[starts])
    joined = np.zeros(len(flagged), dtype=bool)
    joined[1:] = (np.diff(flagged) == 1) & (np.diff(row[flagged]) == 0)
    return starts[flagged], ends[flagged], row[flagged], joined


def spans_of(column: pa.Array, model: Field) -> list[list[tuple[int, int, int, bool]]]:
    """(kind number, start, end, base) of each text, sorted."""
    spans: list[list[tuple]] = [[] for _ in range(len(column))]
    for first, _, data, offsets in wordspans.slices(column):
        starts, ends, row, joined = _segments(data, offsets)
        if not len(starts):
            continue
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
        for r in np.unique(row).tolist():
            text = data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")
            n = int(digits[offsets[r + 1]] - digits[offsets[r]])
            spans[first + r] = [(k, a, b, True) for k, a, b in base_spans(text, n)]
        words = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts, ends, strict=True)]
        heads = np.flatnonzero(~joined).tolist()
        bounds = list(zip(heads, [*heads[1:], len(words)], strict=True))
        taken = {}

        def add(a: int, b: int, tags: np.ndarray) -> None:
            if tags.any():
                r = int(row[a])
                if r not in taken:
                    taken[r] = _merged(spans[first + r])
                places = chars[starts[a:b]] - chars[offsets[r]]
                spans[first + r] += _decoded(taken[r], words[a:b], places, tags)

        for a, b in bounds:
            if b - a > LONG_SEGMENT:
                add(a, b, model.decode_long(words[a:b]))
        bounds = [(a, b) for a, b in bounds if b - a <= LONG_SEGMENT]
        by_size: dict[int, list[tuple[int, int]]] = {}
        for a, b in bounds:
            by_size.setdefault((b - a).bit_length(), []).append((a, b))
        for size, group in sorted(by_size.items()):  # segments of about one length together
            step = max(1, DECODE_WORDS >> size)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                for (a, b), tags in zip(part, model.decode([features(words[a:b]) for a, b in part]), strict=True):
                    add(a, b, tags)
    return [sorted((k, int(a), int(b), base) for k, a, b, base in found) for found in spans]


def find(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, base), ordered by kind as in ``KINDS``, then start."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in spans]
                     for spans in spans_of(batch.column(1), model)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def redact(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets; of overlapping spans the first counts."""

    def clean(text: str, spans) -> str:
        out, at = [], 0
        for k, a, b, _ in sorted(spans, key=lambda s: s[1:3]):
            if a >= at:
                out += [text[at:a], f"[{KINDS[k]}]"]
                at = b
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [clean(t.as_py(), s) if s else t.as_py()
                     for t, s in zip(batch.column(1), spans_of(batch.column(1), model), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def _merged(spans: list[tuple]) -> tuple[list[int], list[int]]:
    """Starts and ends of the text that the spans cover, in order and apart from each other."""
    starts, ends = [], []
    for _, a, b, _ in sorted(spans, key=lambda s: s[1:3]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _decoded(taken: tuple[list[int], list[int]], words: list[str], places: np.ndarray, tags: np.ndarray) -> list[tuple]:
    """The decoded spans of one segment that are plausible and overlap no base span; they are of different words, so not each other."""
    out, i = [], 0
    starts, ends = taken
    for i in np.flatnonzero(tags).tolist():
        if i and tags[i - 1] and TAGS[tags[i]][0] == "I":
            continue  # inside tags follow their own begin
        j = i + 1
        while j < len(words) and TAGS[tags[j]] == f"I-{TAGS[tags[i]][2:]}":
            j += 1
        start, end = int(places[i]) + core(words[i])[0], int(places[j - 1]) + core(words[j - 1])[1]
        parts = [w[core(w)[0] if n == 0 else 0 : core(w)[1] if n == j - i - 1 else len(w)] for n, w in enumerate(words[i:j])]
        kind = TAGS[tags[i]][2:]
        before = bisect_left(starts, end) - 1  # the last piece that begins before the end
        if end > start and _plausible(kind, " ".join(parts)) and (before < 0 or ends[before] <= start):
            out.append((KINDS.index(kind), start, end, False))
    return out


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", text), ",").alias("spans"))
