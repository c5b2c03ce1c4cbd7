"""Language identification by compression.

Each language has a raw-content zstandard dictionary, made of slices of labelled texts. A text is cut into blocks, every block
is compressed with each dictionary, and the language with the fewest bytes in all is chosen; blocks keep a long text's own
repetitions from hiding the dictionaries. ``score`` is the share of the best language when the bytes saved are read as
evidence per block; ``narrow`` marks margins too small to trust, which a caller rejects.

What the dictionaries are made of is bounded: ``SAMPLE_DOCS`` labelled texts per language, chosen by a hash, and
``DICTIONARY_BYTES`` per language. Prediction covers every block of every text and sees nothing but the text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Without any labelled text everything is ``und``. Languages
with equal bytes: the longer dictionary, then the first by name. Repeated rows give equal rows; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import local_table

SAMPLE_DOCS = 400
DICTIONARY_BYTES = 64 * 1024
ALL_DICTIONARIES = 64 * 1024 * 1024  # bytes of all dictionaries together; beyond 1,000 languages each gets an equal share
LEAST_BYTES = 8  # the least content a compressor takes; a shorter one is repeated up to it
BLOCK = 2_000
LEVEL = 5
NARROW = 0.01
FLOOR, HANDICAP = 4 * 1024, 0.01  # a dictionary below FLOOR bytes is short; the least share of bytes it has to be ahead
LEAD = 0.35  # and the share of the lead of the best of the others
CUTS = 1_000  # cut dictionaries a task holds
UNKNOWN = "und"
#: Everything in ASCII that is no letter becomes a blank, so that layout, digits and marks say nothing about the language.
PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
LETTER = re.compile(r"[^\W\d_]")


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(PLAIN).split())


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS,
          dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries by language from the labelled rows of ``docs``.

    The ``sample_docs`` texts with the smallest hashes are each language's sample: the bound below which they lie follows from
    the number of its different texts, however many copies they have, and is doubled for a language with too few texts below it.
    At most ``dictionary_bytes`` of a language's text are kept, cut into equal parts.
    """
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    labelled = labelled.withColumn("hash", F.xxhash64("text"))
    sizes = labelled.select("lang", "hash").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one per language
    if not sizes:
        return {}
    dictionary_bytes = max(LEAST_BYTES, min(dictionary_bytes, ALL_DICTIONARIES // len(sizes)))
    place = F.pmod(F.col("hash"), F.lit(1_000_000)) / 1_000_000.0
    part = max(256, dictionary_bytes // sample_docs * 2)
    middle = F.greatest(F.lit(1), (F.char_length("text") / 2 - part / 2).cast("int"))
    bounds = {r["lang"]: (sample_docs + 6 * math.sqrt(sample_docs)) / r["n"] for r in sizes}  # rarely too few, never many more
    texts: dict[str, list] = {}
    while bounds:
        bound = local_table(docs.sparkSession, sorted(bounds.items()), "lang string, bound double")
        chosen = labelled.join(bound, "lang").filter(place < F.col("bound")).groupBy("lang", "hash").agg(
            F.min(F.struct(place.alias("place"), F.substring("text", middle, F.lit(part)).alias("text"))).alias("x"))
        found: dict[str, list] = {k: [] for k in bounds}
        for r in chosen.select("lang", "hash", "x.place", "x.text").collect():
            found[r["lang"]].append((r["place"], r["text"], r["hash"]))
        wanted = {r["lang"]: min(sample_docs, r["n"]) for r in sizes}
        for k, rows in found.items():
            if len(rows) >= wanted[k] or bounds[k] > 1:
                texts[k] = [folded(t) for _, t, _ in sorted(rows)[:sample_docs]]
        bounds = {k: 2 * v for k, v in bounds.items() if k not in texts}
    return dictionaries_of({k: list(dict.fromkeys(v)) for k, v in texts.items()}, dictionary_bytes)


def _without_copies(texts: dict[str, list[bytes]]) -> dict[str, list[bytes]]:
    """One slice of each group of near copies (chained by shared runs of three words), under the group's most frequent label."""
    rows = [(k, text) for k in sorted(texts) for text in texts[k]]
    group, seen = list(range(len(rows))), {}

    def root(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, (_, text) in enumerate(rows):
        words = text.split()
        shared: dict[int, int] = {}
        runs = {b" ".join(words[j : j + 3]) for j in range(len(words) - 2)}
        for run in runs:
            if run in seen:
                shared[root(seen[run])] = shared.get(root(seen[run]), 0) + 1
        for r, n in shared.items():
            if 4 * n >= len(runs):
                group[root(i)] = root(r)
        for run in runs:
            seen.setdefault(run, i)
    labels: dict[int, list[str]] = {}
    for i, (k, _) in enumerate(rows):
        labels.setdefault(root(i), []).append(k)
    out: dict[str, list[bytes]] = {k: [] for k in texts}
    done = set()
    for i, (k, text) in enumerate(rows):
        names = labels[root(i)]
        if root(i) not in done and k == max(sorted(set(names)), key=names.count):
            done.add(root(i))
            out[k].append(text)
    return out


def dictionaries_of(texts: dict[str, list[bytes]], dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries from slices by language, without copies and without wrongly labelled slices: those that the dictionaries
    of the other half of the slices clearly give to another language. A copy under a wrong label would outweigh everything else.
    A language that nothing would be left of keeps all its slices, so every language with a letter in its sample is learned."""
    given, texts = texts, _without_copies(texts)

    def joined(parts):
        out = {k: b" ".join(filter(None, v))[:dictionary_bytes] for k, v in parts.items()}
        return {k: v if len(v) >= LEAST_BYTES else ((v + b" ") * LEAST_BYTES)[:LEAST_BYTES] for k, v in out.items() if v}

    halves = [{k: v[i::2] for k, v in texts.items()} for i in (0, 1)]
    clean: dict[str, list[bytes]] = {k: [] for k in texts}
    for own, other in (halves, halves[::-1]):
        known = joined(other)
        judge = Compressors(known) if known else None
        for k, slices in own.items():
            for text in slices:
                best, _, narrow = judge.predict_folded(text) if judge and text else (k, 0.0, True)
                if best == k or narrow or k not in known:
                    clean[k].append(text)
    return joined(given) | joined(clean)


class Compressors:
    """Languages with the longest dictionaries are compared at that length. Every shorter one is used whole too: the best of its
    length is compared with the best so far, cut to that length. At few bytes that comparison is weak, so a short language must be
    ahead by a share of what the best of the others leads its runner-up by: a text that is clearly of one of them is not in question."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.names, self.level = sorted(dictionaries), level
        self.dictionaries = [dictionaries[name] for name in self.names]
        self.lengths = [max(8, len(d)) for d in self.dictionaries]
        self.short = [n < FLOOR and 4 * n < max(self.lengths) for n in self.lengths]
        self.tiers = [[k for k, n in enumerate(self.lengths) if n == size] for size in sorted(set(self.lengths), reverse=True)]
        self.whole = [self._tool(d) for d in self.dictionaries]
        self.cuts = {}

    def _tool(self, dictionary: bytes):
        import zstandard

        content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=self.level)
        return zstandard.ZstdCompressor(dict_data=content, level=self.level, write_content_size=False,
                                        write_checksum=False, write_dict_id=False).compress

    def _bytes(self, text: bytes, k: int, length: int) -> int:
        """Bytes of the whole text under the first ``length`` bytes of a dictionary, block by block."""
        if length >= self.lengths[k]:
            compress = self.whole[k]
        else:
            if len(self.cuts) >= CUTS and (k, length) not in self.cuts:
                self.cuts.clear()
            compress = self.cuts.get((k, length)) or self.cuts.setdefault((k, length), self._tool(self.dictionaries[k][:length]))
        return sum(len(compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, narrow margin)."""
        if text is None or not has_letter(text):
            return UNKNOWN, 0.0, True
        return self.predict_folded(folded(text))

    def predict_folded(self, plain: bytes) -> tuple[str, float, bool]:
        known: dict[tuple[int, int], int] = {}

        def size(k, length):
            if (k, length) not in known:
                known[k, length] = self._bytes(plain, k, length)
            return known[k, length]

        def behind(k, other):
            """Bytes by which k is worse than the other at their common length."""
            length = min(self.lengths[k], self.lengths[other])
            return size(k, length) - size(other, length)

        best, lead = None, 0
        for tier in self.tiers:
            first = min(tier, key=lambda k: size(k, self.lengths[k]))
            if self.short[first] and not lead:
                rivals = [behind(k, best) for k in range(len(self.names)) if k != best and not self.short[k]]
                lead = max(HANDICAP * size(best, self.lengths[best]), LEAD * min(rivals, default=0))
            if best is None or behind(first, best) + lead < 0:
                best = first
        blocks = max(1, -(-len(plain) // BLOCK))
        worse = [behind(k, best) + (lead if self.short[k] and not self.short[best] else 0) for k in range(len(self.names)) if k != best]
        score = 1.0 / (1.0 + sum(math.exp(min(0.0, -w / blocks)) for w in worse))
        margin = min(worse) / max(1, size(best, self.lengths[best])) if worse else 1.0
        return self.names[best], score, margin < NARROW


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, narrow for every row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Compressors(dictionaries) if dictionaries else None
        for batch in batches:
            found = [tools.predict(t.as_py()) if tools else (UNKNOWN, 0.0, True) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                 pa.array([x[2] for x in found], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "narrow"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, narrow boolean")


def fold_of(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """Learns from three folds of four and predicts every row: doc_id, held_out, lang_pred, score, narrow."""
    held_out = F.coalesce(fold_of() == 2, F.lit(False))
    found = identify(docs, learn(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "narrow")
