"""SentencePiece (byte-pair kind) encoding and decoding from a table of prefixes.

Merging pieces by score leaves, for every prefix of a text, exactly one last token, and a sequence of tokens is what merging gives
if and only if each two neighbours are what merging gives for their own concatenation. So an Aho-Corasick automaton lists the
pieces that end at each place; of these the one that is compatible with the last token of the prefix before it is
stored; walking back from the end recovers the ids. Compatibility is settled once per pair by merging its letters and kept.
The vocabulary comes from the sentencepiece library; merging, lookup and decoding don't call it.

Texts are cut where no piece of the vocabulary lies across: before a space that follows another sign (checked when the model
is loaded; otherwise a text is one chunk), and between ASCII signs that are neighbours in no piece. Each different chunk is
encoded once per task while it fits the cache.

The rules that a model is checked for: byte-pair kind (scores fall with rank), no normaliser beyond spaces, a space put in front, byte
fallback. Others raise ValueError.

Defined cases: null and empty texts have no ids and decode to an empty text; rows that repeat are encoded each; a text of one long word
takes memory in proportion to it; an empty table gives an empty result. Control strings in a text are plain text. The sign that
stands for a space inside pieces decodes to a space, as in the library. Only the id and text columns are read, so other columns may
have any name.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import wordspans

SPACE = "\u2581"
PROBES = ("", " ", "a", " a  b ", "\u00a0\ufb01\u2460\u00e9e\u0301\t\n\u3000\u200b\uff21", "\U0010fffd")
CACHED_CHUNKS = 400_000
CACHED_PAIRS = 4_000_000
ROWS_AT_ONCE = 500
SPACE_BYTES = wordspans.byte_set((0x20,))
_LOADED: dict[str, "PieceTable"] = {}


class PieceTable:
    """The vocabulary as an automaton, the pairs known to be compatible, and the chunks encoded so far."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(n)]
        self.piece = [model.id_to_piece(i) for i in range(n)]
        self.id_of = {self.piece[i]: i for i in range(n) if not special[i]}
        self.score = {p: model.get_score(i) for p, i in self.id_of.items()}
        byte_ids = {int(self.piece[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(byte_ids) != 256 or any(model.is_unused(i) for i in range(n)):
            raise ValueError("the model has no byte fallback or has unused pieces")
        self.byte_ids = [byte_ids[b] for b in range(256)]
        signs = set("".join(self.id_of))
        inside = {(a, b) for p in self.id_of for a, b in zip(p, p[1:])}
        self.cuts = not any(a != SPACE and b == SPACE for a, b in inside)
        self.apart = np.zeros((256, 256), dtype=bool)  # bytes of ASCII signs that stand side by side in no piece
        self.apart[:128, :128] = True
        for a, b in inside:
            a, b = a.replace(SPACE, " "), b.replace(SPACE, " ")
            if a < "\x80" and b < "\x80":
                self.apart[ord(a), ord(b)] = False
        # signs that occur in pieces, but are none: tokens of their own that end as bytes; their ids follow the vocabulary
        self.loose = {c: n + k for k, c in enumerate(sorted(signs - set(self.id_of)))}
        self.tokens = self.piece + list(self.loose)
        self.automaton = ahocorasick.Automaton()
        for p, i in (self.id_of | self.loose).items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.signs = signs
        self.pairs: dict[int, bool] = {}
        self.known: dict[int, bytes] = {}
        self.earlier: dict[int, bytes] = {}
        self.kind = np.dtype("uint16" if n <= 2**16 else "uint32")
        surface = [p.replace(SPACE, " ").encode() for p in self.piece]
        for i in range(n):
            if model.is_control(i):
                surface[i] = b""
            elif model.is_unknown(i):
                surface[i] = " \u2047 ".encode()
            elif model.is_byte(i):
                surface[i] = bytes([int(self.piece[i][3:5], 16)])
        self.surface = surface
        self.is_byte = [model.is_byte(i) for i in range(n)]
        self.silent = frozenset(i for i in range(n) if not surface[i])
        self.starts_blank = [not special[i] and self.piece[i].startswith(SPACE) for i in range(n)]
        for text in PROBES:
            ids = model.encode(text)
            if self.encode(text) != ids or self.decode(ids) != model.decode(ids):
                raise ValueError(f"the model follows other rules than this operator: {text!r}")

    def merged(self, text: str) -> list[int]:
        """Tokens of a few signs by merging: the highest score first, of equal ones the leftmost."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return [self.id_of.get(p, self.loose.get(p, -1)) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, first: int, second: int) -> bool:
        """Whether merging the signs of both gives the two again; ``first`` is -1 at a chunk's beginning."""
        key = (first + 1) * len(self.tokens) + second
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            if first < 0:
                found = self.merged(self.tokens[second]) == [second]
            else:
                found = self.merged(self.tokens[first] + self.tokens[second]) == [first, second]
            self.pairs[key] = found
        return found

    def _run(self, text: str) -> list[int]:
        """Ids of a run of signs that all occur in the vocabulary: the table of prefixes, then the way back."""
        n = len(text)
        last, begin = [-2] * (n + 1), [0] * (n + 1)
        last[0] = -1
        compatible, pairs, width = self.compatible, self.pairs, len(self.tokens)
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end] == -2:
                first = last[end - size]
                fits = pairs.get((first + 1) * width + token)
                if fits or (fits is None and compatible(first, token)):
                    last[end], begin[end] = token, end - size
        out = []
        while n:
            token = last[n]
            if token < len(self.piece):
                out.append(token)
            else:
                out.extend(self.byte_ids[b] for b in reversed(self.tokens[token].encode()))
            n = begin[n]
        out.reverse()
        return out

    def chunk(self, text: str) -> list[int]:
        """Ids of a text whose spaces are written as the sign for a space already."""
        if self.signs.issuperset(text):
            return self._run(text)
        out, at = [], 0
        for k, c in enumerate(text):  # no piece holds a sign that isn't in the vocabulary, so nothing merges across it
            if c not in self.signs:
                if at < k:
                    out += self._run(text[at:k])
                out += [self.byte_ids[b] for b in c.encode()]
                at = k + 1
        return out + self._run(text[at:]) if at < len(text) else out

    def encode(self, text: str) -> list[int]:
        """Ids of one text, without the cache."""
        return self.chunk(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: one space in front goes; bytes that form no sign become replacement signs, one each."""
        raw = b"".join([self.surface[i] for i in ids])
        for i in ids:  # as the library does: until a sign was written or a space taken, a space in front goes
            if self.starts_blank[i]:
                raw = raw[1:]
            if self.surface[i]:
                break
        try:
            return raw.decode() if self.silent.isdisjoint(ids) else self._decode_runs(ids)
        except UnicodeDecodeError:
            return self._decode_runs(ids)

    def _decode_runs(self, ids: list[int]) -> str:
        out, run, front = [], bytearray(), True
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                size = next((k for k in (1, 2, 3, 4) if _is_sign(bytes(run[:k]))), 0)
                out.append(run[:size].decode() if size else "\ufffd")
                del run[: size or 1]
                front = False
            if i is not None and self.surface[i]:
                part = self.surface[i].decode()
                out.append(part[1:] if front and self.starts_blank[i] else part)
                front = False
        return "".join(out)

    def ids_of(self, texts: pa.Array) -> list[list[bytes]]:
        """The ids of many texts as arrays' bytes, segment by segment."""
        out: list[list[bytes]] = [[] for _ in range(len(texts))]
        hasher = self._hasher()
        cut = None if self.cuts else lambda data, start, end, breaks, limit: []
        sizes = np.diff(wordspans.raw_column(texts)[1])
        begun = np.zeros(len(texts), dtype=bool)
        for rows, data, offsets in wordspans.segments(texts, SPACE_BYTES, cut=cut or self._safe_places):
            starts, at = self._chunks(data, offsets)
            ends = np.append(starts[1:], len(data))[: len(starts)]
            keys = hasher(data, starts, ends)
            first = np.isin(starts, offsets[:-1][sizes[rows] > 0]) & ~begun[rows[at]]  # takes the space that is put in front
            begun[rows] = True
            keys ^= np.where(first, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
            kinds, where, which = np.unique(keys, return_index=True, return_inverse=True)
            found = self._known(kinds.tolist(), data.tobytes(), starts[where].tolist(), ends[where].tolist(), first[where].tolist())
            which, bounds = which.tolist(), np.searchsorted(at, np.arange(len(rows) + 1)).tolist()
            for row, a, b in zip(rows.tolist(), bounds, bounds[1:]):
                out[row].append(b"".join(map(found.__getitem__, which[a:b])))
        return out

    @staticmethod
    def _hasher() -> wordspans.SpanHasher:
        return wordspans.SpanHasher(seed=12)

    def _known(self, keys: list[int], data: bytes, starts: list[int], ends: list[int], first: list[bool]) -> list[bytes]:
        if len(self.known) > CACHED_CHUNKS:  # the chunks that were used since the last time are kept
            self.known, self.earlier = {}, self.known
        known, earlier, found, code = self.known, self.earlier, [], "H" if self.kind.itemsize == 2 else "I"
        for key, a, b, front in zip(keys, starts, ends, first):
            ids = known.get(key)
            if ids is None and key in earlier:
                ids = known[key] = earlier[key]
            elif ids is None:
                text = data[a:b].decode().replace(" ", SPACE)
                ids = known[key] = array(code, self.chunk(SPACE + text if front else text)).tobytes()
            found.append(ids)
        return found

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the chunks and the segment of each; empty texts have none."""
        begin = np.zeros(len(data) + 1, dtype=bool)
        if self.cuts and len(data):
            begin[1:-1] = self.apart[data[:-1], data[1:]] | ((data[1:] == 0x20) & ~_is_blank(data)[:-1])
        begin[offsets[:-1]] = True
        starts = np.flatnonzero(begin[: len(data)])
        return starts, np.searchsorted(offsets, starts, side="right") - 1

    @staticmethod
    def _safe_places(data: np.ndarray, start: int, end: int, is_break: np.ndarray, limit: int) -> list[int]:
        """Where a long text may be cut: spaces that follow another sign, the last of each window; a longer run stays whole."""
        part = data[start:end]
        places = start + 1 + np.flatnonzero((part[1:] == 0x20) & ~_is_blank(part)[:-1])
        out, at = [], start
        while end - at > limit and len(places):
            k = int(np.searchsorted(places, at + limit, side="right"))
            k = k - 1 if k and places[k - 1] > at else k
            if k >= len(places):
                break
            at = int(places[k])
            out.append(at)
        return out


def _is_blank(data: np.ndarray) -> np.ndarray:
    """Bytes that end a space or the sign that stands for one."""
    blank = data == 0x20
    blank[2:] |= (data[2:] == 0x81) & (data[1:-1] == 0x96) & (data[:-2] == 0xE2)
    return blank


def _is_sign(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def load(path: str) -> PieceTable:
    """The table of a model file, once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceTable(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = [np.frombuffer(b"".join(x), dtype=table.kind).astype(np.int32) for x in table.ids_of(part.column(1))]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))],
                    names=["doc_id", "ids"])

    return _id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of every list of ids; a null list is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = [table.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, without the lists between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                sizes, of_ids, of_text = [], [], []
                for x in table.ids_of(part.column(1)):
                    ids = np.frombuffer(b"".join(x), dtype=table.kind).tolist()
                    sizes.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    of_text.append(hashlib.sha256(table.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
