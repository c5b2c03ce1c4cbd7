"""Token ids as flat binary files with 64-bit offsets.

``write_tokens`` range-partitions the documents by id. Each partition becomes three files in the shared folder: ``.ids`` (token
ids, little-endian unsigned 16- or 32-bit, nothing between documents), ``.offsets`` (64-bit place of each document's first id in that file,
and the end) and ``.docs`` (64-bit document ids, the smallest number for null). ``manifest`` has a row per partition with its
base, the prefix sum of the ids before it. ``read_tokens`` memory-maps the files (or reads them through the file system, where
there is nothing to map) and gives any document's ids.

Tasks write under a name of their own and rename it when complete, so a repeated or lost task leaves whole files. Documents
with the same id are ordered by a hash of their text. The library encodes every different piece of text once per task: texts
are cut at white space and between letters and punctuation, where the tokenizer's own pre-tokenizer always cuts and its
normaliser changes nothing across; ``plain_cuts`` says whether a tokenizer has these rules, and without them texts are encoded whole.

Defined cases: a null text counts as empty and has the end id alone; a null doc_id sorts first; an empty table gives an empty
manifest. Rows that repeat are written each time. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm import wordspans
from tablewright.llm.store import Scratch

END_ID = 1
NULL_ID = -(2**63)
MANIFEST = "part int, file string, n_docs long, n_tokens long, width int"
LETTERS = wordspans.byte_set([*range(65, 91), *range(97, 123)])
#: No apostrophe, which contractions start with, and no sign that control strings consist of.
PUNCTUATION = wordspans.byte_set(map(ord, ".,!?;:\"#$%&()*+-/=@[\\]^_`{}~"))
LATIN_LEADS = wordspans.byte_set((0xC3, 0xC4, 0xC5))  # two-byte letters up to U+017F, but for the two signs below
NO_LETTERS = (0xC397, 0xC3B7, 0xC4B0)  # two signs, and the dotted capital I, which becomes two characters in lower case
WHITE_SPACE = wordspans.byte_set((0x20, 0x09, 0x0A, 0x0D))
CACHE_PIECES = 2_000_000
PIECES_AT_ONCE = 256


def _file_system(folder: str):
    """The pyarrow file system and the path in it of a folder named by a path or URI."""
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return pafs.FileSystem.from_uri(folder)


def plain_cuts(tokenizer) -> bool:
    """True if the tokenizer splits at white space and between letters and punctuation whatever stands around."""
    rules = repr(tokenizer.pre_tokenizer)
    return r"[\p{L}]+" in rules and r"[^\s\p{L}\p{N}]+" in rules and "invert=True" in rules and "Lowercase" in repr(
        tokenizer.normalizer
    )


class Encoder:
    """Ids of many texts at once, with the end id after each."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For words of Latin letters, which are composed already and one unit each: the same model without the other rules.
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Lowercase()
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        if suffix:
            self.ends_word[[i for word, i in self.tokenizer.get_vocab().items() if word.endswith(suffix)]] = True
        self.end_id = end_id
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 2**16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.cuts = plain_cuts(self.tokenizer)
        self.hasher = wordspans.SpanHasher(seed=10)
        self.lower = wordspans.lower_ascii()
        self.known: dict[int, np.ndarray] = {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array([*e.ids, self.end_id], dtype=self.kind)
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of any pieces."""
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind) for e in found]

    def _latin(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of words of Latin letters, many in one text; the tokens that end a word part them again."""
        texts = [b" ".join(pieces[i : i + PIECES_AT_ONCE]).decode() for i in range(0, len(pieces), PIECES_AT_ONCE)]
        found = self.words.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=self.kind) for e in found]) if found else np.empty(0, self.kind)
        ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(ends) != len(pieces):  # a tokenizer that marks no word ends
            return self._pieces(pieces)
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def batches(self, column: pa.Array) -> Iterator[list[np.ndarray]]:
        for first, end, data, offsets in wordspans.slices(column):
            if self.cuts:
                yield self._cut(data, offsets)
            else:
                yield self._whole([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])

    def _cut(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n = len(offsets) - 1
        data = self.lower[raw]
        starts, ends, row = wordspans.word_bounds(data, offsets, WHITE_SPACE)
        cut, letters = self._cuts(data)
        cut = cut[~np.isin(cut, offsets)]
        inner_row = np.searchsorted(offsets, cut, side="right") - 1
        order = np.argsort(np.concatenate([starts, cut]), kind="stable")
        starts, row = np.concatenate([starts, cut])[order], np.concatenate([row, inner_row])[order]
        ends = np.sort(np.concatenate([ends, cut]))
        keys = self.hasher(data, starts, ends)
        pieces, where, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known, keys_of = self.known, pieces.tolist()
        others = np.concatenate([[0], np.cumsum(~letters)])
        first, last = starts[where], ends[where]
        plain = (others[last] == others[first]).tolist()
        text, new = data.tobytes(), {True: ([], []), False: ([], [])}
        for key, is_plain, a, b in zip(keys_of, plain, first.tolist(), last.tolist(), strict=True):
            if key not in known:
                new[is_plain][0].append(key)
                new[is_plain][1].append(text[a:b])
        for is_plain, encode in ((True, self._latin), (False, self._pieces)):
            unknown, parts = new[is_plain]
            known.update(zip(unknown, encode(parts) if parts else [], strict=True))
        found = [known[key] for key in keys_of]
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.concatenate(found) if found else np.empty(0, self.kind)
        begin = np.cumsum(lengths) - lengths
        size = lengths[which]
        to = np.cumsum(size)
        ids = flat[np.repeat(begin[which] - (to - size), size) + np.arange(to[-1] if len(to) else 0)]
        bounds = np.concatenate([[0], to])[np.searchsorted(row, np.arange(n + 1))]
        out = [np.append(ids[a:b], self.kind.type(self.end_id)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self._marked(raw, offsets, out)
        return out

    @staticmethod
    def _cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places between a letter and punctuation, either way round, and the bytes of letters (ASCII or two-byte Latin ones)."""
        begins, ends = LETTERS[data], LETTERS[data]
        if len(data) < 2:
            return np.empty(0, dtype=np.int64), begins
        pair = (data[:-1].astype(np.uint16) << 8) | data[1:]
        two = LATIN_LEADS[data[:-1]] & ~np.isin(pair, NO_LETTERS)  # a letter begins here and ends at the next byte
        begins[:-1] |= two
        ends[1:] |= two
        marks = PUNCTUATION[data]
        return np.flatnonzero((marks[1:] & ends[:-1]) | (marks[:-1] & begins[1:])) + 1, begins | ends

    def _marked(self, raw: np.ndarray, offsets: np.ndarray, out: list[np.ndarray]) -> None:
        """Encodes texts whole that may hold a control string, whose letters have a case and whose parts belong together,
        or marks that combine with the letter before them, which depends on its case."""
        pair = (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
        place = np.concatenate([np.flatnonzero(pair), np.flatnonzero((raw == 0xCC) | (raw == 0xCD))])
        for i in np.unique(np.searchsorted(offsets, place, side="right") - 1):
            out[i] = self._whole([raw[offsets[i] : offsets[i + 1]].tobytes().decode()])[0]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID) -> DataFrame:
    """Writes the files below ``folder`` and returns the manifest: part, file, n_docs, n_tokens, width, base, first_doc."""
    run = uuid.uuid4().hex[:8]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        files, base = _file_system(folder)
        encoder, sizes, docs_of, ids_file = Encoder(tokenizer, end_id), [], [], None
        name = f"{base}/part-{part:06d}"
        own = f"{name}-{run}-{context.taskAttemptId()}"
        for batch in batches:
            column = batch.column(1)
            if ids_file is None and batch.num_rows:
                files.create_dir(base, recursive=True)
                ids_file = files.open_output_stream(f"{own}.ids")
            for group in encoder.batches(column):
                sizes.extend(map(len, group))
                ids_file.write(np.concatenate(group).tobytes())
            docs_of.append(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
        if ids_file is None:
            return
        ids_file.close()
        tables = {"offsets": np.cumsum([0, *sizes]).astype("<i8"), "docs": np.concatenate(docs_of).astype("<i8")}
        for end, table in tables.items():
            with files.open_output_stream(f"{own}.{end}") as f:
                f.write(table.tobytes())
        for end in ("ids", "offsets", "docs"):
            files.move(f"{own}.{end}", f"{name}.{end}")
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "file": f"part-{part:06d}", "n_docs": len(sizes), "n_tokens": int(tables["offsets"][-1]),
              "width": encoder.width}],
            schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                              ("width", pa.int32())]),
        )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, MANIFEST)
    spark = docs.sparkSession
    parts.write.mode("overwrite").parquet(f"{folder}/sizes")
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # one row per file
    sums = spark.read.schema(MANIFEST).parquet(f"{folder}/sizes")
    sums = sums.withColumn("base", F.sum("n_tokens").over(up_to) - F.col("n_tokens"))
    sums = sums.withColumn("first_doc", F.sum("n_docs").over(up_to) - F.col("n_docs"))
    sums.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _mapped(files, path: str, kind: np.dtype) -> np.ndarray:
    """A file as an array: memory-mapped where the file system is local."""
    if isinstance(files, pafs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.empty(0, kind)
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype=kind)


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (CRC-32 of
    its ids as little-endian unsigned 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _file_system(folder)
        for batch in batches:
            for x in batch.to_pylist():
                path = f"{base}/{x['file']}"
                ids = _mapped(files, f"{path}.ids", np.dtype("<u2" if x["width"] == 2 else "<u4"))
                offsets = _mapped(files, f"{path}.offsets", np.dtype("<i8"))
                names = np.array(_mapped(files, f"{path}.docs", np.dtype("<i8")))
                for at in range(0, len(names), 10_000):
                    o = np.array(offsets[at : at + 10_001])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(o[:-1], o[1:], strict=True)]
                    ids_of = names[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids_of, mask=ids_of == NULL_ID), pa.array(o[:-1] + x["base"]), pa.array(np.diff(o)),
                         pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = manifest.repartition(max(1, manifest.count()), "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
                folder: str | None = None) -> DataFrame:
    """Writes the files to ``folder`` (by default one in the shared folder) and reads every document back from them."""
    folder = folder or Scratch(docs.sparkSession, "tokens").path("files")
    return read_tokens(write_tokens(docs, folder, tokenizer, id_col, text_col, end_id), folder)
