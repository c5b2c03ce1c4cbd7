"""Line deduplication by a tree of line templates.

Lines are parsed as log messages are: a line's leaf is its number of words and its first ``DEPTH`` words, with words that hold
a digit read as the variable field ``<*>``. Lines that are equal but for such fields share a template from the start. In a
leaf with several different lines, a word that few documents have at its place is variable too; a line's template is then what
remains. What is few depends on the leaf and on the template in it, so every level ``min_docs`` times a power of two is tried: the values
of a field fall out at some level below the template's own words, however often each of them occurs. Templates with at least ``min_words`` words, ``CONSTANT`` of them constant, that occur in
``min_docs`` documents are recurring, and their lines are dropped, wherever they stand. With ``long_docs``, a line with
``LONG_WORDS`` constant words also recurs if that many documents with different texts have it; copies of one text count once there.

Texts are parsed in numpy, many at a time, and stay where they are: what is shuffled are hashes of lines and, for the leaves with
several different lines, the hashes of their words, once per different line. The hashes of the recurring templates go to
every task as a sorted array while they are at most ``SENT_TEMPLATES``; beyond that the lines' places are joined with them.

Defined cases: a null text stays null and has no lines; an empty text is one empty line and stays. Rows that share a doc_id count as
one document; rows that repeat give equal rows. Line ends are line feeds; the dropped lines' line feeds go with them. Words and
templates are recognised by 64-bit hashes. An empty table gives an empty result. Long texts are read in segments of whole lines. Only
the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import wordspans
from tablewright.llm.store import Scratch

DEPTH, MIN_WORDS, MIN_DOCS, CONSTANT = 3, 5, 3, 0.7
LONG_WORDS, LONG_DOCS = 50, 2
VARIABLE = "<*>"
SENT_TEMPLATES, SENT_LEAVES = 4_000_000, 1_000_000
BATCH_ROWS = 1_000
SPACE = wordspans.byte_set(wordspans.SPACE_BYTES)
LINE_END = wordspans.byte_set((0x0A,))
DIGIT = wordspans.byte_set(range(0x30, 0x3A))


class Lines:
    """The lines of one slice of texts: row, number in the text, words (n), leaf and template, and the masked words' hashes."""

    def __init__(self, row, number, start, end, n, leaf, template, constant, words, first_word):
        self.row, self.number, self.start, self.end = row, number, start, end
        self.n, self.leaf, self.template, self.constant = n, leaf, template, constant
        self.words, self.first_word = words, first_word


class Parser:
    def __init__(self):
        self.hasher = wordspans.SpanHasher(seed=6)
        sign = np.frombuffer(VARIABLE.encode(), dtype=np.uint8)
        self.variable = self.hasher(sign, np.array([0]), np.array([len(sign)]))[0]
        self.powers = np.ones(1, dtype=np.uint64)

    def _power(self, n: int) -> np.ndarray:
        if len(self.powers) < n:
            steps = np.full(max(n, 256), np.uint64(0x9E3779B97F4A7C15))
            steps[0] = 1
            self.powers = np.cumprod(steps, dtype=np.uint64)
        return self.powers

    def slices(self, column: pa.Array) -> Iterator[tuple[np.ndarray, Lines]]:
        """(bytes, lines) of each slice; a text of several slices goes on with its next line's number."""
        counted = np.zeros(len(column), dtype=np.int64)
        begun = np.zeros(len(column), dtype=bool)
        for rows, data, offsets in wordspans.segments(column, LINE_END):
            feeds = np.flatnonzero(data == 0x0A)
            segment_of_feed = np.searchsorted(offsets, feeds, side="right") - 1
            new = np.flatnonzero(~begun[rows] & (np.diff(rows, prepend=-1) != 0))
            begun[rows] = True
            start = np.concatenate([feeds + 1, offsets[new]])
            segment = np.concatenate([segment_of_feed, new])
            order = np.lexsort((start, segment))
            start, segment = start[order], segment[order]
            at = np.searchsorted(feeds, start)
            next_feed = np.append(feeds, len(data))[at]
            end = np.minimum(next_feed, offsets[segment + 1])
            row = rows[segment]
            first = np.searchsorted(row, row)
            number = counted[row] + np.arange(len(row)) - first
            counted += np.bincount(row, minlength=len(counted))
            yield data, self._lines(data, offsets, row, number, start, end, segment)

    def _lines(self, data, offsets, row, number, start, end, segment) -> Lines:
        a, b, of_segment = wordspans.word_bounds(data, offsets, SPACE)
        words = self.hasher(data, a, b)
        digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
        words[digits[b] > digits[a]] = self.variable
        line = np.searchsorted(start, a, side="right") - 1
        n = np.bincount(line, minlength=len(start)) if len(start) else np.empty(0, np.int64)
        first_word = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(len(words)) - first_word[line]
        parts = wordspans.mix(words) * self._power(int(n.max(initial=0)) + 1)[place]

        def added(values):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
            return sums[first_word[1:]] - sums[first_word[:-1]]

        size = n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        template = wordspans.mix(added(parts) + size)
        leaf = wordspans.mix(added(np.where(place < DEPTH, parts, np.uint64(0))) ^ size)
        fixed = np.concatenate([[0], np.cumsum(words != self.variable)])
        return Lines(row, number, start, end, n, leaf.view(np.int64), template.view(np.int64), fixed[first_word[1:]] - fixed[first_word[:-1]],
                     words.view(np.int64), first_word)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def _line_hashes(keyed: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_hash, leaf, template, n, is_long) of every line with at least ``min_words`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for part in _parts(batches):
            for _, lines in parser.slices(part.column(1)):
                keep = np.flatnonzero(lines.n >= min_words)
                rows = pa.array(lines.row[keep])
                long = (lines.n[keep] >= LONG_WORDS) & (lines.constant[keep] >= LONG_WORDS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(2).take(rows), pa.array(lines.leaf[keep]), pa.array(lines.template[keep]),
                     pa.array(lines.n[keep].astype(np.int32)), pa.array(long)],
                    names=["doc_id", "text_hash", "leaf", "template", "n", "is_long"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.filter("text IS NOT NULL").mapInArrow(
        run, f"doc_id {kind}, text_hash long, leaf long, template long, n int, is_long boolean")


def _words_of(keyed: DataFrame, leaves: DataFrame, min_words: int) -> DataFrame:
    """(leaf, template, words): the masked words' hashes of the different lines in the given leaves, once per task at least."""
    few = leaves.count() <= SENT_LEAVES
    context = keyed.sparkSession.sparkContext
    wanted = context.broadcast(np.sort(leaves.toPandas()["leaf"].to_numpy(np.int64))) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, seen = Parser(), np.empty(0, dtype=np.int64)
        for part in _parts(batches):
            for _, lines in parser.slices(part.column(0)):
                keep = lines.n >= min_words
                if wanted is not None:
                    keep &= _among(lines.leaf, wanted.value)
                keep = np.flatnonzero(keep)
                _, first = np.unique(lines.template[keep], return_index=True)
                keep = keep[first]
                keep = keep[~_among(lines.template[keep], seen)]
                seen = np.union1d(seen, lines.template[keep])[-SENT_LEAVES:]
                ends = np.concatenate([[0], np.cumsum(lines.n[keep])])
                index = np.repeat(lines.first_word[keep] - ends[:-1], lines.n[keep]) + np.arange(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lines.leaf[keep]), pa.array(lines.template[keep]),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(lines.words[index]))],
                    names=["leaf", "template", "words"])

    found = keyed.filter("text IS NOT NULL").select("text").mapInArrow(run, "leaf long, template long, words array<long>")
    return found if few else found.join(leaves, "leaf", "left_semi")


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def recurring_lines(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS,
                    id_col: str = "doc_id", text_col: str = "text", long_docs: int | None = LONG_DOCS) -> DataFrame:
    """The templates whose lines are dropped."""
    keyed = _keyed(docs, id_col, text_col)
    long = scratch.write(_line_hashes(keyed, min_words), "lines")
    variable = F.lit(int(Parser().variable.view(np.int64)))
    counts = long.select("leaf", "template", "n", "doc_id").distinct().groupBy("leaf", "template", "n").agg(
        F.count(F.lit(1)).alias("docs")
    )
    counts = scratch.write(counts, "counts")
    leaves = counts.groupBy("leaf").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("kinds"))
    leaves = scratch.write(leaves.filter((F.col("docs") >= min_docs) & (F.col("kinds") > 1)).select("leaf"), "leaves")
    wanted = _words_of(keyed, leaves, min_words)
    kinds = wanted.groupBy("template").agg(F.first("words").alias("words")).join(counts, "template")
    words = scratch.write(kinds.select("leaf", "template", "n", "docs", F.posexplode("words").alias("place", "word")), "words")
    constant = words.groupBy("leaf", "place", "word").agg(F.sum("docs").alias("in_docs")).filter(
        (F.col("in_docs") >= min_docs) & (F.col("word") != variable)
    )
    marked = words.join(constant, ["leaf", "place", "word"], "left")
    marked = marked.groupBy("leaf", "template", "n", "docs").agg(
        F.array_sort(F.collect_list(F.struct("place", "word", F.coalesce("in_docs", F.lit(0)).alias("in_docs")))).alias("words")  # of one line
    )
    needed = F.ceil(F.lit(CONSTANT) * F.col("n")).cast("int")  # constant words a template has at least
    weakest = F.get(F.sort_array(F.transform("words", lambda w: w["in_docs"]), asc=False), needed - 1)
    marked = marked.withColumn("weakest", weakest).filter(F.col("weakest") >= min_docs)
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.col("weakest") / min_docs) + 1e-9).cast("int"))

    def at_level(k):
        """The template whose constant words are in min_docs * 2^k documents of the leaf at least."""
        least = F.lit(min_docs) * F.pow(F.lit(2), k)
        return F.xxhash64("leaf", F.transform("words", lambda w: F.when(w["in_docs"] >= least, w["word"]).otherwise(variable)))

    general = marked.select("template", "docs", F.explode(F.array_distinct(F.transform(levels, at_level))).alias("general"))
    general = scratch.write(general, "general")
    sums = general.groupBy("general").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("docs").alias("docs"), F.max("docs").alias("most")
    ).filter((F.col("kinds") > 1) & (F.col("docs") >= min_docs)).select("general", "most")
    general = scratch.write(general.join(sums, "general"), "shared")
    sure = general.filter(F.col("most") >= min_docs).select("general").distinct()
    doubtful = general.filter(F.col("most") < min_docs).select("template", "general")  # each line in fewer than min_docs documents
    in_docs = long.select("template", "doc_id").distinct().join(doubtful, "template").select("general", "doc_id").distinct()
    often = in_docs.groupBy("general").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs).select("general")
    often = sure.union(often)
    exact = counts.filter(F.col("docs") >= min_docs).select("template")
    recurring = exact.union(general.join(often, "general").select("template"))
    if long_docs is not None:
        holders = long.filter("is_long").select("template", "doc_id", "text_hash")
        ids, texts = (holders.select("template", c).distinct().groupBy("template").agg(F.count(F.lit(1)).alias(c)) for c in ("doc_id", "text_hash"))
        shared = ids.join(texts, "template").filter(F.least("doc_id", "text_hash") >= long_docs)
        recurring = recurring.union(shared.select("template"))
    return scratch.write(recurring.distinct(), "recurring")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                         text_col: str = "text", long_docs: int | None = LONG_DOCS) -> DataFrame:
    """One row per document: doc_id, text without its recurring lines, n_lines, n_dropped, dropped (their places, from 0)."""
    scratch = Scratch(docs.sparkSession, "templates")
    recurring = recurring_lines(docs, scratch, min_docs, min_words, id_col, text_col, long_docs)
    keyed = _keyed(docs, id_col, text_col)
    if recurring.count() <= SENT_TEMPLATES:
        gone = docs.sparkSession.sparkContext.broadcast(np.sort(recurring.toPandas()["template"].to_numpy(np.int64)))
        return _without(keyed.select("doc_id", "text"), lambda lines, part: (lines.n >= min_words) & _among(lines.template, gone.value))
    places = _places(keyed, min_words).join(recurring, "template").groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set("line")).alias("lines"))
    places = places.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"), "lines")
    marked = keyed.join(places, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash")), "left")
    return _without(marked.select("doc_id", "text", "lines"), _listed)


def _places(keyed: DataFrame, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for part in _parts(batches):
            for _, lines in parser.slices(part.column(1)):
                keep = np.flatnonzero(lines.n >= min_words)
                rows = pa.array(lines.row[keep])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(2).take(rows), pa.array(lines.template[keep]), pa.array(lines.number[keep].astype(np.int32))],
                    names=["doc_id", "text_hash", "template", "line"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.filter("text IS NOT NULL").mapInArrow(run, f"doc_id {kind}, text_hash long, template long, line int")


def _listed(lines: Lines, part: pa.RecordBatch) -> np.ndarray:
    """The lines whose numbers stand in the row's list."""
    column = part.column(2)
    width = int(max(lines.number.max(initial=0), 0)) + 1
    listed = pa.compute.list_parent_indices(column).to_numpy() * width
    numbers = column.flatten().to_numpy()
    near = numbers < width
    return _among(lines.row * width + lines.number, np.sort(listed[near] + numbers[near]))


def _without(rows: DataFrame, chosen) -> DataFrame:
    """The documents without the lines that ``chosen`` names; texts stay in their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for part in _parts(batches):
            column = part.column(1)
            n_lines, dropped = np.zeros(len(column), dtype=np.int64), [[] for _ in range(len(column))]
            for _, lines in parser.slices(column):
                n_lines += np.bincount(lines.row, minlength=len(column))
                gone = np.flatnonzero(chosen(lines, part))
                for row, number in zip(lines.row[gone].tolist(), lines.number[gone].tolist(), strict=True):
                    dropped[row].append(number)
            cut = [row for row, numbers in enumerate(dropped) if numbers]
            texts = column.to_pylist() if cut else None
            for row in cut:
                away = set(dropped[row])
                texts[row] = "\n".join(line for k, line in enumerate(texts[row].split("\n")) if k not in away)
            nulls = column.is_null().to_numpy(zero_copy_only=False)
            n_lines[nulls] = 0
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(texts, pa.string()) if cut else column, pa.array(n_lines), pa.array([len(d) for d in dropped], pa.int64()),
                 pa.array(dropped, pa.list_(pa.int32()))], names=["doc_id", "text", "n_lines", "n_dropped", "dropped"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string, n_lines long, n_dropped long, dropped array<int>")
