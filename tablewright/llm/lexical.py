"""Ranked lexical search: the best documents for each query item by integer term weights and saturated term frequencies.

The items form blocks of bounded size; each block is two passes over all documents, whole texts in segments:

1. ``corpus_counts``: documents, terms, and for each term of the block's vocabulary the documents that hold it.
2. ``search``: a task takes ``TILE_DOCS`` documents at a time. Their impacts (saturated frequencies, integers) fill a dense tile of
   terms times documents, of the terms that occur in it; BLAS multiplies it by the matching columns of the dense matrix of
   items times terms, which holds the term weights, in float64. A tile of the vocabulary is narrow enough that no partial
   sum reaches 2^53, so every product is exact; tiles are added up as 64-bit integers. Of each tile the entries that can
   still be among the ``k`` best of their item by (score, smaller id) are kept, so ties are never lost.

The tasks' best lists are merged by two ranking steps, the first one over salted parts of each item.

Terms are recognised by 64-bit hashes; a document's term and one of the vocabulary collide with a chance below 1e-5 for 1e9
different terms and 1e5 in the vocabulary.

Defined cases: null and empty texts have no term and are neither counted nor found; an item without terms has no result; items that
share an id are ranked each by itself, repeated documents are listed each; a null doc_id comes after all others in ties. An empty
table gives an empty result. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm import wordspans
from tablewright.session import local_table, numbered

K = 10
ITEMS_AT_ONCE, ITEM_BYTES_AT_ONCE = 256, 1 << 24  # what the driver holds of the items at a time
TILE_DOCS, TILE_TERMS = 256, 4096
EXACT = 2**53
IMPACT = 1_000_000_000
NO_ID = 2**63 - 1
SALTS = 256


class Vocabulary:
    """The terms of a block of items as columns 0, 1, ..., and which item holds which."""

    def __init__(self, texts: list[str | None]):
        held = []
        for row, _, _, _, keys in wordspans.LowerWords(seed=11).slices(pa.array(texts, pa.string())):
            held.append((row, keys))
        rows = np.concatenate([np.empty(0, np.int64), *[r for r, _ in held]]).astype(np.int64)
        keys = np.concatenate([np.empty(0, np.uint64), *[k for _, k in held]])
        terms, column = np.unique(keys, return_inverse=True)
        self.n_items, self.n_terms = len(texts), len(terms)
        self.lookup = wordspans.Lookup.of(terms, np.arange(len(terms)))
        self.entries = np.unique(rows * max(len(terms), 1) + column)

    def matrix(self, weights: np.ndarray) -> np.ndarray:
        """Items times terms: the term's weight where the item holds it."""
        out = np.zeros((self.n_items, self.n_terms))
        row, column = np.divmod(self.entries, max(self.n_terms, 1))
        out[row, column] = weights[column]
        return out


def term_counts(reader: wordspans.LowerWords, vocabulary: Vocabulary, texts: pa.Array):
    """(terms of each text, and for each text and vocabulary term that it holds: row, column, occurrences)."""
    sizes, parts, counts = np.zeros(len(texts), dtype=np.int64), [], []
    width = max(vocabulary.n_terms, 1)
    for row, _, _, _, keys in reader.slices(texts):
        sizes += np.bincount(row, minlength=len(texts))
        column = vocabulary.lookup.find(keys)
        known = np.flatnonzero(column >= 0)
        pair, n = np.unique(row[known] * width + column[known], return_counts=True)
        parts.append(pair)
        counts.append(n)
    if not parts:
        nothing = np.empty(0, dtype=np.int64)
        return sizes, nothing, nothing, nothing
    pair, which = np.unique(np.concatenate(parts), return_inverse=True)  # a long text has several slices
    n = np.bincount(which, weights=np.concatenate(counts), minlength=len(pair)).astype(np.int64)
    return sizes, *np.divmod(pair, width), n


def corpus_counts(docs: DataFrame, text_col: str, vocabulary) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms of all documents, documents that hold each term); added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, reader = vocabulary.value, wordspans.LowerWords(seed=11)
        holders, n_docs, n_terms = np.zeros(mine.n_terms, dtype=np.int64), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_DOCS):
                sizes, _, column, _ = term_counts(reader, mine, batch.column(0).slice(at, TILE_DOCS))
                n_docs, n_terms = n_docs + int((sizes > 0).sum()), n_terms + int(sizes.sum())
                holders += np.bincount(column, minlength=mine.n_terms)
        used = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, [-2, -1])), pa.array(np.append(holders[used], [n_docs, n_terms]))], names=["term", "n"])

    rows = _text(docs, text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in rows.collect()}  # at most one per term of the block
    holders = np.zeros(vocabulary.value.n_terms, dtype=np.int64)
    for term, n in found.items():
        if term >= 0:
            holders[term] = n
    return found.get(-2, 0), found.get(-1, 0), holders


def term_weights(n_docs: int, holders: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))), never negative."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holders.tolist()], dtype=np.int64)


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Saturated frequencies (1e9 tf) div (1000 tf + 8 m), where m grows with the text's length against the mean."""
    if len(size) and 90 * int(size.max()) * n_docs >= 2**63:  # beyond 64 bits: Python's integers
        m = np.array([10 + 90 * n * n_docs // n_terms for n in size.tolist()], dtype=np.int64)
    else:
        m = 10 + (90 * size * n_docs) // max(n_terms, 1)
    return (IMPACT * tf) // (1000 * tf + 8 * m)


class Best:
    """The k best (score, smaller id) of each item so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.score, self.id = np.zeros(n_items, dtype=np.int64), np.full(n_items, -(2**63), dtype=np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Entries below an item's k-th best so far, or equal to it with a larger id, can't be among its best."""
        bar = self.score[:, None]
        item, column = np.nonzero((scores > bar) | ((scores == bar) & (ids[None, :] < self.id[:, None])))
        self.parts.append((item, ids[column], scores[item, column]))
        self.n += len(item)
        if self.n > 4 * self.k * len(self.score) + 10_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keeps the k best of each item and raises the bars of items that have k."""
        if not self.parts:
            return (np.empty(0, dtype=np.int64),) * 3
        item, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -score, item))
        item, ids, score = item[order], ids[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.k - 1
        self.score[item[last]], self.id[item[last]] = score[last], ids[last]
        keep = place < self.k
        self.parts, self.n = [(item[keep], ids[keep], score[keep])], int(keep.sum())
        return self.parts[0]


def tile_terms(weights: np.ndarray) -> int:
    """The width of a vocabulary tile for which partial sums stay below 2^53: an impact is below 1e6."""
    return max(1, min(TILE_TERMS, EXACT // (max(int(weights.max(initial=1)), 1) * (IMPACT // 1000))))


def tile_scores(matrix: np.ndarray, row: np.ndarray, column: np.ndarray, impact: np.ndarray, n_docs: int, width: int) -> np.ndarray:
    """Items times documents as exact integers; the vocabulary is cut down to the terms of these documents, then into tiles."""
    terms, compact = np.unique(column, return_inverse=True)
    out = np.zeros((len(matrix), n_docs), dtype=np.int64)
    for at in range(0, len(terms), width):
        here = (compact >= at) & (compact < at + width)
        tile = np.zeros((len(terms[at : at + width]), n_docs))
        tile[compact[here] - at, row[here]] = impact[here]
        out += (matrix[:, terms[at : at + width]] @ tile).astype(np.int64)
    return out


def _search_block(docs: DataFrame, texts: list[str | None], id_col: str, text_col: str, k: int) -> DataFrame:
    """(item, doc_id, score): for each item of the block at least its k best documents, by its place in ``texts``."""
    context = docs.sparkSession.sparkContext
    vocabulary = context.broadcast(Vocabulary(texts))
    n_docs, n_terms, holders = corpus_counts(docs, text_col, vocabulary)
    weights = term_weights(n_docs, holders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, reader = vocabulary.value, wordspans.LowerWords(seed=11)
        matrix, width, best = mine.matrix(weights), tile_terms(weights), Best(mine.n_items, k)
        for batch in batches:
            ids = batch.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, TILE_DOCS):
                part = batch.column(0).slice(at, TILE_DOCS)
                sizes, row, column, tf = term_counts(reader, mine, part)
                impact = impacts(tf, sizes[row], n_docs, n_terms)
                best.add(tile_scores(matrix, row, column, impact, len(part), width), ids[at : at + TILE_DOCS])
        item, ids, score = best.cut()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    rows = _text(docs, text_col, F.col(id_col).cast("long").alias("doc_id"))
    return rows.mapInArrow(run, "item long, doc_id long, score long")


def _text(docs: DataFrame, text_col: str, *more) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def search(docs: DataFrame, items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", id_col: str = "doc_id",
           text_col: str = "text", k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 of each item, equal scores by smaller id."""
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS_AT_ONCE), -(-size // ITEM_BYTES_AT_ONCE))
    if blocks > 1:
        asked = numbered(asked).withColumn("block", F.pmod(F.xxhash64("__id"), F.lit(blocks)))
    results = []
    for b in range(blocks):
        rows = (asked if blocks == 1 else asked.filter(F.col("block") == b)).select("item_id", "text").collect()
        found = _search_block(docs, [r["text"] for r in rows], id_col, text_col, k)
        by = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("salt", F.spark_partition_id() % SALTS)
        found = found.withColumn("rank", F.row_number().over(by("item", "salt"))).filter(F.col("rank") <= k)
        found = found.withColumn("rank", F.row_number().over(by("item"))).filter(F.col("rank") <= k)
        names = local_table(docs.sparkSession, [(i, r["item_id"]) for i, r in enumerate(rows)],
                            f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        results.append(found.join(names, "item").select(
            "item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"))
    return reduce(DataFrame.unionByName, results)
