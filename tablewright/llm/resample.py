"""Importance resampling towards a target distribution, by hashed word features.

A text's features are its words and pairs of neighbouring words; a feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``.
Three passes over whole texts, each one numpy pass per Arrow batch:

1. ``head``: the most frequent words and pairs of all documents, with the CRC register after a word and the bucket of a
   pair. Every task counts its own and passes on those with a share of at least ``LOCAL_SHARE``; a word of the global head has
   that share in some task. The head, all entries above a frequency from which on they are at most ``HEAD_WORDS`` and
   ``HEAD_PAIRS``, is broadcast.
2. ``totals``: features per bucket, of the documents and of the target. Words and pairs of the head are looked up, the
   others (the tail) get their CRC directly; a pair goes on from the register of its first word. The head changes the time
   only, never a bucket.
3. Weights: the floored mean of the buckets' gains over a text's features.

Scores add Gumbel noise drawn from the hash of the id, so the highest scores are a sample without replacement in
proportion to exp(weight / 1000). The drawn rows are found by one range sort of (id, number, weight, score).

Words are recognised by 64-bit hashes; two different words of the head and the tail collide with a chance below 1e-6 for 1e9
different words.

Defined cases: null and empty texts have no feature, weight 0 and are not drawn (unless ``min_words`` is 0); a null id counts
as an empty one in the hash and comes first in ties; rows that repeat are scored and drawn each by themselves; an empty
table gives an empty result, an empty target equal buckets. Long texts are read in segments. Only the id and text columns
are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import wordspans
from tablewright.llm.store import Scratch
from tablewright.session import local_table

BUCKETS = 10_000
HEAD_WORDS, HEAD_PAIRS = 1 << 15, 1 << 17
LOCAL_SHARE = 1 / (1 << 18)
COUNTED_AT_ONCE = 1 << 20  # entries a task counts before it drops the rarest
CRC_STEPS = 64  # bytes of many words at once; what a word has beyond goes through zlib
FULL = np.uint32(0xFFFFFFFF)


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


CRC = crc_table()


def crc_registers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, register: np.ndarray) -> np.ndarray:
    """The CRC-32 registers after the bytes of each span, begun at ``register``; the CRC is the register's complement."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    at, state, sizes = starts[order], register[order], lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(1, min(longest, CRC_STEPS) + 1), side="right")
    for k, m in enumerate(running.tolist()):
        now = state[:m]
        state[:m] = CRC[(now ^ data[at[:m] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    for i in range(int(np.searchsorted(-sizes, -CRC_STEPS, side="left"))):
        rest = data[at[i] + CRC_STEPS : at[i] + sizes[i]].tobytes()
        state[i] = np.uint32(zlib.crc32(rest, int(state[i] ^ FULL))) ^ FULL
    out = np.empty_like(state)
    out[order] = state
    return out


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return wordspans.mix(first ^ wordspans.mix(second + np.uint64(13)))


class Features:
    """Buckets of all features of many texts. ``head`` holds looked-up words and pairs; it may be empty."""

    def __init__(self, words: wordspans.Lookup, pairs: wordspans.Lookup, buckets: int):
        self.words, self.pairs, self.buckets = words, pairs, np.uint32(buckets)
        self.reader = wordspans.LowerWords(seed=13)

    def slices(self, column: pa.Array) -> Iterator[tuple]:
        """Per slice of text: (row, key, register) of each word and (row, key, bucket) of each pair. A pair across two
        slices of a long text belongs to the later slice."""
        last = (-1, np.uint64(0), np.uint32(0))
        for row, data, starts, ends, keys in self.reader.slices(column):
            if not len(row):
                continue
            register = self.words.find(keys)
            tail = np.flatnonzero(register < 0)
            register[tail] = crc_registers(data, starts[tail], ends[tail], np.full(len(tail), FULL))
            register = register.astype(np.uint32)
            before_row = np.concatenate([[last[0]], row[:-1]])
            second = np.flatnonzero(before_row == row)
            before_key = np.concatenate([[last[1]], keys[:-1]]).astype(np.uint64)
            before = np.concatenate([[last[2]], register[:-1]]).astype(np.uint32)
            pairs = pair_keys(before_key[second], keys[second])
            bucket = self.pairs.find(pairs)
            tail = np.flatnonzero(bucket < 0)
            at = second[tail]
            blank = CRC[(before[at] ^ np.uint32(32)) & np.uint32(255)] ^ (before[at] >> np.uint32(8))
            bucket[tail] = (crc_registers(data, starts[at], ends[at], blank) ^ FULL) % self.buckets
            last = (row[-1], keys[-1], register[-1])
            yield (row, keys, register), (row[second], pairs, bucket)

    def buckets_of(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, bucket) of every feature, slice by slice."""
        for (row, _, register), (second, _, bucket) in self.slices(column):
            yield np.concatenate([row, second]), np.concatenate([((register ^ FULL) % self.buckets).astype(np.int64), bucket])


def _counted(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One entry per key with its counts added up; the ``most`` most frequent ones."""
    key, where, which = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    n = np.bincount(which, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
    value = np.concatenate([p[2] for p in parts])[where]
    keep = np.argsort(-n, kind="stable")[:most]
    return [(key[keep], n[keep], value[keep])]


def head(docs: DataFrame, text_col: str, buckets: int) -> tuple[wordspans.Lookup, wordspans.Lookup]:
    """The most frequent words and pairs of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(wordspans.Lookup.of([], []), wordspans.Lookup.of([], []), buckets)
        kept: tuple[list, list] = ([], [])
        total = 0
        for batch in batches:
            for words, pairs in features.slices(batch.column(0)):
                total += len(words[0])
                for entries, (_, keys, values) in zip(kept, (words, pairs), strict=True):
                    key, where, n = np.unique(keys, return_index=True, return_counts=True)
                    entries.append((key, n, values[where].astype(np.int64)))
                    if sum(len(e[0]) for e in entries) > COUNTED_AT_ONCE:
                        entries[:] = _counted(entries, COUNTED_AT_ONCE // 4)
        for kind, entries in enumerate(kept):
            if entries:
                key, n, value = _counted(entries, COUNTED_AT_ONCE)[0]
                keep = n >= max(2, total * LOCAL_SHARE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(keep.sum()), kind, dtype=np.int32)), pa.array(key[keep].view(np.int64)),
                     pa.array(n[keep]), pa.array(value[keep])], names=["kind", "key", "n", "value"])

    found = _text(docs, text_col).mapInArrow(run, "kind int, key long, n long, value long")
    found = found.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.first("value").alias("value"))
    found = found.withColumn("level", F.floor(8 * F.log2("n")).cast("int")).persist()
    try:
        sizes = found.groupBy("kind", "level").agg(F.count(F.lit(1)).alias("entries")).collect()  # some hundred levels
        tables = []
        for kind, most in ((0, HEAD_WORDS), (1, HEAD_PAIRS)):
            least, held = 1 << 30, 0  # the lowest level from which on all entries fit the bound
            for r in sorted((r for r in sizes if r["kind"] == kind), key=lambda r: -r["level"]):
                held += r["entries"]
                if held > most:
                    break
                least = r["level"]
            top = found.filter((F.col("kind") == kind) & (F.col("level") >= least)).select("key", "value").toPandas()
            tables.append(wordspans.Lookup.of(top["key"].to_numpy(np.int64).view(np.uint64), top["value"].to_numpy(np.int64)))
    finally:
        found.unpersist()
    return tables[0], tables[1]


def totals(docs: DataFrame, text_col: str, words, pairs, buckets: int) -> np.ndarray:
    """Features per bucket; one partial array per task, added up by Spark. ``words`` and ``pairs`` are broadcasts of the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums = Features(words.value, pairs.value, buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, bucket in features.buckets_of(batch.column(0)):
                sums += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["bucket", "n"])

    rows = _text(docs, text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:  # at most one per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket."""
    size = len(source)
    a, b = float(source.sum() + size), float(target.sum() + size)
    ratios = [(float(t + 1) * a) / (float(s + 1) * b) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], dtype=np.int64)


def weights(docs: DataFrame, id_col: str, text_col: str, words, pairs, gain) -> DataFrame:
    """(doc_id, n_features, weight) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket = gain.value
        features = Features(words.value, pairs.value, len(of_bucket))
        for batch in batches:
            sums, sizes = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(2))
            for row, bucket in features.buckets_of(batch.column(0)):
                first, rows = int(row.min()), row - row.min()
                # doubles hold these sums exactly: a slice has far fewer than 2^53 / 50,000 features
                part = np.bincount(rows, weights=of_bucket[bucket]).astype(np.int64)
                sums[first : first + len(part)] += part
                sizes[first : first + len(part)] += np.bincount(rows)
            mean = sums // np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes), pa.array(mean)], names=["doc_id", "n_features", "weight"])

    rows = _text(docs, text_col, F.col(id_col).cast("long").alias("doc_id"))
    return rows.mapInArrow(run, "doc_id long, n_features long, weight long")


def _text(docs: DataFrame, text_col: str, *more) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
             percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score and rank (1, 2, ... for the drawn ones, else null).

    Of the texts with at least ``min_words`` words, ``percent`` percent (rounded down) are drawn; equal scores go to the smaller id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "resample")
    words, pairs = (spark.sparkContext.broadcast(x) for x in head(docs, text_col, buckets))
    source, aim = totals(docs, text_col, words, pairs, buckets), totals(target, target_text_col, words, pairs, buckets)
    gain = spark.sparkContext.broadcast(gains(source, aim))
    noise = (
        f"CAST(floor(-1000 * ln(-ln((CAST(conv(substr(sha2(concat('{int(seed)}:', coalesce(CAST(doc_id AS string), '')), 256), 1, 8), 16, 10)"
        " AS double) + 0.5D) / 4294967296D))) AS long)"
    )
    scored = weights(docs, id_col, text_col, words, pairs, gain).selectExpr(
        "doc_id", "n_features", "weight", f"weight + {noise} AS score", f"n_features >= {2 * int(min_words) - 1} AS may"
    )
    scored = scratch.write(scored, "scored")
    order = [F.desc("may"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.write(placed.withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("may").alias("may")).orderBy("part").collect()
    before, offsets = 0, []
    for r in counts:  # one per partition
        offsets.append((r["part"], before))
        before += r["n"]
    drawn = percent * sum(r["may"] for r in counts) // 100
    table = local_table(spark, offsets, "part long, before long")
    number = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("part", part).join(table, "part").select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("may") & (number <= drawn), number).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; rows that share an id are drawn together, a null id never."""
    drawn = resample(docs, target, id_col, **options).filter("rank IS NOT NULL").select("doc_id").distinct()
    mine = docs.select(id_col).schema[0].name
    columns = [f"c{i}" for i in range(len(docs.columns))]
    key = columns[docs.columns.index(mine)]
    rows = docs.toDF(*columns).join(drawn, F.col(key).cast("long") == F.col("doc_id"), "left_semi")
    return rows.toDF(*docs.columns)
