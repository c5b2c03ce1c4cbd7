"""Near-duplicates by b-bit MinHash.

1. ``signatures``: one numpy pass per Arrow batch turns each text into its set of word shingles (64-bit hashes), minima of
   ``HASHES`` hash functions, the keys of ``BANDS`` bands of ``ROWS`` minima, and a packed signature that keeps the low
   ``BITS`` bits of each minimum, one bit plane after the other.
2. Texts with equal sets form a class; its smallest doc_id stands for it. Only those meet in the bands.
3. In a band's bucket two centres are compared with every member: a star, not all pairs. What the packed signatures
   put clearly under the threshold (collision-corrected estimate, ``MARGIN`` standard errors) goes no further; the
   rest is confirmed on the full sets.
4. Connected components of the links leave some buckets with members in several components. There, and only there, members
   outside the bucket's largest component are compared with the members of all other components, so no link
   between components is lost to the stars; pairs within one component can't change the result.

A pair at the threshold meets in no band with a chance of (1 - 0.8^6)^48, below one in a million.

Defined cases: null and empty texts, and texts without words, have an empty set and no links; a text of fewer words than a
shingle is one shingle. Rows that share a doc_id and a set are one node; with different sets each has the component of its own
set, and ``keep_one`` keeps those whose text nothing else stands for. A null doc_id represents nothing and is not
kept. An empty table gives an empty result. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import wordspans
from tablewright.llm.components import connected_components
from tablewright.llm.store import Scratch

WIDTH, THRESHOLD = 5, 80
HASHES, BITS, BANDS, ROWS = 1024, 4, 48, 6
MARGIN = 4.5
BROADCAST_IDS = 1_000_000
LONGEST_REST = 64
BATCH_ROWS, BATCH_VALUES = 500, 1 << 18  # texts and hashes of an Arrow batch that goes back to Spark
NO_VALUES = np.empty(0, dtype=np.int64)
SIGNATURE = ("doc_id long, text_hash long, n_shingles long, set_hi long, set_lo long, planes array<long>, bands array<long>")
SETS = "doc_id long, shingles array<long>"


class Shingler:
    """Sets of word shingles of many texts at once, as 64-bit hashes."""

    def __init__(self, width: int):
        self.width = width
        self.hasher = wordspans.SpanHasher(seed=8)
        self.breaks = wordspans.byte_set(wordspans.SPACE_BYTES)
        self.lower = wordspans.lower_ascii()
        self.weights = np.random.default_rng(80).integers(1, 2**63, width, dtype=np.uint64) | np.uint64(1)

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text, in order. A long text is read in segments; of these only the hashes
        of its words are kept until its end."""
        open_row, parts = -1, []
        for rows, data, offsets in wordspans.segments(column, self.breaks):
            data = self.lower[data]
            starts, ends, at = wordspans.word_bounds(data, offsets, self.breaks)
            words = self.hasher(data, starts, ends)
            whole = self._shingles(words)
            bounds = np.searchsorted(at, np.arange(len(rows) + 1))
            for row, a, b in zip(rows.tolist(), bounds[:-1], bounds[1:], strict=True):
                if row != open_row:
                    if open_row >= 0:
                        yield self._set(parts)
                    open_row, parts = row, []
                parts.append((words[a:b], whole[a : max(a, b - self.width + 1)]))
        if open_row >= 0:
            yield self._set(parts)

    def _shingles(self, words: np.ndarray) -> np.ndarray:
        whole = np.zeros(max(len(words) - self.width + 1, 0), dtype=np.uint64)
        for j, weight in enumerate(self.weights):
            whole += words[j : j + len(whole)] * weight
        return wordspans.mix(whole)

    def _set(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if len(parts) == 1:
            words, whole = parts[0]
        else:
            words = np.concatenate([w for w, _ in parts])
            whole = self._shingles(words)
        n = len(words)
        if n >= self.width:
            return np.unique(whole)
        if n:
            total = (words * self.weights[:n]).sum(dtype=np.uint64) + np.uint64(n)
            return wordspans.mix(np.array([total], dtype=np.uint64))
        return np.empty(0, dtype=np.uint64)


class MinHasher:
    def __init__(self):
        rng = np.random.default_rng(88)
        self.a = rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, HASHES, dtype=np.uint32)
        self.band_weights = rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
        self.buffer = np.empty((128, HASHES), dtype=np.uint32)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
        out = np.full(HASHES, 2**32 - 1, dtype=np.uint32)
        for i in range(0, len(x), len(self.buffer)):
            part = x[i : i + len(self.buffer), None]
            block = self.buffer[: len(part)]
            np.multiply(part, self.a, out=block)
            np.add(block, self.b, out=block)
            np.minimum(out, block.min(axis=0), out=out)
        return out

    def bands(self, minima: np.ndarray) -> np.ndarray:
        parts = minima[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
        keys = (wordspans.mix(parts) * self.band_weights).sum(axis=1, dtype=np.uint64)
        return wordspans.mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)

    @staticmethod
    def planes(minima: np.ndarray) -> np.ndarray:
        v = minima ^ (minima >> np.uint32(15))
        v = v * np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(12)
        bits = (v[None, :] >> np.arange(BITS, dtype=np.uint32)[:, None]) & np.uint32(1)
        return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.int64).ravel()


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([NO_VALUES, *parts])))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """One row per text; a text without words has no planes and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, hasher = Shingler(width), MinHasher()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                sizes, hi, lo, planes, bands = [], [], [], [], []
                for s in shingler.sets(part.column(1)):
                    sizes.append(len(s))
                    hi.append(int(wordspans.mix(s).sum(dtype=np.uint64).view(np.int64)))
                    lo.append(int(np.bitwise_xor.reduce(wordspans.mix(s + np.uint64(77))).view(np.int64)))
                    minima = hasher.minima(s)
                    planes.append(hasher.planes(minima) if len(s) else NO_VALUES)
                    bands.append(hasher.bands(minima) if len(s) else NO_VALUES)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                     _lists(planes), _lists(bands)],
                    names=["doc_id", "text_hash", "n_shingles", "set_hi", "set_lo", "planes", "bands"],
                )

    return _id_and_text(docs, id_col, text_col).mapInArrow(run, SIGNATURE)


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles): the full set of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                first, sets, size = 0, [], 0
                for s in shingler.sets(part.column(1)):
                    sets.append(s.view(np.int64))
                    size += len(s)
                    if size >= BATCH_VALUES:  # few long texts are a batch of their own
                        yield _set_batch(part.column(0).slice(first, len(sets)), sets)
                        first, sets, size = first + len(sets), [], 0
                if sets:
                    yield _set_batch(part.column(0).slice(first, len(sets)), sets)

    return texts.select("doc_id", "text").mapInArrow(run, SETS)


def _set_batch(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, _lists(sets)], names=["doc_id", "shingles"])


def _id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def estimate(a: str, b: str) -> F.Column:
    """Similarity from two packed signatures: the share of equal b-bit values, corrected for chance collisions.

    A loop over the packed words, not its 64 unrolled terms: compiling those took gigabytes beside the heap."""
    words = HASHES // 64

    def unequal_in(w: F.Column) -> F.Column:
        planes = [F.get(a, w + plane * words).bitwiseXOR(F.get(b, w + plane * words)) for plane in range(BITS)]
        return F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), planes))

    unequal = F.aggregate(F.sequence(F.lit(0), F.lit(words - 1)), F.lit(0), lambda total, w: total + unequal_in(w))
    chance = 1.0 / 2**BITS
    return ((HASHES - unequal) / HASHES - chance) / (1 - chance)


def likely(a: str, b: str, threshold: int) -> F.Column:
    chance = 1.0 / 2**BITS
    p = threshold / 100 * (1 - chance) + chance
    error = (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)
    return estimate(a, b) >= threshold / 100 - MARGIN * error


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""
    one = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("su"))
    two = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv"))
    common = F.size(F.array_intersect("su", "sv"))
    union = F.size("su") + F.size("sv") - common
    return pairs.join(two, "v").join(one, "u").filter(100 * common >= threshold * union).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    threshold: int = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept."""
    return _found(docs, id_col, text_col, width, threshold, scratch).drop("text_hash")


def _found(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: int, scratch: Scratch | None) -> DataFrame:
    """``near_duplicates`` with a hash of the text, which tells rows apart that share a doc_id."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "minhash")
    rows = scratch.write(signatures(docs, id_col, text_col, width), "signatures")
    members = rows.filter("n_shingles > 0")
    equal = ["n_shingles", "set_hi", "set_lo"]
    classes = members.groupBy(*equal).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    classes = scratch.write(classes.filter("rep IS NOT NULL"), "classes")
    # one row stands for a class; rows that repeat doc_id and set only repeat pairs, which the distinct below takes out
    reps = rows.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *equal])
    reps = scratch.write(reps.select("doc_id", "weight", "n_shingles", "planes", "bands"), "representatives")
    cells = reps.select("doc_id", "weight", F.explode("bands").alias("cell"))
    order = F.col("weight").cast("double") + F.abs(F.xxhash64("doc_id") % 1000) / 1000.0
    stars = cells.groupBy("cell").agg(
        F.count(F.lit(1)).alias("size"),
        F.max_by("doc_id", order).alias("heavy"),
        F.min_by("doc_id", F.xxhash64("doc_id", "cell")).alias("other"),
    ).filter("size > 1").drop("size")
    met = scratch.write(cells.select("doc_id", "cell").join(stars.hint("merge"), "cell"), "met")
    ids = met.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    wanted = _id_and_text(docs, id_col, text_col).select("doc_id", "text").join(ids, "doc_id", "left_semi")
    sets = scratch.write(shingle_sets(wanted, width), "sets")
    planes = reps.select("doc_id", "planes", "n_shingles", "bands")

    centre = F.explode(F.array_distinct(F.array("heavy", "other")))
    pairs = met.select(centre.alias("c"), "doc_id").filter("c <> doc_id")
    pairs = pairs.select(F.least("c", "doc_id").alias("u"), F.greatest("c", "doc_id").alias("v")).distinct()
    pairs = (
        pairs.join(planes.select(F.col("doc_id").alias("u"), F.col("planes").alias("pu"), F.col("n_shingles").alias("nu")), "u")
        .join(planes.select(F.col("doc_id").alias("v"), F.col("planes").alias("pv"), F.col("n_shingles").alias("nv")), "v")
        .filter((100 * F.least("nu", "nv") >= threshold * F.greatest("nu", "nv")) & likely("pu", "pv", threshold))
        .select("u", "v")
    )
    stars_links = scratch.write(_confirmed(pairs, sets, threshold), "star-links")
    first = connected_components(stars_links, scratch, "first")

    crossing = _between_components(met, planes, first, sets, threshold, scratch)
    links = scratch.write(_confirmed(crossing, sets, threshold), "cross-links").unionByName(stars_links)
    found = connected_components(links, scratch, "second")
    scratch.drop("met", "sets", "representatives", "relative")

    of_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select(*equal, F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "text_hash", *equal).join(of_class.hint("merge"), equal, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _between_components(met: DataFrame, planes: DataFrame, components: DataFrame, sets: DataFrame, threshold: int,
                        scratch: Scratch) -> DataFrame:
    """Likely pairs (u, v) that share a bucket, lie in different components and were not compared with a centre.

    Each member's set is known relative to the bucket's centre c: how much of c it holds, and the rest that c lacks. Two members
    share at most the smaller part of c and what their rests share, which rules nearly all pairs out exactly before any full set moves.
    """
    placed = met.join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "doc_id"))
    counts = placed.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("cell").agg(
        F.max_by("component", F.struct("n", "component")).alias("major"), F.count(F.lit(1)).alias("parts"),
        F.sum("n").alias("size"),
    ).filter("parts > 1 AND size > 2").select("cell", "major")
    active = placed.filter("doc_id <> heavy AND doc_id <> other").join(mixed, "cell")
    centres = sets.select(F.col("doc_id").alias("heavy"), F.col("shingles").alias("of_centre"))
    rest = F.array_except("shingles", "of_centre")
    relative = active.select("heavy", "doc_id").distinct().join(sets, "doc_id").join(centres, "heavy").select(
        "heavy", "doc_id", F.size(F.array_intersect("shingles", "of_centre")).alias("held"),
        F.when(F.size(rest) <= LONGEST_REST, rest).alias("rest"),  # without it a pair is not ruled out here
    )
    relative = scratch.write(relative, "relative")
    active = active.join(relative, ["heavy", "doc_id"]).join(planes, "doc_id")
    minor = active.filter("component <> major").select(
        "cell", F.col("doc_id").alias("x"), F.col("component").alias("cx"), F.col("planes").alias("px"), F.col("n_shingles").alias("nx"),
        F.col("bands").alias("bx"), F.col("held").alias("hx"), F.col("rest").alias("rx"))
    every = active.select(
        "cell", F.col("doc_id").alias("y"), F.col("component").alias("cy"), F.col("planes").alias("py"), F.col("n_shingles").alias("ny"),
        F.col("bands").alias("by"), F.col("held").alias("hy"), F.col("rest").alias("ry"), (F.col("component") == F.col("major")).alias("in_major"))
    most = F.least("hx", "hy") + F.size(F.array_intersect("rx", "ry"))
    near = (
        (minor["cell"] == every["cell"]) & (F.col("cx") != F.col("cy")) & (F.col("in_major") | (F.col("x") < F.col("y")))
        & (100 * F.least("nx", "ny") >= threshold * F.greatest("nx", "ny")) & likely("px", "py", threshold)
        & (F.col("rx").isNull() | F.col("ry").isNull() | ((100 + threshold) * most >= threshold * (F.col("nx") + F.col("ny"))))
        & (F.get(F.array_intersect("bx", "by"), F.lit(0)) == minor["cell"])  # a pair comes from its first common bucket alone
    )
    return minor.join(every, near).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: int = THRESHOLD,
             scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` whose document stands for its group, with all their columns, which may have any name. Of rows that
    share an id, only those go whose own text is represented by another document."""
    found = _found(docs, id_col, text_col, width, threshold, scratch)
    gone = found.filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text_hash").distinct()
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = (F.col(f"c{names.index(docs.select(c).columns[0])}") for c in (id_col, text_col))
    same = (key.cast("long") == F.col("id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("text_hash"))
    return rows.join(gone, same, "left_anti").toDF(*names)
