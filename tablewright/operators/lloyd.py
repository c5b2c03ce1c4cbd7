"""K-means fits of many candidates together: all cluster counts and restarts advance in the same scans.

The points lie in blocks of one table row each, so a scan moves a few buffers instead of rows. The centres of all candidates form one
matrix. An iteration is two matrix products per block, distances and then sums by nearest centre, and one grouped sum with a
row per centre, so its number of scans does not grow with the candidates. Candidates that have settled leave the
block. Starting centres come from one pool, oversampled in a few scans by distance (the k-means|| scheme) and shared
by all candidates; each draws its own start from the weighted pool.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ITERATIONS = 50
TOLERANCE = 1e-4
POOL_ROUNDS = 3
POOL_PER_CLUSTER = 8
DISTANCES_AT_ONCE = 1 << 18  # between a block of points and all centres; 2 MB, which stay near the core


@dataclass(frozen=True)
class Fit:
    centres: np.ndarray
    cost: float  # sum of squared distances to the centres before the last move
    iterations: int


def packed(points: DataFrame) -> DataFrame:
    """The array column ``x`` in blocks: one row with the bytes of all points of an Arrow batch, in their order."""
    if dict(points.dtypes)["x"] == "binary":
        return points

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.ascontiguousarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), dtype="float64")
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["x"])

    return points.select("x").mapInArrow(run, "x binary")


def _points(batches: Iterator[pa.RecordBatch], width: int, centres: int) -> Iterator[np.ndarray]:
    """Slices of the blocks, small enough to be held against all centres."""
    size = max(64, DISTANCES_AT_ONCE // centres)
    for batch in batches:
        for block in batch.column(0):
            x = np.frombuffer(block.as_buffer(), dtype="float64").reshape(-1, width)
            yield from (x[i : i + size] for i in range(0, len(x), size))


def _distances(x: np.ndarray, centres: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Squared distances without the points' own lengths, which don't change what is nearest."""
    return lengths[None, :] - 2.0 * (x @ centres.T)


def _add(x: np.ndarray, far: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Adds the columns of ``x`` up by nearest centre, the first on ties, and returns the least of ``far`` (candidates by centres by points)."""
    runs, k, n = far.shape
    if not np.isfinite(x).all():  # a product would carry such a point into the sums of all centres
        at = far.argmin(axis=1)
        for r in range(runs):
            total[r] += np.stack([np.bincount(at[r], weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        return np.take_along_axis(far, at[:, None], axis=1)[:, 0]
    least = far.min(axis=1)
    hit = far == least[:, None]
    if np.count_nonzero(hit) != runs * n:  # ties
        hit = np.arange(k)[None, :, None] == far.argmin(axis=1)[:, None]
    total += (hit.reshape(runs * k, n).astype("float64") @ x).reshape(total.shape)
    return least


def _step(points: DataFrame, blocks: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(sums, sizes, cost) of the points by nearest centre, for every candidate, from one scan. Ties go to the first centre."""
    width = blocks[0].shape[1]
    centres = np.concatenate(blocks)
    lengths, twice = (centres**2).sum(axis=1), -2.0 * centres
    ends = np.cumsum([len(b) for b in blocks])
    alike = [len(list(own)) for _, own in groupby(blocks, key=len)]  # candidates in a row with as many centres
    cuts = np.concatenate([[0], ends[np.cumsum(alike) - 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, costs = np.zeros((len(centres), width + 1)), np.zeros(len(centres))
        for x in _points(batches, width, len(centres)):
            far, own = twice @ x.T, (x * x).sum(axis=1)  # a line of points per centre, so that the least are found line by line
            far += lengths[:, None]
            counted = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            for a, b, m in zip(cuts[:-1], cuts[1:], alike, strict=True):
                k = (b - a) // m
                least = _add(counted, far[a:b].reshape(m, k, len(x)), total[a:b].reshape(m, k, width + 1))
                costs[a:b:k] += np.maximum(least + own, 0).sum(axis=1)  # a candidate's cost stands at its first centre
        sums = np.ascontiguousarray(total[:, :width])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(centres))), pa.array(np.rint(total[:, width]).astype(np.int64)), pa.array(costs),
             pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, width).astype(np.int32)), pa.array(sums.ravel()))],
            names=["centre", "n", "cost", "s"],
        )

    parts = packed(points).mapInArrow(run, "centre long, n long, cost double, s array<double>")
    rows = parts.groupBy("centre").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.get("s", F.lit(j))) for j in range(width)]).alias("s")
    ).collect()  # one row per centre
    rows.sort(key=lambda r: r["centre"])
    sums, sizes, costs = np.array([r["s"] for r in rows]), np.array([r["n"] for r in rows]), np.array([r["cost"] for r in rows])
    return [(sums[a:b], sizes[a:b], float(costs[a:b].sum())) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def fit_together(points: DataFrame, starts: Sequence[np.ndarray], limits: Sequence[int] | None = None, tolerance: float = TOLERANCE) -> list[Fit]:
    """Lloyd's iterations from every start, over the array column ``x`` or its ``packed`` blocks. A centre that no point is nearest to stays where it is;
    a candidate has settled when the squared moves of its centres add up to at most ``tolerance``, or after its limit."""
    limits = list(limits) if limits is not None else [MAX_ITERATIONS] * len(starts)
    now = [np.array(s, dtype="float64") for s in starts]
    fits: list[Fit | None] = [None] * len(now)
    active = list(range(len(now)))
    for done in range(1, max(limits, default=0) + 1):
        if not active:
            break
        going = []
        for i, (sums, sizes, cost) in zip(active, _step(points, [now[i] for i in active]), strict=True):
            moved = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], now[i])
            shift = float(((moved - now[i]) ** 2).sum())
            now[i] = moved
            fits[i] = Fit(moved, cost, done)
            if shift > tolerance and done < limits[i]:
                going.append(i)
        active = going
    return [f if f is not None else Fit(c, float("nan"), 0) for f, c in zip(fits, now)]


def _nearest_cost(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(_distances(x, centres, (centres**2).sum(axis=1)).min(axis=1) + (x * x).sum(axis=1), 0)


def start_pool(
    points: DataFrame, width: int, most_clusters: int, seed: int, rounds: int = POOL_ROUNDS, blocks: DataFrame | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(points, weights): some dozens of points spread over the table, each with the number of rows nearest to it. ``blocks`` are the
    ``packed`` points, if they are at hand.

    A row is drawn with a chance in proportion to its squared distance to those drawn before; equal points that a task draws leave
    it once, so groups of copies are never gathered.
    """
    first = points.orderBy(F.xxhash64("x", F.lit(seed)), "x").select("x").first()
    pool = np.array([first["x"]], dtype="float64")
    blocks = packed(points) if blocks is None else blocks
    wanted = POOL_PER_CLUSTER * most_clusters
    for r in range(rounds):
        cost = _step(blocks, [pool])[0][2]
        if cost <= 0:
            break
        drawn_from = pool

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rng, kept = np.random.default_rng([seed, r, TaskContext.get().partitionId()]), []
            for x in _points(batches, width, len(drawn_from)):
                hit = rng.random(len(x)) < wanted * _nearest_cost(x, drawn_from) / cost
                kept.append(np.unique(x[hit], axis=0))
            found = np.unique(np.concatenate(kept), axis=0) if kept else np.empty((0, width))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, width).astype(np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([lists], names=["x"])

        rows = blocks.mapInArrow(draw, "x array<double>").distinct().collect()  # about ``wanted`` different points
        if rows:
            pool = np.unique(np.concatenate([pool, np.array([r["x"] for r in rows], dtype="float64")]), axis=0)
    weights = _step(blocks, [pool])[0][1].astype("float64")
    return pool[weights > 0], weights[weights > 0]


def starts_from_pool(pool: np.ndarray, weights: np.ndarray, k: int, seed: int, polish: int = 100) -> np.ndarray:
    """k starting centres: weighted k-means++ over the pool, then weighted moves within it until they settle."""
    rng = np.random.default_rng([seed, k])
    picked = [pool[rng.choice(len(pool), p=weights / weights.sum())]]
    while len(picked) < k:
        chance = weights * _nearest_cost(pool, np.array(picked))
        if chance.sum() <= 0:  # fewer different points than clusters
            picked.append(pool[len(picked) % len(pool)])
            continue
        picked.append(pool[rng.choice(len(pool), p=chance / chance.sum())])
    centres = np.array(picked)
    for _ in range(polish):
        at = _distances(pool, centres, (centres**2).sum(axis=1)).argmin(axis=1)
        mass = np.bincount(at, weights=weights, minlength=k)
        sums = np.stack([np.bincount(at, weights=weights * pool[:, j], minlength=k) for j in range(pool.shape[1])], axis=1)
        moved = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def with_labels(points: DataFrame, fits: dict[str, np.ndarray]) -> DataFrame:
    """The table with an int column per name: the nearest centre of the array column ``x``, the first on ties."""
    names = list(fits)
    blocks = [fits[n] for n in names]
    width = blocks[0].shape[1]
    centres = np.concatenate(blocks)
    lengths = (centres**2).sum(axis=1)
    ends = np.cumsum([len(b) for b in blocks])
    place = points.columns.index("x")
    schema = T.StructType(list(points.schema.fields))
    for n in names:
        schema = schema.add(n, T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(place).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            far = _distances(x, centres, lengths)
            labels = [pa.array(far[:, a:b].argmin(axis=1).astype(np.int32)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *labels], names=[*batch.schema.names, *names])

    return points.mapInArrow(run, schema)
