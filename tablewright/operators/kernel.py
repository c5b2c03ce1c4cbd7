"""A radial kernel by landmarks: features whose inner products approximate exp(-gamma |x - y|^2).

The landmarks are rows of the table, those with the smallest hashes of their keys. Their kernel block is whitened, so among landmarks the
features give the kernel exactly; ``error`` measures what is lost on other rows.

A machine on these features never stores them: the rows lie in blocks of one table row each, and every evaluation of the hinge loss computes
the kernel with the landmarks anew. The driver holds a weight per feature and takes the quasi-Newton steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.network import quasi_newton

MEMORY, TOLERANCE, LEAST_STEP, SEARCHES = 10, 1e-6, 1e-10, 20
CHUNK = 1_024  # rows held against the landmarks at once
LEAST_SHARE = 1e-10  # eigenvalues below this share of the largest are left out


@dataclass(frozen=True)
class KernelMap:
    landmarks: np.ndarray
    whitening: np.ndarray
    gamma: float

    def features(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, self.landmarks, self.gamma) @ self.whitening

    def column(self, x: Column) -> Column:
        """The features of an array column, one matrix product per Arrow batch."""

        @F.pandas_udf("array<double>")
        def mapped(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype="object")
            return pd.Series(list(self.features(np.stack(values.to_numpy()).astype("float64"))))

        return mapped(x)

    def margins(self, x: Column, machines: Sequence[tuple[np.ndarray, float]]) -> Column:
        """The margin of each machine (weights, shift) as an array column."""
        weights, shifts = self.whitening @ np.stack([w for w, _ in machines], axis=1), np.array([b for _, b in machines])

        @F.pandas_udf("array<double>")
        def found(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype="object")
            return pd.Series(list(kernel(np.stack(values.to_numpy()).astype("float64"), self.landmarks, self.gamma) @ weights + shifts))

        return found(x)

    def error(self, x: np.ndarray) -> float:
        """The relative error (Frobenius) of the approximate kernel matrix of some rows."""
        exact, z = kernel(x, x, self.gamma), self.features(x)
        return float(np.linalg.norm(exact - z @ z.T) / np.linalg.norm(exact))


def kernel(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    own, others = np.ones((len(x), 1)), np.ones((len(y), 1))
    left = np.concatenate([x, (x**2).sum(axis=1)[:, None], own], axis=1)
    right = np.concatenate([2 * y, -others, -(y**2).sum(axis=1)[:, None]], axis=1) * gamma
    out = left @ right.T  # the lengths are part of the one product
    return np.exp(np.minimum(out, 0, out=out), out=out)


def sample(rows: DataFrame, key: Column, size: int, seed: int) -> np.ndarray:
    """The array column ``x`` of the ``size`` rows with the smallest hashes of the key."""
    found = rows.select("x", F.xxhash64(key, F.lit(seed)).alias("h")).orderBy("h", "x").limit(size).collect()
    return np.array([r["x"] for r in found], dtype="float64")


def fit(rows: DataFrame, key: Column, gamma: float, landmarks: int, seed: int) -> KernelMap:
    """The map of at most ``landmarks`` different rows of the array column ``x``."""
    points = np.unique(sample(rows, key, landmarks, seed), axis=0)
    values, vectors = np.linalg.eigh(kernel(points, points, gamma))
    keep = values > LEAST_SHARE * values.max()
    return KernelMap(points, vectors[:, keep] / np.sqrt(values[keep]), gamma)


def _blocks(rows: DataFrame) -> DataFrame:
    """The rows (x, y) in blocks of one Arrow batch each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = (batch.column(0).flatten(), batch.column(1))
                buffers = [np.ascontiguousarray(p.to_numpy(zero_copy_only=False), dtype="float64").tobytes() for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in buffers], names=["x", "y"])

    return rows.select("x", F.col("y").cast("double").alias("y")).mapInArrow(run, "x binary, y binary")


def _added(table: DataFrame, landmarks: KernelMap, size: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The ``size`` sums that ``add(sums, kernel with the landmarks, y)`` makes of all rows, a few rows at a time."""
    width = landmarks.landmarks.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for batch in batches:
            for xs, ys in zip(batch.column(0), batch.column(1), strict=True):
                y = np.frombuffer(ys.as_buffer())
                x = np.frombuffer(xs.as_buffer()).reshape(len(y), width)
                for i in range(0, len(y), CHUNK):
                    add(sums, kernel(x[i : i + CHUNK], landmarks.landmarks, landmarks.gamma), y[i : i + CHUNK])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(sums)], names=["place", "value"])

    found = table.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[found.column("place").to_numpy()] = found.column("value").to_numpy()
    return out


def machines(rows: DataFrame, landmarks: KernelMap, classes: Sequence[int], steps: int, penalty: float) -> list[tuple[np.ndarray, float]]:
    """(weights of the features, shift) of a linear machine per class of (x, y): mean hinge loss of that class against the others, with half the
    penalty times the squared weights of the features scaled to unit deviation."""
    white, width = landmarks.whitening, landmarks.whitening.shape[1]
    near = landmarks.features(landmarks.landmarks).mean(axis=0)  # sums of squares around it lose no digits

    def moments(sums: np.ndarray, k: np.ndarray, y: np.ndarray) -> None:
        z = k @ white - near
        sums[0] += len(z)
        sums[1 : width + 1] += z.sum(axis=0)
        sums[width + 1 :] += (z * z).sum(axis=0)

    table = _blocks(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sums = _added(table, landmarks, 2 * width + 1, moments)
        n = max(sums[0], 1.0)
        mean = sums[1 : width + 1] / n
        deviation = np.sqrt(np.maximum(sums[width + 1 :] / n - mean**2, 0) * n / max(n - 1, 1))
        scale, mean = np.divide(1.0, deviation, out=np.zeros(width), where=deviation > 0), mean + near
        out = []
        for c in classes:

            def evaluate(at: np.ndarray, c: int = c) -> tuple[float, np.ndarray]:
                own = scale * at[:-1]
                weights, shift = white @ own, at[-1] - mean @ own

                def hinge(sums: np.ndarray, k: np.ndarray, y: np.ndarray) -> None:
                    side = np.where(y == c, 1.0, -1.0)
                    loss = 1 - side * (k @ weights + shift)
                    side[loss <= 0] = 0.0
                    sums[0] += loss[loss > 0].sum()
                    sums[1] -= side.sum()
                    sums[2:] -= k.T @ side

                sums = _added(table, landmarks, 2 + len(white), hinge) / n
                slopes = scale * (white.T @ sums[2:] - mean * sums[1]) + penalty * at[:-1]
                return sums[0] + 0.5 * penalty * float(at[:-1] @ at[:-1]), np.append(slopes, sums[1])

            found = minimise(evaluate, np.zeros(width + 1), steps)
            out.append((scale * found[:-1], float(found[-1] - mean @ (scale * found[:-1]))))
        return out
    finally:
        table.unpersist()


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, steps: int) -> np.ndarray:
    """At most ``steps`` quasi-Newton steps (L-BFGS), each of a length that meets both Wolfe conditions."""
    value, gradient = evaluate(at)
    first, values, pairs = value, [value], []
    for step in range(steps):
        if np.linalg.norm(gradient) <= max(TOLERANCE * value, 1e-8) or (step and abs(value - max(values)) <= TOLERANCE * first):
            break
        found = _line(evaluate, at, value, gradient, quasi_newton(gradient, pairs), step == 0)
        if found is None and pairs:  # once more, straight down
            pairs, found = [], _line(evaluate, at, value, gradient, -gradient, True)
        if found is None:
            break
        after, value, new = found
        pairs = [*pairs, (after - at, new - gradient)][-MEMORY:] if (after - at) @ (new - gradient) > 0 else pairs
        at, gradient, values = after, new, [*values, value][-20:]
    return at


def _line(evaluate: Callable, at: np.ndarray, value: float, gradient: np.ndarray, way: np.ndarray, first: bool) -> tuple[np.ndarray, float, np.ndarray] | None:
    slope = float(way @ gradient)
    length = 0.5 / np.linalg.norm(gradient) if first else 1.0
    best = None
    for _ in range(SEARCHES):
        after = at + length * way
        now, new = evaluate(after)
        along = float(new @ way)
        if now < value and (best is None or now < best[1]):
            best = after, now, new
        if now > value + 1e-4 * length * slope or along > -0.9 * slope:
            length *= 0.1 if first else 0.5
        elif along < 0.9 * slope:
            length *= 2.1
        else:
            return after, now, new
        if length < LEAST_STEP:
            break
    return best
