"""Feed-forward networks trained over all rows.

The rows lie in blocks of one table row each, so a scan moves a few buffers instead of rows. Every evaluation is one scan: a task runs
its blocks forward and back and emits the sums of loss and gradient, Spark adds them up by parameter, and the driver, which holds the parameters alone, takes a quasi-Newton step (L-BFGS with backtracking). A share of
the rows, chosen by a hash of their key, is held out of the gradient; training ends when its loss has not improved for
``PATIENCE`` steps, and the parameters of the best step are kept.
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

SOFTMAX, SQUARES = "softmax", "squares"
HELD_SHARE = 10  # one row of so many is held out
PATIENCE = 10
TOLERANCE = 1e-4
PENALTY = 1e-4
MEMORY = 10
LEAST_STEP = 2.0**-10
TASK_VALUES = 4_000_000  # a table of at most so many values is trained on by one task
CHUNK = 1_024  # rows whose layers fit a core's cache
TOTALS = 4  # loss and rows of the gradient's part, loss and rows of the held-out part


@dataclass(frozen=True)
class Network:
    sizes: tuple[int, ...]
    loss: str
    parameters: np.ndarray
    centre: float = 0.0
    scale: float = 1.0
    losses: tuple[float, ...] = ()  # of the held-out rows, step by step

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities, or numbers in one column."""
        last = forward(layers(self.parameters, self.sizes), x)[-1]
        return probabilities(last) if self.loss == SOFTMAX else self.centre + self.scale * last


def layers(parameters: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((parameters[at : at + a * b].reshape(a, b), parameters[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def start(sizes: Sequence[int], seed: int) -> np.ndarray:
    rng, out = np.random.default_rng(seed), []
    for a, b in zip(sizes, sizes[1:]):
        bound = np.sqrt(6.0 / (a + b))
        out += [rng.uniform(-bound, bound, a * b), np.zeros(b)]
    return np.concatenate(out)


def forward(net: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    """The input and every layer's values; rectified but for the last."""
    values = [x]
    for k, (weights, shift) in enumerate(net):
        z = values[-1] @ weights + shift
        values.append(z if k == len(net) - 1 else np.maximum(z, 0))
    return values


def probabilities(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def row_losses(last: np.ndarray, loss: str, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The loss of each row, and its derivative by the last layer's values."""
    if loss == SOFTMAX:
        p, at = probabilities(last), (np.arange(len(y)), y.astype(np.int64))
        losses = -np.log(np.maximum(p[at], 1e-300))
        p[at] -= 1
        return losses, p
    error = last - y[:, None]
    return 0.5 * (error**2).sum(axis=1), error


def loss_and_gradient(parameters: np.ndarray, sizes: Sequence[int], loss: str, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The loss of each row, and the gradient of their sum."""
    net = layers(parameters, sizes)
    values = forward(net, x)
    losses, error = row_losses(values[-1], loss, y)
    parts = []
    for k in range(len(net) - 1, -1, -1):
        parts += [error.sum(axis=0), (values[k].T @ error).ravel()]
        if k:
            error = (error @ net[k][0].T) * (values[k] > 0)
    return losses, np.concatenate(parts[::-1])


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """The rows (x, y, held) in blocks of one Arrow batch each, the ``m`` rows of the gradient's part first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                y, held = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
                order = np.argsort(held, kind="stable")
                parts = [x[order].astype("float64").tobytes(), y[order].astype("float64").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([int((~held).sum())], pa.int32()), *[pa.array([v], pa.binary()) for v in parts]], names=["m", "x", "y"])

    return rows.select("x", "y", "held").mapInArrow(run, "m int, x binary, y binary")


def _arrays(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, x, y) of every block."""
    for m, xs, ys in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
        y = np.frombuffer(ys.as_buffer())
        yield m, np.frombuffer(xs.as_buffer()).reshape(len(y), width), y


def _add_sums(sums: np.ndarray, m: int, x: np.ndarray, y: np.ndarray, parameters: np.ndarray, sizes: Sequence[int], loss: str) -> None:
    """Adds a block's losses, rows and gradient up. Held-out rows only go forward."""
    for i in range(0, m, CHUNK):
        end = min(i + CHUNK, m)
        losses, gradient = loss_and_gradient(parameters, sizes, loss, x[i:end], y[i:end])
        sums[:2] += losses.sum(), len(losses)
        sums[TOTALS:] += gradient
    for i in range(m, len(y), CHUNK):
        losses = row_losses(forward(layers(parameters, sizes), x[i : i + CHUNK])[-1], loss, y[i : i + CHUNK])[0]
        sums[2:4] += losses.sum(), len(losses)


def _totals(sums: np.ndarray, parameters: np.ndarray) -> tuple[float, np.ndarray, float]:
    n = max(sums[1], 1.0)
    value = sums[0] / n + 0.5 * PENALTY * float(parameters @ parameters) / n
    return value, (sums[TOTALS:] + PENALTY * parameters) / n, sums[2] / sums[3] if sums[3] else value


def _evaluate(rows: DataFrame, parameters: np.ndarray, sizes: Sequence[int], loss: str) -> tuple[float, np.ndarray, float]:
    """(mean loss with the penalty, its gradient, mean loss of the held-out rows) of the rows (x, y, held)."""
    return _evaluate_blocks(_blocks(rows, sizes[0]), parameters, sizes, loss)


def _evaluate_blocks(table: DataFrame, parameters: np.ndarray, sizes: Sequence[int], loss: str) -> tuple[float, np.ndarray, float]:
    """The same from one scan of blocks."""
    n_parameters = len(parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(TOTALS + n_parameters)
        for batch in batches:
            for m, x, y in _arrays(batch, sizes[0]):
                _add_sums(sums, m, x, y, parameters, sizes, loss)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["place", "value"])

    found = table.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    sums = np.zeros(TOTALS + n_parameters)
    sums[found.column("place").to_numpy()] = found.column("value").to_numpy()
    return _totals(sums, parameters)


def quasi_newton(gradient: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton direction from the last steps and changes of the gradient."""
    q, shares = gradient.copy(), []
    for s, y in reversed(pairs):
        a = (s @ q) / (y @ s)
        q -= a * y
        shares.append(a)
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(shares)):
        q += s * (a - (y @ q) / (y @ s))
    return -q


def fit(rows: DataFrame, width: int, loss: str, outputs: int, key: Column, hidden: Sequence[int] = (32, 16), steps: int = 150, seed: int = 42) -> Network:
    """A network of the array column ``x`` for the column ``y``: class codes 0, 1, ..., or numbers, which are scaled."""
    sizes = (width, *hidden, outputs if loss == SOFTMAX else 1)
    centre, scale = 0.0, 1.0
    moments = rows.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"), F.count(F.lit(1)).alias("n")).first()
    if loss == SQUARES:
        centre, scale = moments["m"] or 0.0, moments["s"] or 1.0
    held = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(HELD_SHARE)) == 0
    table = rows.select("x", ((F.col("y") - F.lit(centre)) / F.lit(scale)).cast("double").alias("y"), held.alias("held"))
    table = _blocks(table, width)
    if moments["n"] * width <= TASK_VALUES:
        best, losses = _train_in_task(table, sizes, loss, steps, seed)
    else:
        table = table.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            best, losses = _train(lambda parameters: _evaluate_blocks(table, parameters, sizes, loss), sizes, steps, seed)
        finally:
            table.unpersist()
    return Network(sizes, loss, best, float(centre), float(scale), tuple(losses))


def _train_in_task(table: DataFrame, sizes: Sequence[int], loss: str, steps: int, seed: int) -> tuple[np.ndarray, list[float]]:
    """The same steps over blocks that fit a task, without a job for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [block for batch in batches for block in _arrays(batch, sizes[0])]

        def evaluate(parameters: np.ndarray) -> tuple[float, np.ndarray, float]:
            sums = np.zeros(TOTALS + len(parameters))
            for block in blocks:
                _add_sums(sums, *block, parameters, sizes, loss)
            return _totals(sums, parameters)

        best, losses = _train(evaluate, sizes, steps, seed)
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.float64())) for v in (best.tolist(), losses)], names=["best", "losses"])

    found = table.coalesce(1).mapInArrow(run, "best array<double>, losses array<double>").first()
    return np.array(found["best"]), [float(v) for v in found["losses"]]


def _train(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray, float]], sizes: Sequence[int], steps: int, seed: int) -> tuple[np.ndarray, list[float]]:
    """The parameters of the best step, and the losses of the held-out rows step by step."""
    now = start(sizes, seed)
    value, gradient, apart = evaluate(now)
    best, best_loss, waited, losses = now, apart, 0, [apart]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way = quasi_newton(gradient, pairs)
        slope = float(way @ gradient)
        if slope >= 0:
            pairs, way, slope = [], -gradient, -float(gradient @ gradient)
        step = 1.0 if pairs else min(1.0, 1.0 / max(np.abs(gradient).sum(), 1e-12))
        while True:
            after = now + step * way
            new_value, new_gradient, apart = evaluate(after)
            if new_value <= value + 1e-4 * step * slope or step < LEAST_STEP:
                break
            step /= 2
        if new_value >= value:
            break
        s, y = after - now, new_gradient - gradient
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-MEMORY:]
        now, value, gradient = after, new_value, new_gradient
        losses.append(apart)
        waited = 0 if apart < best_loss - TOLERANCE * abs(best_loss) else waited + 1
        if apart < best_loss:
            best, best_loss = now, apart
        if waited >= PATIENCE:
            break
    return best, losses


def prediction(model: Network, x: Column) -> Column:
    """The network's outputs as an array column."""

    @F.pandas_udf("array<double>")
    def apply(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype="object")
        return pd.Series(list(model.outputs(np.stack(values.to_numpy()).astype("float64"))))

    return apply(x)
