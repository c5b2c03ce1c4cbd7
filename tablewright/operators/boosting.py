"""Second-order gradient boosting on binned features.

One model for any number of classes (softmax), two classes (logistic) or numbers (squares): a round fits one tree per raw score to
the gradients and hessians of the loss. A level of all trees of a round is one scan: every task adds up gradients, hessians and
rows per node and feature bin, Spark adds up the tasks' sums by cell, and the driver picks the splits from at most
nodes x bins cells. Features are cut at their quantiles once. The rows lie in blocks of one table row each, with one byte per feature
and value, so a scan moves a few buffers instead of rows. The raw scores are renewed in the first scan of every round, so a scan walks
through the trees of its own round alone; every few rounds the blocks are written, which keeps the lineage short.

A cell's bin is the number of cut points below the value, and a split sends values up to its cut point left. Features with at
most ``bins`` different frequent values are cut exactly between them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.session import materialised

SOFTMAX, LOGISTIC, SQUARES = "softmax", "logistic", "squares"
BINS = 64
QUANTILE_ACCURACY = 10_000
RENEW_ROUNDS = 10  # the scores are written anew after so many
TASK_VALUES = 4_000_000  # a table of at most so many values is fitted by one task
LEAST_HESSIAN = 1.0
LEAST_GAIN = 1e-9


@dataclass
class Tree:
    """A binary tree in heap order: the children of node i are 2i + 1 and 2i + 2. ``feature`` is -1 in leaves."""

    feature: np.ndarray
    cut: np.ndarray  # the last bin that goes left
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n))

    def node_of(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after ``levels`` steps; a leaf keeps its rows."""
        at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[at]
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.node_of(bins, (len(self.feature)).bit_length() - 1)]


@dataclass
class Model:
    loss: str
    outputs: int
    start: float
    cuts: list[np.ndarray]
    rounds: list[list[Tree]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def raw(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """Raw scores from the rounds after ``first``, without the start."""
        out = np.zeros((len(bins), self.outputs))
        for trees in self.rounds[first:]:
            for k, tree in enumerate(trees):
                out[:, k] += tree.scores(bins)
        return out

    def predicted(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities, or numbers in one column."""
        raw = self.start + self.raw(self.binned(x))
        if self.loss == SQUARES:
            return raw
        if self.loss == LOGISTIC:
            p = 1 / (1 + np.exp(-raw[:, 0]))
            return np.stack([1 - p, p], axis=1)
        return softmax(raw)

    def importances(self) -> np.ndarray:
        """The gains of each feature's splits."""
        out = np.zeros(len(self.cuts))
        for trees in self.rounds:
            for tree in trees:
                used = tree.feature >= 0
                np.add.at(out, tree.feature[used], tree.gain[used])
        return out


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(loss: str, y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by each raw score."""
    if loss == SQUARES:
        return raw - y[:, None], np.ones_like(raw)
    if loss == LOGISTIC:
        p = 1 / (1 + np.exp(-raw))
        return p - y[:, None], p * (1 - p)
    p = softmax(raw)
    g = p.copy()
    g[np.arange(len(y)), y.astype(np.int64)] -= 1
    return g, p * (1 - p)


def quantile_cuts(rows: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """At most ``bins`` - 1 cut points per place of the array column ``x``, from mergeable quantile summaries."""
    shares = [i / bins for i in range(1, bins)]
    out = []
    for at in range(0, width, 64):  # summaries of some dozens of features in one scan
        part = range(at, min(at + 64, width))
        asked = [F.percentile_approx(F.get("x", F.lit(j)), shares, QUANTILE_ACCURACY).alias(f"q{j}") for j in part]
        found = rows.agg(*asked, *[F.max(F.get("x", F.lit(j))).alias(f"m{j}") for j in part]).first()
        for j in part:
            values = np.unique(np.array(found[f"q{j}"] or [], dtype="float64"))
            out.append(values[values < found[f"m{j}"]] if len(values) else values)
    return out


_BLOCKS = "n int, bins binary, y binary, raw binary"


def _blocks(batch: pa.RecordBatch, width: int, outputs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bins, y, raw) of every block; a block's bins lie feature by feature."""
    for n, bins, y, raw in zip(*(c.to_pylist() if c.type == pa.int32() else c for c in batch.columns), strict=True):
        codes = np.frombuffer(bins.as_buffer(), dtype=np.uint8).reshape(width, n).T
        yield codes, np.frombuffer(y.as_buffer()), np.frombuffer(raw.as_buffer()).reshape(n, outputs)


def _block(bins: np.ndarray, y: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
    parts = (np.asfortranarray(bins).tobytes(order="F"), y.astype("float64").tobytes(), raw.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *[pa.array([x], pa.binary()) for x in parts]], names=["n", "bins", "y", "raw"])


def _prepared(rows: DataFrame, model: Model) -> DataFrame:
    """The rows in blocks of one Arrow batch each."""
    width = len(model.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                yield _block(model.binned(x), y, np.full((batch.num_rows, model.outputs), model.start))

    return rows.select("x", F.col("y").cast("double").alias("y")).mapInArrow(run, _BLOCKS)


def _renewed(table: DataFrame, model: Model, first: int) -> DataFrame:
    width = len(model.cuts)
    model = replace(model, rounds=model.rounds[first:])  # earlier trees are in the scores already

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bins, y, raw in _blocks(batch, width, model.outputs):
                yield _block(bins, y, raw + model.raw(bins))

    return table.mapInArrow(run, _BLOCKS)


def _begins(model: Model) -> np.ndarray:
    """The first cell of every feature, and the number of cells."""
    return np.cumsum([0, *[len(c) + 1 for c in model.cuts]])


def _add_cells(total: np.ndarray, bins: np.ndarray, g: np.ndarray, h: np.ndarray, trees: Sequence[Tree], level: int, begin: np.ndarray) -> None:
    """Adds gradients, hessians and rows of some rows up by output, node of the level and cell."""
    nodes = 2**level
    for k, tree in enumerate(trees):
        node = tree.node_of(bins, level) - (nodes - 1)
        live = np.flatnonzero(node >= 0)  # rows of leaves above this level take no part
        part = slice(None) if len(live) == len(node) else live
        own, gs, hs = node[part], np.ascontiguousarray(g[part, k]), np.ascontiguousarray(h[part, k])
        for j in range(bins.shape[1]):
            size = int(begin[j + 1] - begin[j])
            cell = own * size + bins[part, j]
            for what, weights in enumerate((gs, hs, None)):
                sums = np.bincount(cell, weights=weights, minlength=nodes * size)
                total[k, :, begin[j] : begin[j + 1], what] += sums.reshape(nodes, size)


def _fit_in_task(table: DataFrame, model: Model, rounds: int, depth: int, rate: float, ridge: float) -> Model:
    """All rounds over a table that fits a task, level by level as over a larger one, without a job for each."""
    width, begin = len(model.cuts), _begins(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [(bins, y, raw.copy()) for batch in batches for bins, y, raw in _blocks(batch, width, model.outputs)]
        for done in range(rounds):
            trees, slopes = [Tree.empty(depth) for _ in range(model.outputs)], [gradients(model.loss, y, raw) for _, y, raw in blocks]
            for level in range(depth):
                sums = np.zeros((model.outputs, 2**level, int(begin[-1]), 3))
                for (bins, _, _), (g, h) in zip(blocks, slopes, strict=True):
                    _add_cells(sums, bins, g, h, trees, level, begin)
                if not _grow(trees, sums, level, begin, rate, ridge):
                    break
            for bins, _, raw in blocks:
                for k, tree in enumerate(trees):
                    raw[:, k] += tree.scores(bins)
            for tree in trees:
                values = [pa.array([done], pa.int32()), *[pa.array([v.astype("float64").tolist()]) for v in (tree.feature, tree.cut, tree.value, tree.gain)]]
                yield pa.RecordBatch.from_arrays(values, names=["round", "feature", "cut", "value", "gain"])

    lists = ", ".join(f"{c} array<double>" for c in ("feature", "cut", "value", "gain"))
    for r in table.coalesce(1).mapInArrow(run, f"round int, {lists}").collect():  # in order: one task makes them all
        tree = Tree(np.array(r["feature"], dtype=np.int64), np.array(r["cut"], dtype=np.int64), np.array(r["value"]), np.array(r["gain"]))
        model.rounds += [[]] * (r["round"] == len(model.rounds))
        model.rounds[r["round"]] = [*model.rounds[r["round"]], tree]
    return model


def _histogram(table: DataFrame, model: Model, trees: Sequence[Tree], level: int) -> np.ndarray:
    """(outputs, nodes of the level, cells, 3): gradients, hessians and rows of every cell; the cells of a feature lie together."""
    width, loss, outputs, begin = len(model.cuts), model.loss, model.outputs, _begins(model)
    nodes, cells = 2**level, int(begin[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((outputs, nodes, cells, 3))
        for batch in batches:
            for bins, y, raw in _blocks(batch, width, outputs):
                _add_cells(total, bins, *gradients(loss, y, raw), trees, level, begin)
        flat = total.reshape(-1, 3)
        used = np.flatnonzero(flat[:, 2])
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(flat[used, i]) for i in range(3)]], names=["cell", "g", "h", "n"])

    parts = table.mapInArrow(run, "cell long, g double, h double, n double")
    sums = parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()  # at most one row per cell
    out = np.zeros((model.outputs * nodes * cells, 3))
    out[sums.column("cell").to_numpy()] = np.stack([sums.column(c).to_numpy() for c in "ghn"], axis=1)
    return out.reshape(model.outputs, nodes, cells, 3)


def best_split(sums: np.ndarray, begin: np.ndarray, ridge: float) -> tuple[float, int, int, np.ndarray]:
    """(gain, feature, cut, sums of the left side) of one node; the first of equal gains. Gain 0 means no split."""
    total = sums[begin[0] : begin[1]].sum(axis=0)
    running = np.cumsum(sums, axis=0)
    base = np.repeat(np.concatenate([np.zeros((1, 3)), running[begin[1:-1] - 1]]), np.diff(begin), axis=0)
    left = running - base
    right = total - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + ridge)
    gain = 0.5 * (score(left) + score(right) - score(total))
    allowed = (left[:, 2] > 0.5) & (right[:, 2] > 0.5) & (np.minimum(left[:, 1], right[:, 1]) >= LEAST_HESSIAN)
    gain = np.where(allowed, gain, 0.0)
    at = int(np.argmax(gain >= gain.max() * (1 - 1e-12)))
    feature = int(np.searchsorted(begin, at, side="right")) - 1
    return float(gain[at]), feature, at - int(begin[feature]), left[at]


def fit(rows: DataFrame, width: int, loss: str, classes: int = 2, rounds: int = 50, depth: int = 5, rate: float = 0.1, ridge: float = 1.0,
        bins: int = BINS) -> Model:
    """A model of the array column ``x`` for the column ``y``: numbers, or class codes 0, 1, ..."""
    whole = rows.agg(F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n")).first()
    start = whole["mean"] or 0.0 if loss == SQUARES else 0.0
    model = Model(loss, classes if loss == SOFTMAX else 1, float(start), quantile_cuts(rows, width, bins))
    if whole["n"] * width <= TASK_VALUES:
        return _fit_in_task(_prepared(rows, model), model, rounds, depth, rate, ridge)
    begin = _begins(model)
    table, kept = _prepared(rows, model).persist(StorageLevel.MEMORY_AND_DISK), None
    try:
        for done in range(rounds):
            if done:
                kept, table = table, _renewed(table, model, done - 1)
                table = (materialised(table) if done % RENEW_ROUNDS == 0 else table).persist(StorageLevel.MEMORY_AND_DISK)
            trees = [Tree.empty(depth) for _ in range(model.outputs)]
            for level in range(depth):
                sums = _histogram(table, model, trees, level)
                if kept is not None:  # the first scan has filled the new table
                    kept.unpersist()
                    kept = None
                if not _grow(trees, sums, level, begin, rate, ridge):
                    break
            model.rounds.append(trees)
    finally:
        table.unpersist()
        if kept is not None:
            kept.unpersist()
    return model


def _grow(trees: Sequence[Tree], sums: np.ndarray, level: int, begin: np.ndarray, rate: float, ridge: float) -> bool:
    """Splits the nodes of one level and sets their children's values; whether any was split."""
    grown = False
    for k, tree in enumerate(trees):
        for n in range(2**level):
            node = 2**level - 1 + n
            total = sums[k, n, begin[0] : begin[1]].sum(axis=0)
            if total[2] < 0.5:
                continue
            if level == 0:
                tree.value[0] = -rate * total[0] / (total[1] + ridge)
            gain, feature, cut, left = best_split(sums[k, n], begin, ridge)
            if gain <= LEAST_GAIN:
                continue
            grown = True
            tree.feature[node], tree.cut[node], tree.gain[node] = feature, cut, gain
            for child, part in ((2 * node + 1, left), (2 * node + 2, total - left)):
                tree.value[child] = -rate * part[0] / (part[1] + ridge)
    return grown


def prediction(model: Model, x: Column) -> Column:
    """The model's probabilities, or its number in a list of one, as an array column."""

    @F.pandas_udf("array<double>")
    def apply(values):
        import pandas as pd

        if not len(values):
            return pd.Series([], dtype="object")
        return pd.Series(list(model.predicted(np.stack(values.to_numpy()).astype("float64"))))

    return apply(x)
