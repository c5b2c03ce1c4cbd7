"""Agglomerative clustering of rows by rounds of reciprocal nearest neighbours.

Two clusters that are each other's nearest are merged whatever else is going on: for ward, complete and average linkage a
merge never brings a third cluster closer, so the merges of all rounds, put in order of their heights, are those of the
one-at-a-time procedure. For the same reason a cluster has to look for its nearest again only when it or its nearest was merged.

While more than ``TABLE_CLUSTERS`` clusters are left, a round holds the rows of those clusters against all rows, in blocks of whole
clusters, and passes on the nearest of every such cluster alone: time is quadratic in the rows, as the method is, memory is not. The
last clusters' distances are one matrix in one task. Rows that share an id are one cluster from the start.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.distances import squares_to
from tablewright.session import local_table, materialised

TABLE_CLUSTERS = 7_000  # a full matrix of 392 MB in one task
TILE_ROWS, LEAST_TILES, CHUNK_ROWS = 4_000, 16, 64
BLOCK_ROWS = 500
WARD, COMPLETE, AVERAGE = "ward", "complete", "average"


@dataclass(frozen=True)
class Dendrogram:
    """``merges``: u, v (a cluster is named by its smallest row) and the height of every merge, in ascending order of height."""

    ids: np.ndarray
    merges: list[tuple[int, int, float]]

    def labels(self, k: int) -> dict[int, int]:
        """Row to cluster (0, 1, ... by smallest row) when k clusters are left."""
        owner = {int(i): int(i) for i in self.ids}

        def root(i: int) -> int:
            while owner[i] != i:
                owner[i] = owner[owner[i]]
                i = owner[i]
            return i

        for u, v, _ in self.merges[: max(0, len(self.ids) - k)]:
            a, b = root(u), root(v)
            owner[max(a, b)] = min(a, b)
        roots = {i: root(i) for i in owner}
        names = {r: n for n, r in enumerate(sorted(set(roots.values())))}
        return {i: names[r] for i, r in roots.items()}

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(n, *m) for n, m in enumerate(self.merges)], "step int, u long, v long, height double")


def _exact_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances from differences, so that copies are equally far from every row."""
    return np.stack([((y - p) ** 2).sum(axis=1) for p in x])


def _pairs_of_blocks(left: DataFrame, right: DataFrame, tasks: int) -> DataFrame:
    """(rows, others) for the rows of (b, with, rows) and (b, with, others) that share b and with."""
    return left.repartition(tasks, "b", "with").join(right.repartition(tasks, "b", "with"), ["b", "with"])


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """Blocks (b, rows) of whole clusters from rows (c, x, w), the clusters of a block in order."""
    return rows.withColumn("b", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int")).groupBy("b").agg(
        F.sort_array(F.collect_list(F.struct("c", "x", "w"))).alias("rows")
    )


def _parts(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(clusters, their first rows, their masses, points, weights) of one block."""
    c, x, w = (rows.field(i) for i in range(3))
    names, begins = np.unique(c.to_numpy(zero_copy_only=False), return_index=True)
    w = w.to_numpy(zero_copy_only=False)
    return names, begins, np.add.reduceat(w, begins), x.flatten().to_numpy(zero_copy_only=False).reshape(len(w), -1).astype("float64"), w


def _between(mine: tuple, others: tuple, linkage: str, exact: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of some clusters of a block, g between them and all clusters of another): the squared distance of the centroids for ward,
    the largest distance or the mean distance of their rows otherwise."""
    names, begins, mass, x, w = mine
    _, begins2, mass2, y, w2 = others
    ends = [*begins[1:], len(x)]
    squares = (lambda few: _exact_squares(few, y)) if exact else squares_to(y)
    even = bool((w2 == 1).all())
    single = even and bool((w == 1).all() and (mass == 1).all() and (mass2 == 1).all())
    first = 0
    while first < len(names):
        last = max(first + 1, int(np.searchsorted(begins, begins[first] + CHUNK_ROWS)))  # whole clusters, one at least
        own, parts = np.arange(first, last), []
        for i in range(begins[first], ends[last - 1], CHUNK_ROWS):
            to = slice(i, min(i + CHUNK_ROWS, ends[last - 1]))
            far = squares(x[to])
            if linkage == COMPLETE:
                far = np.maximum.reduceat(far, begins2, axis=1) if len(begins2) < len(y) else far
            elif linkage == AVERAGE:
                np.sqrt(far, out=far)
                if not even:
                    far *= w2[None, :]
                far = np.add.reduceat(far, begins2, axis=1) if len(begins2) < len(y) else far
                if not single:
                    far *= w[to][:, None]
            parts.append(far)
        g = parts[0] if len(parts) == 1 else np.concatenate(parts)
        if linkage != WARD and len(g) > len(own):
            g = (np.maximum if linkage == COMPLETE else np.add).reduceat(g, begins[own] - begins[first], axis=0)
        if linkage == AVERAGE and not single:
            g /= mass[own][:, None] * mass2[None, :]
        elif linkage == COMPLETE:
            np.sqrt(g, out=g)
        yield own, g
        first = last


def _heights(g: np.ndarray, mass: np.ndarray, mass2: np.ndarray, linkage: str) -> np.ndarray:
    if linkage != WARD:
        return g
    return np.sqrt(2 * mass[:, None] * mass2[None, :] / (mass[:, None] + mass2[None, :]) * g)


def _nearest(rows: DataFrame, n: int, changed: int, linkage: str) -> pa.Table:
    """(node, to, height): the nearest partner of every cluster with ``changed`` rows marked, from rows (c, x, w, changed). Equal heights go by the
    smaller partner. All ``n`` rows are held against the changed ones, in blocks of whole clusters."""
    blocks, own_blocks = (max(-(-k // TILE_ROWS), min(LEAST_TILES, -(-k // 500))) for k in (n, changed))
    own_blocks = max(1, min(own_blocks, -(-changed // TILE_ROWS)))
    left = _packed(rows.where("changed"), own_blocks).select("b", "rows", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("with"))
    right = _packed(rows, blocks).select(
        F.explode(F.sequence(F.lit(0), F.lit(own_blocks - 1))).alias("b"), F.col("b").alias("with"), F.col("rows").alias("others")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, others in zip(*(batch.column(c) for c in ("rows", "others")), strict=True):
                mine, others = _parts(mine.values), _parts(others.values)
                for own, g in _between(mine, others, linkage):
                    height, names, line = _heights(g, mine[2][own], others[2], linkage), mine[0][own], np.arange(len(own))
                    itself = np.minimum(np.searchsorted(others[0], names), len(others[0]) - 1)
                    height[line, itself] = np.where(others[0][itself] == names, np.inf, height[line, itself])
                    at = height.argmin(axis=1)  # clusters ascend
                    real = np.isfinite(height[line, at])
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (names[real], others[0][at[real]], height[line, at][real])], names=["node", "to", "height"])

    found = _pairs_of_blocks(left, right, blocks * own_blocks).select("rows", "others").mapInArrow(run, "node long, to long, height double")
    best = found.groupBy("node").agg(F.min(F.struct("height", "to")).alias("best"))
    return best.select("node", "best.to", "best.height").toArrow()  # one row per changed cluster


def _merge_matrix(d: np.ndarray, w: np.ndarray, linkage: str) -> list[tuple[int, int, int, float]]:
    """(round, i, j, height) of all merges of the clusters of a full matrix of g, infinite on its diagonal; both arrays are changed.

    A cluster looks for its nearest again only when it or its nearest was merged: no merge brings another cluster closer.
    """
    m, found, turn = len(w), [], 0
    alive, nearest, low, line = np.ones(m, dtype=bool), np.zeros(m, dtype=np.int64), np.full(m, np.inf), np.arange(m)
    changed = line
    while len(found) < m - 1:
        for i in range(0, len(changed), CHUNK_ROWS):
            part = changed[i : i + CHUNK_ROWS]
            height = _heights(d[part], w[part], w, linkage)
            nearest[part] = height.argmin(axis=1)
            low[part] = height[np.arange(len(part)), nearest[part]]
        u, v = _mutual(nearest, low, alive)
        if not len(u):
            break
        found += [(turn, int(a), int(b), float(h)) for a, b, h in zip(u, v, low[u], strict=True)]
        share = w[u] / (w[u] + w[v])
        inner = share * (1 - share) * d[u, v]
        for turned in (d, d.T):  # the rows, then the columns of what the rows became
            for i in range(0, len(u), CHUNK_ROWS):
                a, b, s = u[i : i + CHUNK_ROWS], v[i : i + CHUNK_ROWS], share[i : i + CHUNK_ROWS, None]
                if linkage == COMPLETE:
                    turned[a] = np.maximum(turned[a], turned[b])
                else:
                    mean = s * turned[a] + (1 - s) * turned[b]
                    turned[a] = np.maximum(mean - inner[i : i + CHUNK_ROWS, None], 0) if linkage == WARD else mean
        d[v], d[:, v] = np.inf, np.inf
        d[u, u] = np.inf
        w[u] += w[v]
        alive[v] = False
        changed = _to_search(nearest, alive, u, v)
        turn += 1
    return found


def _mutual(nearest: np.ndarray, height: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The clusters u < v that are nearest for each other. If rounding leaves none, the closest pair there is."""
    line = np.arange(len(nearest))
    real = alive & np.isfinite(height)
    u = np.flatnonzero(real & (nearest[nearest] == line) & (line < nearest))
    if not len(u) and real.any():
        i = int(np.argmin(np.where(real, height, np.inf)))
        return np.array([min(i, nearest[i])]), np.array([max(i, nearest[i])])
    return u, nearest[u]


def _to_search(nearest: np.ndarray, alive: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    gone = np.zeros(len(nearest), dtype=bool)
    gone[u] = gone[v] = True
    return np.flatnonzero(alive & (gone | gone[nearest]))


def _matrix_stage(rows: DataFrame, names: np.ndarray, linkage: str, exact: bool) -> list[tuple[int, int, int, float]]:
    """The merges (round, u, v, height) of the at most TABLE_CLUSTERS clusters of rows (c, x, w). Blocks of rows give blocks of the matrix,
    which meet in one task."""
    blocks = max(1, -(-len(names) // BLOCK_ROWS))
    packed = materialised(_packed(rows, blocks))
    left = packed.select("b", "rows", F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))).alias("with"))
    right = packed.select(F.explode(F.sequence(F.lit(0), F.col("b"))).alias("b"), F.col("b").alias("with"), F.col("rows").alias("others"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, others in zip(*(batch.column(c) for c in ("rows", "others")), strict=True):
                mine, others = _parts(mine.values), _parts(others.values)
                for own, g in _between(mine, others, linkage, exact):
                    parts = [mine[0][own], mine[2][own], others[0], others[2], g]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in parts], names=["a", "wa", "b", "wb", "g"]
                    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, w = np.full((len(names), len(names)), np.inf), np.ones(len(names))
        for batch in batches:
            for values in zip(*batch.columns, strict=True):
                a, b = (np.searchsorted(names, np.frombuffer(values[i].as_buffer(), dtype=np.int64)) for i in (0, 2))
                w[a], w[b] = np.frombuffer(values[1].as_buffer()), np.frombuffer(values[3].as_buffer())
                g = np.frombuffer(values[4].as_buffer()).reshape(len(a), len(b))
                d[np.ix_(a, b)] = g
                d[np.ix_(b, a)] = g.T
        np.fill_diagonal(d, np.inf)
        turn, u, v, height = (np.array(c) for c in zip(*_merge_matrix(d, w, linkage), strict=True)) if len(names) > 1 else [np.empty(0)] * 4
        columns = [turn.astype(np.int64), names[u.astype(np.int64)], names[v.astype(np.int64)], height.astype("float64")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["turn", "u", "v", "height"])

    parts = _pairs_of_blocks(left, right, blocks * (blocks + 1) // 2).select("rows", "others").mapInArrow(fill, "a binary, wa binary, b binary, wb binary, g binary")
    merged = materialised(parts).coalesce(1).mapInArrow(merge, "turn long, u long, v long, height double").toArrow()
    return [*zip(*(c.to_pylist() for c in merged.columns), strict=True)]


def _until_table(rows: DataFrame, ids: np.ndarray, linkage: str) -> tuple[np.ndarray, list[tuple[int, int, int, float]]]:
    """The cluster of each id, and the merges (round, u, v, height) until at most TABLE_CLUSTERS clusters are left. A round searches the nearest
    only of clusters that were merged or whose nearest was; the driver knows the nearest of the others."""
    written, n, found, turn = materialised(rows), len(ids), [], 0
    owner, alive = np.arange(n), np.ones(n, dtype=bool)
    nearest, height = np.zeros(n, dtype=np.int64), np.full(n, np.inf)
    changed = np.arange(n)
    while alive.sum() > TABLE_CLUSTERS:
        marked = np.zeros(n, dtype=bool)
        marked[changed] = True
        in_changed = int(marked[owner].sum()) if linkage != WARD else len(changed)
        table = _nearest(_clustered(written, ids, owner, linkage, marked), int(alive.sum()) if linkage == WARD else n, in_changed, linkage)
        node, to = (np.searchsorted(ids, table.column(c).to_numpy()) for c in ("node", "to"))
        height[changed] = np.inf
        nearest[node], height[node] = to, table.column("height").to_numpy()
        u, v = _mutual(nearest, height, alive)
        if not len(u):
            raise ValueError("no two clusters have a distance")
        found += [(turn, int(a), int(b), float(h)) for a, b, h in zip(ids[u], ids[v], height[u], strict=True)]
        into = np.arange(n)
        into[v] = u
        owner = into[owner]
        alive[v] = False
        changed = _to_search(nearest, alive, u, v)
        turn += 1
    return owner, found


def _clustered(rows: DataFrame, ids: np.ndarray, owner: np.ndarray, linkage: str, marked: np.ndarray | None = None) -> DataFrame:
    """The rows (c, x, w, changed) under the names of their clusters; for ward one row per cluster, its centroid."""
    at = rows.columns.index("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = owner[np.searchsorted(ids, batch.column(at).to_numpy())]
            flags = marked[own] if marked is not None else np.zeros(len(own), dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), batch.column(1), batch.column(2), pa.array(flags)], names=["c", "x", "w", "changed"])

    out = rows.mapInArrow(run, "c long, x array<double>, w double, changed boolean")
    if linkage != WARD:
        return out
    width = rows.select(F.size("x")).first()[0]
    mean = F.array(*[F.sum(F.get("x", F.lit(j)) * F.col("w")) / F.sum("w") for j in range(width)])
    return out.groupBy("c").agg(mean.alias("x"), F.sum("w").alias("w"), F.first("changed").alias("changed"))


def agglomerate(points: DataFrame, linkage: str) -> Dendrogram:
    """All merges of the rows of (id long, x array<double>), with an optional weight column ``w``."""
    if linkage not in (WARD, COMPLETE, AVERAGE):
        raise ValueError(f"unknown linkage {linkage!r}")
    weight = F.col("w").cast("double") if "w" in points.columns else F.lit(1.0)
    rows = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), weight.alias("w"))
    ids, copies = np.unique(np.array(rows.select("id").toArrow().column(0).to_pylist(), dtype=np.int64), return_counts=True)
    if (copies > 1).any():  # one cluster from the start, with the largest of their weights
        shared = rows.groupBy("id").agg((F.max("w") / F.count(F.lit(1))).alias("w"))
        rows = rows.drop("w").join(shared, "id").select("id", "x", "w")
    if len(ids) < 2:
        return Dendrogram(ids, [])
    owner, found = np.arange(len(ids)), []
    if len(ids) > TABLE_CLUSTERS:
        owner, found = _until_table(rows, ids, linkage)
    names, turns = ids[np.unique(owner)], found[-1][0] + 1 if found else 0
    last = _matrix_stage(_clustered(rows, ids, owner, linkage), names, linkage, exact=not found)
    found += [(turns + turn, u, v, h) for turn, u, v, h in last]  # the merges, one less than the rows, are the driver's
    return Dendrogram(ids, [(u, v, h) for h, _, u, v in sorted((h, turn, u, v) for turn, u, v, h in found)])


def label_rows(points: DataFrame, linkages: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """(id, one int column ``<linkage><k>`` per candidate) for every row."""
    columns = {}
    for linkage in linkages:
        tree = agglomerate(points, linkage)
        for k in ks:
            columns[f"{linkage}{k}"] = tree.labels(k)
    ids = sorted(next(iter(columns.values()))) if columns else []
    rows = [(i, *[of[i] for of in columns.values()]) for i in ids]
    return local_table(points.sparkSession, rows, ", ".join(["id long", *[f"`{c}` int" for c in columns]]))
