"""Clustering tournament: k-means and linkage candidates, three indices, one ranking.

All candidates' labels are columns of one written table. One pass over it gives the moments of every cluster of every
candidate, a second the distances to the centres and the silhouettes, so the passes do not grow with the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import ident, py_round_half_up, require_columns
from tablewright.functions.distances import distances
from tablewright.operators import linkage as linkage_of_rows
from tablewright.operators import lloyd
from tablewright.operators.features import Standardiser, fit_features, fit_standardiser
from tablewright.session import materialised, numbered, persisted

MICRO_CLUSTERS = 200
BLOCK_POINTS = 32_000
LEAST_BLOCKS, LEAST_POINTS = 8, 500  # smaller tables: blocks for the cores of a few machines
TILE = (512, 4_096)
MICRO_ITERATIONS = 20
LINKAGES = ("ward", "complete", "average")
CENTRES, ROWS = "centres", "rows"
# The printed names of the ranking.
CENTROID_FAMILY, LINKAGE_FAMILY = "Centroid-Based", "Connectivity-Based"
CENTROID_NAME, LINKAGE_NAME = "K-Means (k={k})", "Hierarchical [{linkage}] (k={k})"
CHAMPION, OTHERS = "Selected Champion", "Evaluated"
SQUARED, EUCLIDEAN = "squared euclidean", "euclidean"
LEADERBOARD_SCHEMA = (
    "rank int, algorithm string, family string, silhouette double, davies_bouldin double, "
    "calinski_harabasz double, clusters int, silhouette_kind string, verdict string"
)


# ---- indices -------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Clusters:
    """Moments of the clusters of one candidate; ``squares`` is the mean squared length of a cluster's points."""

    labels: np.ndarray
    sizes: np.ndarray
    means: np.ndarray
    squares: np.ndarray

    @property
    def within(self) -> float:
        return float(np.maximum((self.squares - (self.means**2).sum(axis=1)) * self.sizes, 0).sum())


def _batches(batches: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """The points of the column ``x`` around the centre, with their batch."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(centre))
            yield x - centre, batch


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _cluster_sums(code: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    return np.stack([np.bincount(code, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)


def _moments(points: DataFrame, labels: Sequence[str], centre: np.ndarray) -> list[_Clusters]:
    """Clusters of every label column: partial sums per batch, added up by Spark."""
    width = len(centre)

    def sums(batches):
        for x, batch in _batches(batches, centre):
            square = (x * x).sum(axis=1)
            out = []
            for i, name in enumerate(labels):
                found, code = np.unique(_column(batch, name), return_inverse=True)
                total, n = _cluster_sums(code, x, len(found)), np.bincount(code)
                squares = np.bincount(code, weights=square)
                out += [
                    {"i": i, "label": int(v), "n": int(n[k]), "q": float(squares[k]), "s": total[k].tolist()} for k, v in enumerate(found)
                ]
            yield pa.RecordBatch.from_pylist(
                out, pa.schema([("i", pa.int32()), ("label", pa.int64()), ("n", pa.int64()), ("q", pa.float64()), ("s", pa.list_(pa.float64()))])
            )

    parts = points.mapInArrow(sums, "i int, label bigint, n bigint, q double, s array<double>")
    rows = parts.groupBy("i", "label").agg(
        F.sum("n").alias("n"), F.sum("q").alias("q"), F.array(*[F.sum(F.get("s", F.lit(j))) for j in range(width)]).alias("s")
    ).collect()  # one row per cluster of each candidate
    out = []
    for i in range(len(labels)):
        own = sorted((r for r in rows if r["i"] == i), key=lambda r: r["label"])
        n = np.array([r["n"] for r in own], dtype="float64")
        out.append(_Clusters(
            np.array([r["label"] for r in own]), n, np.array([r["s"] for r in own]).reshape(len(own), width) / n[:, None],
            np.array([r["q"] for r in own]) / n,
        ))
    return out


def _silhouettes(mean: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per row, from its mean distance to each cluster, which counts the row itself in its own."""
    at = np.arange(len(own))
    a = mean[at, own] * sizes[own] / np.maximum(sizes[own] - 1, 1)
    mean[at, own] = np.inf
    b = mean.min(axis=1)
    top = np.maximum(a, b)
    return np.where((sizes[own] > 1) & (top > 0) & np.isfinite(b), (b - a) / np.where(top > 0, top, 1.0), 0.0)


def _spreads(points: DataFrame, labels: Sequence[str], clusters: Sequence[_Clusters], centre: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
    """Mean distance to the own centre per cluster, and the mean silhouette on squared distances, per candidate.

    The mean squared distance from x to a cluster is |x|^2 - 2 x.mean + its mean square.
    """

    def sums(batches):
        for x, batch in _batches(batches, centre):
            square = (x * x).sum(axis=1)
            out = []
            for i, (name, c) in enumerate(zip(labels, clusters)):
                own = np.searchsorted(c.labels, _column(batch, name))
                to = square[:, None] - 2 * x @ c.means.T
                near = np.sqrt(np.maximum(to[np.arange(len(x)), own] + (c.means[own] ** 2).sum(axis=1), 0))
                sil = _silhouettes(np.maximum(to + c.squares[None, :], 0), own, c.sizes)
                near, sil = (np.bincount(own, weights=v, minlength=len(c.sizes)) for v in (near, sil))
                out += [{"i": i, "k": k, "near": float(near[k]), "sil": float(sil[k])} for k in range(len(c.sizes))]
            yield pa.RecordBatch.from_pylist(
                out, pa.schema([("i", pa.int32()), ("k", pa.int32()), ("near", pa.float64()), ("sil", pa.float64())])
            )

    rows = points.mapInArrow(sums, "i int, k int, near double, sil double").groupBy("i", "k").agg(
        F.sum("near").alias("near"), F.sum("sil").alias("sil")
    ).collect()
    spreads = [np.zeros(len(c.labels)) for c in clusters]
    totals = [0.0] * len(clusters)
    for r in rows:
        spreads[r["i"]][r["k"]] = r["near"] / clusters[r["i"]].sizes[r["k"]]
        totals[r["i"]] += r["sil"]
    return spreads, [float(t / c.sizes.sum()) for t, c in zip(totals, clusters)]


def _indices(c: _Clusters, spread: np.ndarray) -> tuple[float, float]:
    """Davies-Bouldin and Calinski-Harabasz."""
    n, k = c.sizes.sum(), len(c.labels)
    overall = (c.means * c.sizes[:, None]).sum(axis=0) / n
    between = float((((c.means - overall) ** 2).sum(axis=1) * c.sizes).sum())
    within = c.within
    calinski = (between / (k - 1)) / (within / (n - k)) if within > 0 and n > k else 1.0
    worst = np.zeros(k)
    for i in range(k):  # row by row, so memory stays linear in the clusters
        gap = np.sqrt(((c.means - c.means[i]) ** 2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(gap > 0, (spread + spread[i]) / gap, 0.0)
        ratio[i] = 0.0
        worst[i] = ratio.max()
    return float(worst.mean()), float(calinski)


def score_labels(points: DataFrame, labels: Sequence[str], distance: str = SQUARED) -> list[dict]:
    """The indices of every whole-number label column over the array column ``x``, in two passes for all of them.

    ``distance`` names the silhouette's distance: squared (linear in the rows), or "euclidean", which compares all rows
    with all rows block by block and is for tables of moderate size. It never changes by itself.
    """
    if distance not in (SQUARED, EUCLIDEAN):
        raise ValueError(f"unknown distance {distance!r}")
    first = points.select(F.avg(F.size("x")).alias("w")).first()["w"]
    if first is None:
        return [{"n": 0, "k": 0, "davies_bouldin": None, "calinski_harabasz": None, "silhouette": None, "kind": None} for _ in labels]
    width = int(first)
    # Sums of squares around the mean lose no digits to the data's distance from zero.
    centre = np.array(points.agg(*[F.avg(F.get("x", F.lit(j))) for j in range(width)]).first(), dtype="float64")
    clusters = _moments(points, labels, centre)
    spreads, silhouettes = _spreads(points, labels, clusters, centre)
    if distance == EUCLIDEAN:
        silhouettes = _silhouettes_euclidean(points, labels, clusters, centre=centre)
    out = []
    for c, spread, silhouette in zip(clusters, spreads, silhouettes):
        n, k = int(c.sizes.sum()), len(c.labels)
        if k < 2:
            out.append({"n": n, "k": k, "davies_bouldin": None, "calinski_harabasz": None, "silhouette": None, "kind": None})
            continue
        davies, calinski = _indices(c, spread)
        out.append({"n": n, "k": k, "davies_bouldin": davies, "calinski_harabasz": calinski, "silhouette": silhouette, "kind": distance})
    return out


def cluster_indices(df: DataFrame, features: Sequence[str], label: str, distance: str = SQUARED) -> DataFrame:
    """One row: clusters, Davies-Bouldin, Calinski-Harabasz and the mean silhouette with its kind."""
    s = score_clusters(df, features, label, distance)
    return df.sparkSession.createDataFrame(
        [(s["n"], s["k"], s["davies_bouldin"], s["calinski_harabasz"], s["silhouette"], s["kind"])],
        "n bigint, k int, davies_bouldin double, calinski_harabasz double, silhouette double, silhouette_kind string",
    )


def score_clusters(df: DataFrame, features: Sequence[str], label: str, distance: str = SQUARED) -> dict:
    """The indices of one label column of any type."""
    require_columns(df, label, *features)
    df = df.where(ident(label).isNotNull())
    codes = df.select(ident(label).alias("v")).distinct().orderBy("v")
    coded = numbered(codes.coalesce(1), "__code")  # one row per cluster
    x = F.array(*[ident(c).cast("double") for c in features]).alias("x")
    points = df.select(x, ident(label).alias("__v")).join(coded, F.col("__v") == F.col("v"))
    return score_labels(points.select("x", F.col("__code").alias("c")), ["c"], distance)[0]


def silhouette_squared(df: DataFrame, features: Sequence[str], label: str) -> float:
    """Silhouette on squared distances: linear in the rows, exact for that distance."""
    rows = df.select(*[ident(c) for c in features], ident(label).cast("double").alias("__label"))
    coded = VectorAssembler(inputCols=list(features), outputCol="__point").transform(rows).select("__point", "__label")
    return ClusteringEvaluator(featuresCol="__point", predictionCol="__label", metricName="silhouette").evaluate(coded)


def _silhouettes_euclidean(
    points: DataFrame, labels: Sequence[str], clusters: Sequence[_Clusters], block_points: int = BLOCK_POINTS, centre: np.ndarray | None = None
) -> list[float]:
    """Euclidean silhouettes of all candidates: every two blocks of rows meet once, in a task of their own, and the sums of distances per
    cluster of each candidate are added up for the rows of both. What moves is rows times blocks, and there are few blocks."""
    ends = np.cumsum([len(c.labels) for c in clusters])
    begins = ends - [len(c.labels) for c in clusters]
    n = int(clusters[0].sizes.sum())
    blocks = max(1, -(-n // block_points), min(LEAST_BLOCKS, n // LEAST_POINTS))
    coded = F.array(*[F.col(n).cast("bigint") for n in labels]).alias("c")
    rows = numbered(points.select("x", coded)).withColumn("b", F.pmod(F.xxhash64("__id"), F.lit(blocks)).cast("int"))
    packed = materialised(rows.groupBy("b").agg(F.collect_list(F.struct("__id", "x", "c")).alias("rows")))
    left = packed.select("b", "rows", F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))).alias("with"))
    right = packed.select(F.explode(F.sequence(F.lit(0), F.col("b"))).alias("b"), F.col("b").alias("with"), F.col("rows").alias("others"))
    tasks = blocks * (blocks + 1) // 2
    pairs = left.repartition(tasks, "b", "with").join(right.repartition(tasks, "b", "with"), ["b", "with"])

    def parts_of(rows: pa.StructArray) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
        ids, x, c = (rows.field(i) for i in range(3))
        x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype("float64")
        codes = c.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), len(clusters))
        member = np.zeros((len(ids), ends[-1]))
        for i, k in enumerate(clusters):
            member[np.arange(len(ids)), begins[i] + np.searchsorted(k.labels, codes[:, i])] = 1.0
        return ids, x if centre is None else x - centre, c, member

    def table(ids: pa.Array, c: pa.Array, total: np.ndarray) -> pa.RecordBatch:
        sums = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, total.shape[1]).astype(np.int32)), pa.array(total.ravel()))
        return pa.RecordBatch.from_arrays([ids, c, sums], names=["id", "c", "s"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, other, mine, others in zip(*(batch.column(c) for c in ("b", "with", "rows", "others")), strict=True):
                ids, x, c, member = parts_of(mine.values)
                ids2, y, c2, member2 = parts_of(others.values)
                total, total2, same = np.zeros(member.shape), np.zeros(member2.shape), b.as_py() == other.as_py()
                for i in range(0, len(x), TILE[0]):
                    for j in range(0, len(y), TILE[1]):
                        own, to = slice(i, i + TILE[0]), slice(j, j + TILE[1])
                        far = distances(x[own], y[to])
                        total[own] += far @ member2[to]
                        if not same:
                            total2[to] += far.T @ member[own]
                yield table(ids, c, total)
                if not same:
                    yield table(ids2, c2, total2)

    parts = pairs.select("b", "with", "rows", "others").mapInArrow(sums, "id bigint, c array<bigint>, s array<double>")
    per_row = parts.groupBy("id", "c").agg(F.array(*[F.sum(F.get("s", F.lit(j))) for j in range(int(ends[-1]))]).alias("s"))

    def scores(batches):
        for pdf in batches:
            if len(pdf):
                total, codes = np.stack(pdf["s"].to_numpy()), np.stack(pdf["c"].to_numpy())
                out = {}
                for i, c in enumerate(clusters):
                    own = np.searchsorted(c.labels, codes[:, i])
                    out[f"s{i}"] = _silhouettes(total[:, begins[i] : ends[i]] / c.sizes[None, :], own, c.sizes)
                yield pd.DataFrame(out)

    means = per_row.mapInPandas(scores, ", ".join(f"s{i} double" for i in range(len(labels))))
    return list(means.agg(*[F.avg(f"s{i}") for i in range(len(labels))]).first())


# ---- candidates ----------------------------------------------------------------------------


def merge_linkage(points: np.ndarray, weights: np.ndarray, linkage: str, ks: Sequence[int]) -> dict[int, np.ndarray]:
    """Agglomeration of at most MICRO_CLUSTERS weighted points; labels for each wanted cluster count."""
    m = len(points)
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    w = weights.astype("float64").copy()
    if linkage == "ward":
        d = d * np.sqrt(2.0 * w[:, None] * w[None, :] / (w[:, None] + w[None, :]))
    np.fill_diagonal(d, np.inf)
    owner = np.arange(m)
    alive = np.ones(m, dtype=bool)
    out: dict[int, np.ndarray] = {}
    left = m
    while True:
        if left in ks:
            out[left] = np.unique(owner, return_inverse=True)[1]
        if left <= min(ks):
            return out
        i, j = divmod(int(np.argmin(d)), m)
        i, j = min(i, j), max(i, j)
        others = alive.copy()
        others[[i, j]] = False
        if linkage == "complete":
            new = np.maximum(d[i, others], d[j, others])
        elif linkage == "average":
            new = (w[i] * d[i, others] + w[j] * d[j, others]) / (w[i] + w[j])
        else:
            wo = w[others]
            total = w[i] + w[j] + wo
            new = np.sqrt(
                ((w[i] + wo) * d[i, others] ** 2 + (w[j] + wo) * d[j, others] ** 2 - wo * d[i, j] ** 2) / total
            )
        d[i, others] = d[others, i] = new
        d[j, :] = d[:, j] = np.inf
        w[i] += w[j]
        alive[j] = False
        owner[owner == j] = i
        left -= 1


@dataclass(frozen=True)
class ClusterResult:
    leaderboard: DataFrame
    best_algorithm: str
    best_k: int
    silhouette: float
    davies_bouldin: float
    calinski_harabasz: float
    labelled: DataFrame  # the features with a column Cluster
    features: tuple[str, ...]


def clustering_features(df: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str], Standardiser]:
    """Numeric features only, filled and without indicators, plus their standardiser."""
    model = fit_features(df, exclude=keep)
    prepared = model.transform(df, keep=keep).select(*[ident(k) for k in keep], *[ident(c) for c in model.numeric])
    names = list(model.numeric)
    if len(names) < 2:
        raise ValueError("clustering needs at least two numeric features")
    return prepared, names, fit_standardiser(prepared, names)


def _fits(points: DataFrame, n: int, width: int, ks: Sequence[int], restarts: int, seed: int, micro: int) -> tuple[dict[int, lloyd.Fit], np.ndarray | None]:
    """The best k-means fit for every k, and the centres of ``micro`` small clusters (None if 0); all advance in the same scans."""
    if not ks and not micro:
        return {}, None
    most = max([*ks, micro])
    runs = [(k, seed + r) for k in ks for r in range(restarts)]
    blocks = lloyd.packed(points).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if n <= most:  # each row can be a centre of its own
            pool, weights = np.unique(np.array([r["x"] for r in points.collect()]), axis=0, return_counts=True)
        else:
            pool, weights = lloyd.start_pool(points, width, max([1, *ks, micro // lloyd.POOL_PER_CLUSTER]), seed, blocks=blocks)
        starts = [lloyd.starts_from_pool(pool, weights.astype("float64"), k, s) for k, s in runs]
        limits = [lloyd.MAX_ITERATIONS] * len(runs)
        if micro:
            runs.append((0, seed))
            starts.append(lloyd.starts_from_pool(pool, weights.astype("float64"), max(2, min(micro, len(pool))), seed))
            limits.append(MICRO_ITERATIONS)
        fits = lloyd.fit_together(blocks, starts, limits)
    finally:
        blocks.unpersist()
    best = {k: min((f for (own, _), f in zip(runs, fits) if own == k), key=lambda f: f.cost) for k in ks}
    return best, fits[-1].centres if micro else None


def clustering_tournament(
    df: DataFrame,
    max_k: int = 6,
    keep: Sequence[str] = (),
    restarts: int = 10,
    seed: int = 42,
    linkages: Sequence[str] = LINKAGES,
    micro_clusters: int = MICRO_CLUSTERS,
    distance: str = SQUARED,
    linkage_on: str = CENTRES,
) -> ClusterResult:
    """Ranks the candidates by silhouette and labels the table with the winner.

    Linkage candidates merge the weighted centres of a k-means run of ``micro_clusters``, at every table size; with fewer
    rows than that, each row can be a centre of its own. ``linkage_on="rows"`` merges the rows themselves instead, all pairs of
    them, and takes time quadratic in the rows. It never changes by itself.
    """
    if linkage_on not in (CENTRES, ROWS):
        raise ValueError(f"unknown {linkage_on!r}")
    prepared, names, standardiser = clustering_features(df, keep)
    spark = df.sparkSession
    scaled = standardiser.transform(prepared)
    x = F.array(*[ident(c).cast("double") for c in names]).alias("x")
    rows = scaled.select(*[ident(c) for c in (*keep, *names)], x)
    on_rows = linkage_on == ROWS and bool(linkages)
    rows = persisted(numbered(rows) if on_rows else rows)
    try:
        n = rows.count()
        points = rows.select("x")
        ks = list(range(2, min(max_k, n - 1) + 1))
        linked = list(range(2, min(4, n - 1) + 1)) if linkages else []
        fits, micro = _fits(points, n, len(names), ks, restarts, seed, micro_clusters if linked and not on_rows else 0)
        candidates = [(CENTROID_NAME.format(k=k), CENTROID_FAMILY, k, f"__k{k}") for k in ks]
        labels = {f"__k{k}": fits[k].centres for k in ks}
        if micro is not None:
            labels["__m"] = micro
        # Written before the linkage candidates are known: their labels follow from the micro clusters', without another pass.
        labelled = materialised(lloyd.with_labels(rows, labels)) if labels else rows
        if micro is not None:
            sizes = {r["__m"]: r["n"] for r in labelled.groupBy("__m").agg(F.count(F.lit(1)).alias("n")).collect()}
            used = sorted(sizes)  # centres without rows take no part
            merged_points, weights = micro[used], np.array([sizes[i] for i in used], dtype="float64")
            for linkage in linkages:
                reachable = [k for k in linked if k <= len(merged_points)]
                for k, owner in sorted(merge_linkage(merged_points, weights, linkage, reachable).items() if reachable else ()):
                    of_centre = dict(zip(used, owner))
                    codes = F.array(*[F.lit(int(of_centre.get(i, 0))) for i in range(max(used) + 1)])
                    column = f"__{linkage}{k}"
                    labelled = labelled.withColumn(column, F.element_at(codes, F.col("__m") + 1))
                    candidates.append((LINKAGE_NAME.format(linkage=linkage.capitalize(), k=k), LINKAGE_FAMILY, k, column))
        if on_rows and linked:
            merged = linkage_of_rows.label_rows(rows.select(F.col("__id").alias("id"), "x"), linkages, linked)
            labelled = labelled.join(merged.withColumnsRenamed({c: f"__{c}" for c in merged.columns}), "__id")
            candidates += [
                (LINKAGE_NAME.format(linkage=name.capitalize(), k=k), LINKAGE_FAMILY, k, f"__{name}{k}") for name in linkages for k in linked
            ]
        columns = [c[3] for c in candidates]
        written = labelled.select(*[ident(c) for c in (*keep, *names)], "x", *[F.col(c) for c in columns])
        if on_rows or not labels:
            written = materialised(written)
        scores = score_labels(written.select("x", *columns), columns, distance)
        found = [(i, c, s) for i, (c, s) in enumerate(zip(candidates, scores)) if s["k"] > 1]
        if not found:
            raise ValueError("no candidate found more than one cluster")
        found.sort(key=lambda f: (-f[2]["silhouette"], f[0]))
        board = [
            (
                rank, name, family, py_round_half_up(s["silhouette"], 4), py_round_half_up(s["davies_bouldin"], 4),
                py_round_half_up(s["calinski_harabasz"], 2), k, s["kind"], CHAMPION if rank == 1 else OTHERS,
            )
            for rank, (_, (name, family, k, _), s) in enumerate(found, 1)
        ]
        _, (best_name, _, best_k, best_column), _ = found[0]
        original = [(ident(c) * F.lit(standardiser.deviations[c]) + F.lit(standardiser.means[c])).alias(c) for c in names]
        winner = written.select(*[ident(c) for c in keep], *original, F.col(best_column).alias("Cluster"))
        return ClusterResult(
            spark.createDataFrame(board, LEADERBOARD_SCHEMA), best_name, best_k, board[0][3], board[0][4], board[0][5], winner, tuple(names),
        )
    finally:
        rows.unpersist()


def segment_scatter(labelled: DataFrame, features: Sequence[str]) -> DataFrame:
    """First two feature columns that are not identifiers, with the segment's name."""
    axes = [c for c in features if c != "Cluster" and not c.lower().startswith("id")][:2]
    if len(axes) < 2:
        raise ValueError("two plottable columns are needed")
    return labelled.select(
        *[ident(c) for c in axes], F.concat(F.lit("Segment "), F.col("Cluster").cast("string")).alias("segment")
    )


def segment_sample(labelled: DataFrame, segment: str, key: str | Sequence[str], rows: int = 500) -> DataFrame:
    """At most ``rows`` rows of each segment for a chart: those with the smallest hashes of their key.

    The choice depends on the keys alone, not on partitions or order, and a segment that grows keeps a part of its earlier
    sample. Every task passes on at most ``rows`` rows of a segment, so a segment that holds a third of the table moves no
    more than the others. Rows that share a key are told apart by their other columns, rows equal in all of them are
    interchangeable; a null segment is a segment, a null part of a key differs from an empty text.
    """
    keys = [key] if isinstance(key, str) else list(key)
    require_columns(labelled, segment, *keys)
    parts = [F.coalesce(F.concat(F.lit(":"), ident(k).cast("string")), F.lit("")) for k in keys]
    chosen = F.md5(F.concat_ws("|", *parts).cast("binary"))
    whole = F.xxhash64(*[ident(c) for c in labelled.columns])
    order = Window.partitionBy(ident(segment)).orderBy(chosen, whole)
    place = "__place"
    while place in labelled.columns:
        place += "_"
    ranked = labelled.withColumn(place, F.row_number().over(order))
    return ranked.where(ident(place) <= rows).drop(place)
