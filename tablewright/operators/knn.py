"""Exact nearest-neighbour vote as a partitioned join.

Reference rows are placed in cells around a bounded set of pivots. The triangle inequality gives each
query an upper bound on its k-th distance and each cell a lower bound on its distances, so a query
visits only cells that can matter. Large cells and large query sets are cut into blocks: a task
sees one block of each side, keeps the k nearest per query, and a second step merges those.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import ident, require_columns, round_half_up
from tablewright.session import local_table

MAX_PIVOTS = 2_000
ROWS_PER_CELL = 5_000
BLOCK_ROWS = 20_000
QUERY_ROWS = 5_000
DISTANCE_PLACES = 9  # distances equal to 1e-9 count as equal, then the smaller key is nearer


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype("float64") if len(col) else np.empty((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 256):
        d = a[i : i + 256, None, :] - b[None, :, :] if a.shape[1] <= 4 else None
        if d is not None:
            out[i : i + 256] = np.sqrt((d * d).sum(axis=2))
        else:
            part = a[i : i + 256]
            sq = (part * part).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * part @ b.T
            out[i : i + 256] = np.sqrt(np.maximum(sq, 0.0))
    return out


def nearest_neighbours(
    train: DataFrame,
    queries: DataFrame,
    features: Sequence[str] | str,
    key: str,
    label: str,
    k: int = 5,
    rows_per_cell: int = ROWS_PER_CELL,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query, neighbour, label, distance, rank) for the k nearest train rows of every query.

    ``features`` is an array column or a list of numeric columns; ``key`` identifies rows on both sides.
    """
    names = [features] if isinstance(features, str) else list(features)
    require_columns(train, key, label, *names)
    require_columns(queries, key, *names)

    def points(df: DataFrame, *extra) -> DataFrame:
        vec = ident(names[0]).cast("array<double>") if isinstance(features, str) else F.array(*[ident(c).cast("double") for c in names])
        return df.select(ident(key).alias("key"), vec.alias("x"), *extra)

    t, q = points(train, ident(label).alias("label")), points(queries)
    n = t.count()
    if n == 0:
        raise ValueError("no reference rows")
    k = min(k, n)
    # Pivots: the rows with the smallest key hashes. They steer the work, not the result.
    wanted = max(1, min(MAX_PIVOTS, n // rows_per_cell))
    pivots = np.array([r["x"] for r in t.orderBy(F.xxhash64("key"), "key").limit(wanted).select("x").collect()], dtype="float64")

    @F.pandas_udf("cell int, near double")
    def place(x: pd.Series) -> pd.DataFrame:
        d = _distances(_matrix(x), pivots)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "near": d[np.arange(len(d)), cell]})

    placed = t.select("*", place("x").alias("p")).select("key", "x", "label", "p.cell", "p.near")
    # Per cell: rows, radius, and the distance of its k-th row from the pivot.
    by_near = Window.partitionBy("cell").orderBy("near")
    kth = (
        placed.select("cell", "near").withColumn("r", F.row_number().over(by_near)).where(F.col("r") <= k)
        .groupBy("cell").agg(F.max("near").alias("kth"), F.count(F.lit(1)).alias("found"))
    )
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("near").alias("radius")).join(kth, "cell").collect()
    count = np.zeros(len(pivots), dtype="int64")
    radius = np.full(len(pivots), -np.inf)
    reach = np.full(len(pivots), np.inf)
    for c in cells:  # at most MAX_PIVOTS rows
        count[c["cell"]], radius[c["cell"]] = c["n"], c["radius"]
        if c["found"] >= k:
            reach[c["cell"]] = c["kth"]
    between = _distances(pivots, pivots)
    slack = 1e-6  # rounding of distances must never lose a neighbour

    @F.pandas_udf("array<int>")
    def visits(x: pd.Series) -> pd.Series:
        d = _distances(_matrix(x), pivots)
        bound = (d + reach[None, :]).min(axis=1) + slack
        home = d.argmin(axis=1)
        lower = d - radius[None, :]
        gap = between[home]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(gap > 0, (d**2 - d[np.arange(len(d)), home][:, None] ** 2) / (2 * gap), -np.inf)
        lower = np.maximum(lower, plane)
        keep = (count[None, :] > 0) & (lower <= bound[:, None])
        return pd.Series([np.flatnonzero(row).astype("int32") for row in keep])

    routed = q.select("key", "x", F.explode(visits("x")).alias("cell"))
    demand = {r["cell"]: r["n"] for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = [
        (int(c), max(1, math.ceil(count[c] / block_rows)), max(1, math.ceil(m / query_rows))) for c, m in demand.items()
    ]
    table = local_table(train.sparkSession, plan or [(-1, 1, 1)], "cell int, blocks int, chunks int")  # at most MAX_PIVOTS rows
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    chunk = F.pmod(F.xxhash64("key", F.lit(1)), F.col("chunks")).cast("int")
    left = placed.join(table, "cell").select(
        "cell", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "key", "x", "label"
    )
    right = routed.join(table, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), chunk.alias("chunk"), "key", "x"
    )
    key_type = t.schema["key"].dataType.simpleString()
    label_type = t.schema["label"].dataType.simpleString()

    def search(group, reference: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["query", "neighbour", "label", "distance"]
        if reference.empty or asked.empty:
            return pd.DataFrame({c: [] for c in columns})
        ref, ask = _matrix(reference["x"]), _matrix(asked["x"])
        keys, labels = reference["key"].to_numpy(), reference["label"].to_numpy()
        by_key = np.unique(keys, return_inverse=True)[1]
        asked_keys = asked["key"].to_numpy()
        m = min(k, len(ref))
        parts = []
        for i in range(0, len(ask), 256):
            batch = ask[i : i + 256]
            d = _distances(batch, ref)
            cut = np.partition(d, m - 1, axis=1)[:, m - 1]
            # Everything as near as the k-th, so that ties are settled by key, here and in the merge.
            q_at, r_at = np.nonzero(d <= cut[:, None] + slack)
            exact = np.sqrt(((ref[r_at] - batch[q_at]) ** 2).sum(axis=1))
            order = np.lexsort((by_key[r_at], np.floor(exact * 10.0**DISTANCE_PLACES + 0.5), q_at))
            q_at, r_at, exact = q_at[order], r_at[order], exact[order]
            first = np.searchsorted(q_at, q_at)
            kept = np.arange(len(q_at)) - first < k
            parts.append((asked_keys[i + q_at[kept]], keys[r_at[kept]], labels[r_at[kept]], exact[kept]))
        return pd.DataFrame({c: np.concatenate([p[j] for p in parts]) for j, c in enumerate(columns)})

    groups = ["cell", "block", "chunk"]
    found = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(
        search, f"query {key_type}, neighbour {key_type}, label {label_type}, distance double"
    )
    nearest = Window.partitionBy("query").orderBy("distance", "neighbour")
    return (
        found.withColumn("distance", round_half_up(F.col("distance"), DISTANCE_PLACES))
        .withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= k)
    )


def knn_vote(neighbours: DataFrame) -> DataFrame:
    """(query, prediction): the most frequent label, the smallest on ties."""
    return (
        neighbours.groupBy("query", "label")
        .agg(F.count(F.lit(1)).alias("votes"))
        .groupBy("query")
        .agg(F.min(F.struct((-F.col("votes")).alias("neg"), "label")).alias("best"))
        .select("query", F.col("best.label").alias("prediction"))
    )
