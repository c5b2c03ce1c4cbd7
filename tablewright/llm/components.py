"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join; each round's edges are written to the shared folder, so nothing is collected
and a lost executor repeats one round at most. The number of rounds grows with the logarithm of the graph's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.store import Scratch

MAX_ROUNDS = 60


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Every neighbour of u moves to the smallest of u and its neighbours. Large star: the neighbours above u, seen from
    both ends; small star: those below u and u itself."""
    if larger_only:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if larger_only:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.filter("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v); the component is its smallest node."""
    now = scratch.write(edges.filter("u <> v").select("u", "v").distinct(), f"{name}-0")
    state = None
    for k in range(1, MAX_ROUNDS + 1):
        after = scratch.write(_star(_star(now, True), False), f"{name}-{k}")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{k - 1}")
        now = after
        if mark == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = mark
    raise RuntimeError(f"the components did not settle in {MAX_ROUNDS} rounds")
