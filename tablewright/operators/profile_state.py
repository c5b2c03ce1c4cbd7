"""A profile that grows with the table: one small state per batch, merged on reading.

A state holds, per column, counts, range, a sketch of the distinct values and one of the quantiles. All of them merge, so the
profile of the whole table never reads an earlier batch again. Counts and ranges are exact; distinct values are
within about ``1.04 / sqrt(2 ** lg_k)`` (one standard error), the rank of a quantile within about ``2.3 / k``.

A batch is a folder of its own: writing it again replaces it, so a job that is repeated after a failure counts nothing twice.
Columns may come and go between batches; a column is known by name, and its type is that of the last batch by name.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import ident, is_numeric_or_bool, normalise, round_half_up

LG_K, QUANTILE_K = 12, 200
QUANTILES = (0.25, 0.5, 0.75)
STATE_SCHEMA = (
    "position int, column string, dtype string, num_rows bigint, null_count bigint, min double, max double, "
    "distinct binary, quantiles binary"
)


def state(df: DataFrame, lg_k: int = LG_K, k: int = QUANTILE_K) -> DataFrame:
    """One row per column of one batch, from one aggregate without a shuffle of values."""
    spark = df.sparkSession
    if not df.columns:
        return spark.createDataFrame([], STATE_SCHEMA)
    names = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    df = normalise(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c = ident(f.name)
        text = F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.StructType)) else c.cast("string")
        number = c.cast("double") if is_numeric_or_bool(f.dataType) else F.lit(None).cast("double")
        aggs += [
            F.count_if(c.isNull()).alias(f"z{i}"),
            F.min(number).alias(f"a{i}"),
            F.max(number).alias(f"b{i}"),
            F.hll_sketch_agg(text, F.lit(lg_k)).alias(f"d{i}"),
            F.kll_sketch_agg_double(number, F.lit(k)).alias(f"q{i}"),
        ]
    cells = [
        F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(dtype).alias("dtype"),
            F.col("rows").alias("num_rows"), F.col(f"z{i}").alias("null_count"), F.col(f"a{i}").alias("min"),
            F.col(f"b{i}").alias("max"), F.col(f"d{i}").alias("distinct"), F.col(f"q{i}").alias("quantiles"),
        )
        for i, name, dtype in names
    ]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def add_batch(df: DataFrame, path: str, batch: str, lg_k: int = LG_K, k: int = QUANTILE_K) -> None:
    """Writes the state of one batch below ``path``; the batch's earlier state is replaced."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"{batch!r} is no batch name: letters, digits, dots, dashes and underscores only")
    state(df, lg_k, k).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, f"batch={batch}"))


def read_batches(spark: SparkSession, path: str, batches: Sequence[str] | None = None) -> DataFrame:
    """The states below ``path``, of all batches or of those named."""
    states = spark.read.schema(STATE_SCHEMA + ", batch string").parquet(path)
    return states if batches is None else states.where(F.col("batch").isin(list(batches)))


def merged(states: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """The profile of all batches: exact counts and range, estimated distinct values and quantiles.

    ``states`` has one row per batch and column, whatever the batches hold. Rows of a batch without the column count as
    missing in it, as in a union by name.
    """
    batch = F.col("batch") if "batch" in states.columns else F.lit("")
    states = states.withColumn("batch", batch)
    rows = states.groupBy("batch").agg(F.max("num_rows").alias("n")).agg(F.sum("n").alias("s")).scalar()
    last = F.max_by(F.struct("position", "dtype"), F.struct("batch", "position"))
    found = states.groupBy("column").agg(
        last.alias("last"),
        F.sum(F.col("num_rows") - F.col("null_count")).alias("present"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("unique_estimate"),
        F.kll_merge_agg_double("quantiles").alias("q"),
        F.count("min").alias("ranged"),
    )
    found = found.withColumn("num_rows", rows).withColumn("null_count", F.col("num_rows") - F.col("present"))
    at = F.array(*[F.lit(float(q)) for q in quantiles])
    return found.select(
        F.col("last.position").alias("position"), "column", F.col("last.dtype").alias("dtype"), "num_rows", "null_count",
        round_half_up(F.try_divide(100 * F.col("null_count"), F.col("num_rows")), 2).alias("null_pct"),
        "unique_estimate", "min", "max",
        F.when(F.col("ranged") > 0, F.kll_sketch_get_quantile_double("q", at)).alias("quantiles"),
    )
