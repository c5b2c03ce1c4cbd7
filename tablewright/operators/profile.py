"""Column profile: type, nulls, distinct values, samples, range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import (
    columns_where,
    distinct_sketch,
    ident,
    is_numeric_or_bool,
    normalise,
    round_half_up,
)
from tablewright.functions.counts import is_present, key_counts, smallest, value_columns

PROFILE_SCHEMA = (
    "position int, column string, dtype string, num_rows bigint, null_count bigint, null_pct double, "
    "unique_values bigint, sample_values array<string>, min double, max double"
)


def _names(df: DataFrame) -> DataFrame:
    rows = [
        (i, f.name, f.dataType.simpleString(), is_numeric_or_bool(f.dataType)) for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string, ranged boolean")


def profile(df: DataFrame, samples: int = 3) -> DataFrame:
    """One row per column, exact.

    The samples are the smallest distinct values as text: a distributed table has no first rows. One shuffle
    of distinct (column, key) pairs feeds the counts, with texts as their length and hashes; the samples are minima, so no
    text is sorted and at most one per task, column and sample is moved.
    """
    names = _names(df)
    if not df.columns:
        return df.sparkSession.createDataFrame([], PROFILE_SCHEMA)
    df = normalise(df)
    counts = key_counts(df, df.columns)
    vs = value_columns(counts)
    present = is_present(counts)
    types = [counts.schema[v].dataType for v in vs]
    ranged = [F.col(v).cast("double") for v, t in zip(vs, types) if is_numeric_or_bool(t)]
    number = F.coalesce(*ranged) if ranged else F.lit(None).cast("double")
    stats = counts.groupBy("pos").agg(
        F.sum("n").alias("num_rows"),
        F.sum(F.when(present, F.lit(0)).otherwise(F.col("n"))).alias("null_count"),
        F.count_if(present).alias("unique_values"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
    )
    positions = range(len(df.columns))
    firsts = smallest(df, df.columns, samples).select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"s{i}").alias("sample_values")) for i in positions]))
    )
    return (
        # Both sides have one row per column.
        names.join(F.broadcast(stats), names["position"] == stats["pos"], "left")
        .drop("pos")
        .join(F.broadcast(firsts), F.col("position") == firsts["pos"], "left")
        .select(
            "position",
            "column",
            "dtype",
            F.coalesce("num_rows", F.lit(0)).alias("num_rows"),
            F.coalesce("null_count", F.lit(0)).alias("null_count"),
            round_half_up(F.try_divide(100 * F.col("null_count"), F.col("num_rows")), 2).alias("null_pct"),
            F.coalesce("unique_values", F.lit(0)).alias("unique_values"),
            F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
            F.when(F.col("ranged"), F.col("min")).alias("min"),
            F.when(F.col("ranged"), F.col("max")).alias("max"),
        )
    )


def profile_approx(df: DataFrame, lg_k: int = 12) -> DataFrame:
    """The profile from a single aggregate without any shuffle of values.

    Distinct counts are sketches and there are no samples; everything else is exact.
    """
    names = _names(df)
    df = normalise(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c = ident(f.name)
        probe = F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.StructType)) else c
        number = c.cast("double") if is_numeric_or_bool(f.dataType) else F.lit(None).cast("double")
        aggs += [
            F.count_if(c.isNull()).alias(f"z{i}"),
            F.coalesce(distinct_sketch(probe, lg_k), F.lit(0)).alias(f"u{i}"),
            F.min(number).alias(f"a{i}"),
            F.max(number).alias(f"b{i}"),
        ]
    cells = [
        F.struct(
            F.lit(i).alias("pos"),
            F.col("rows").alias("num_rows"),
            F.col(f"z{i}").alias("null_count"),
            F.col(f"u{i}").alias("unique_values"),
            F.col(f"a{i}").alias("min"),
            F.col(f"b{i}").alias("max"),
        )
        for i in range(len(df.columns))
    ]
    stats = df.agg(*aggs).select(F.inline(F.array(*cells)))
    return names.join(F.broadcast(stats), names["position"] == stats["pos"]).select(  # one row per column
        "position",
        "column",
        "dtype",
        "num_rows",
        "null_count",
        round_half_up(F.try_divide(100 * F.col("null_count"), F.col("num_rows")), 2).alias("null_pct"),
        "unique_values",
        F.lit(None).cast("array<string>").alias("sample_values"),
        "min",
        "max",
    )


def shape(df: DataFrame) -> DataFrame:
    """Rows, columns and the number of missing cells."""
    n_cols = len(df.columns)
    df = normalise(df)
    missing = [F.count_if(ident(c).isNull()) for c in df.columns]
    total = missing[0]
    for m in missing[1:]:
        total = total + m
    return df.agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.lit(n_cols).alias("num_columns"),
        total.alias("missing_cells"),
    )


def preview(df: DataFrame, key: str | Sequence[str], rows: int = 8) -> DataFrame:
    """The first rows in key order."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*[ident(k) for k in keys]).limit(rows)


def text_columns(df: DataFrame) -> list[str]:
    return columns_where(df, lambda t: isinstance(t, T.StringType))
