"""Scores of predictions and the tables behind the diagnostic charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import ident, require_columns, round_half_up

HISTOGRAM_BINS = 15


def confusion(df: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    """(actual, predicted, n), optionally per group; everything else about classes follows from it."""
    require_columns(df, actual, predicted, *by)
    return df.groupBy(
        *[ident(b).alias(b) for b in by], ident(actual).alias("actual"), ident(predicted).alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    """Accuracy and support-weighted F1; a class never predicted or never seen scores zero."""
    cells = confusion(df, actual, predicted, *by)
    hit = F.when(F.col("actual").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    per_class = (
        cells.select(
            *by,
            F.inline(
                F.array(
                    F.struct(F.col("actual").alias("cls"), F.col("n").alias("support"), zero.alias("called"), hit.alias("tp")),
                    F.struct(F.col("predicted").alias("cls"), zero.alias("support"), F.col("n").alias("called"), zero.alias("tp")),
                )
            ),
        )
        .groupBy(*by, "cls")
        .agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("tp").alias("tp"))
    )
    f1 = F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("called"))
    return per_class.groupBy(*by).agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("support") * F.coalesce(f1, F.lit(0.0))) / F.sum("support")).alias("weighted_f1"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    """R2, mean squared and mean absolute error from one aggregate."""
    require_columns(df, actual, predicted, *by)
    y, p = ident(actual).cast("double"), ident(predicted).cast("double")
    sums = df.groupBy(*[ident(b).alias(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.var_pop(y).alias("var"),
    )
    r2 = F.when(F.col("var") > 0, 1 - F.try_divide(F.col("mse"), F.col("var"))).when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return sums.select(*by, "n", r2.alias("r2"), "mse", "mae")


def ols_one_feature(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line through one feature."""
    require_columns(df, x, y)
    a, b = ident(x).cast("double"), ident(y).cast("double")
    return df.agg(
        F.regr_count(b, a).alias("n"),
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.regr_r2(b, a).alias("r2"),
    )


def predict_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """(actual, predicted) under the least-squares line, whose two numbers are scalar subqueries."""
    line = ols_one_feature(df, x, y)
    return df.select(
        ident(y).cast("double").alias("actual"),
        (line.select("intercept").scalar() + line.select("slope").scalar() * ident(x).cast("double")).alias("predicted"),
    )


def residuals(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.withColumn("residual", ident(actual) - ident(predicted))


def ideal_bounds(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Ends of the line on which prediction equals truth."""
    a, p = ident(actual), ident(predicted)
    return df.agg(
        F.least(F.min(a), F.min(p)).alias("low"),
        F.greatest(F.max(a), F.max(p)).alias("high"),
    )


def histogram(df: DataFrame, column: str = "residual", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins from the smallest to the largest value, the last one closed, empty bins included."""
    spark = df.sparkSession
    require_columns(df, column)
    v = ident(column).cast("double")
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    half = F.when(F.col("lo") == F.col("hi"), F.lit(0.5)).otherwise(F.lit(0.0))
    ends = ends.select((F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    width: Column = (hi - lo) / F.lit(float(bins))
    slot = F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(v.isNotNull()).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    slots = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return slots.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("start"),
        (lo + (F.col("bin") + 1) * width).alias("end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def rounded_metrics(df: DataFrame, places: int = 4) -> DataFrame:
    """Every double of a score table in the form that is equal across engines."""
    return df.select(
        *[round_half_up(ident(f.name), places).alias(f.name) if f.dataType.simpleString() == "double" else ident(f.name) for f in df.schema.fields]
    )
