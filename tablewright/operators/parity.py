"""Four-fifths parity audit: favourable rate per group against the best group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import ident, is_numeric_or_bool, normalise, require_columns, round_half_up

# Fixed value: the regulatory floor of the four-fifths rule.
PARITY_FLOOR = 0.80


def _base(df: DataFrame, sensitive: str, outcome: str, favorable: object | None) -> tuple[DataFrame, Column]:
    """Counts by (key, o) and the favourable value of o.

    Whole numbers, booleans and texts are counted as they are. A given favourable value, or the
    maximum of a fractional outcome, turns the outcome into a flag first, so that a continuous
    outcome does not reach the shuffle value by value.
    """
    require_columns(df, sensitive, outcome)
    both = normalise(df.select(ident(sensitive).alias("key"), ident(outcome).alias("o")))
    if favorable is None and isinstance(both.schema["o"].dataType, (T.FloatType, T.DoubleType)):
        value = both.agg(F.max("o")).scalar()
    else:
        value = None if favorable is None else F.lit(favorable)
    if value is not None:
        both = both.select("key", F.coalesce(F.col("o") == value, F.lit(False)).alias("o"))
    counts = both.groupBy("key", "o").agg(F.count(F.lit(1)).alias("n"))
    return counts, F.lit(True) if value is not None else default_favorable(counts)


def default_favorable(counts: DataFrame) -> Column:
    """Largest value of a numeric or boolean outcome, else the most frequent one (smallest on ties).

    ``counts`` is (key, o, n); the struct keeps every column in use, so that the exchange behind
    ``counts`` is shared with the rates instead of being planned twice.
    """
    if is_numeric_or_bool(counts.schema["o"].dataType):
        return counts.agg(F.max(F.when(F.col("o").isNotNull(), F.struct("o", "n"))).alias("best")).select("best.o").scalar()
    best = counts.groupBy("o").agg(F.sum("n").alias("n"))
    return (
        best.agg(F.min(F.when(F.col("o").isNotNull(), F.struct((-F.col("n")).alias("neg"), "o"))).alias("best"))
        .select("best.o")
        .scalar()
    )


def _rates(counts: DataFrame, favorable: Column) -> DataFrame:
    # Dropping the null cohort by its row count, not by its key, keeps the filter above the exchange.
    hits = F.sum(F.when(F.col("o") == favorable, F.col("n")).otherwise(F.lit(0)))
    return (
        counts.groupBy("key")
        .agg(
            F.sum("n").alias("n"),
            round_half_up(F.try_divide(hits, F.sum("n")), 4).alias("rate"),
            F.sum(F.when(F.col("key").isNotNull(), F.col("n"))).alias("keyed"),
        )
        .where(F.col("keyed") > 0)
    )


def _judged(rates: DataFrame) -> DataFrame:
    top = rates.agg(F.min(F.struct((-F.col("rate")).alias("neg"), "key", "n", "keyed")).alias("top"))
    ratio = F.when(F.col("benchmark") > 0, F.try_divide(F.col("rate"), F.col("benchmark"))).otherwise(F.lit(1.0))
    return rates.withColumn("benchmark", top.select(-F.col("top.neg")).scalar()).withColumn("ratio", round_half_up(ratio, 3))


def group_rates(df: DataFrame, sensitive: str, outcome: str, favorable: object | None = None) -> DataFrame:
    """(cohort, n, rate): null outcomes stay in the denominator, null groups drop out."""
    return _rates(*_base(df, sensitive, outcome, favorable)).select(F.col("key").cast("string").alias("cohort"), "n", "rate")


def parity_audit(
    df: DataFrame,
    sensitive: str,
    outcome: str,
    favorable: object | None = None,
    floor: float = PARITY_FLOOR,
) -> DataFrame:
    """One row per cohort with its rate, its ratio to the benchmark cohort and the violation flag.

    One scan: rows collapse map-side to (cohort, outcome) counts; the favourable value and the
    benchmark rate are scalar subqueries over that same exchange.
    """
    return _judged(_rates(*_base(df, sensitive, outcome, favorable))).select(
        F.col("key").cast("string").alias("cohort"),
        "n",
        "rate",
        "ratio",
        F.lit(float(floor)).alias("floor"),
        (F.col("ratio") < F.lit(float(floor))).alias("violation"),
    )


def parity_violations(audit: DataFrame) -> DataFrame:
    return audit.where("violation").select("cohort", "rate", "ratio")


def parity_verdict(
    df: DataFrame,
    sensitive: str,
    outcome: str,
    favorable: object | None = None,
    floor: float = PARITY_FLOOR,
) -> DataFrame:
    """One row: status, favourable value, benchmark cohort, counts and the sentence for the report."""
    counts, hit = _base(df, sensitive, outcome, favorable)
    judged = _judged(_rates(counts, hit))
    fav = hit
    if favorable is not None:
        fav = F.lit(favorable)
    elif isinstance(df.schema[outcome].dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
        fav = normalise(df.select(ident(outcome))).agg(F.max(ident(outcome))).scalar()
    totals = judged.agg(
        F.count(F.lit(1)).alias("n_cohorts"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count_if(F.col("ratio") < F.lit(float(floor))).alias("n_violations"),
        F.min(F.struct((-F.col("rate")).alias("neg"), "key", "n", "keyed")).alias("top"),
    ).select(
        "*",
        (-F.col("top.neg")).alias("benchmark_rate"),
        F.col("top.key").cast("string").alias("benchmark_cohort"),
    )
    passed = F.col("n_violations") == 0
    return totals.select(
        F.when(F.col("n_cohorts") == 0, F.lit("ERROR")).when(passed, F.lit("PASS")).otherwise(F.lit("WARNING")).alias("status"),
        fav.cast("string").alias("favorable"),
        "benchmark_cohort",
        "benchmark_rate",
        "n_cohorts",
        "n_rows",
        "n_violations",
        F.when(F.col("n_cohorts") == 0, F.lit("No cohort could be rated."))
        .when(passed, F.lit("Every cohort reaches four fifths of the benchmark rate."))
        .otherwise(
            F.concat(
                F.col("n_violations").cast("string"),
                F.lit(" cohort(s) stay below four fifths of the rate of "),
                F.col("benchmark_cohort"),
                F.lit("."),
            )
        )
        .alias("verdict"),
    )


def parity_audit_all(
    df: DataFrame, sensitive: Sequence[str], outcome: str, favorable: object | None = None
) -> DataFrame:
    """The audit of several sensitive columns, stacked with the column's name."""
    parts = [
        parity_audit(df, s, outcome, favorable).select(F.lit(s).alias("attribute"), "*") for s in sensitive
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parity_chart(audit: DataFrame) -> DataFrame:
    """Bar per cohort with the floor line."""
    return audit.select("cohort", "ratio", "floor")
