"""Type predicates, null normalisation and rounding shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tokens a CSV reader of the pandas family takes as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def ident(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_number(dtype: T.DataType) -> bool:
    """Numeric without booleans: feature matrices, statistics, noise."""
    return isinstance(dtype, T.NumericType)


def is_numeric_or_bool(dtype: T.DataType) -> bool:
    """Numeric or boolean: profile ranges, cleaning, default favourable value."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_calendar(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def columns_where(df: DataFrame, predicate) -> list[str]:
    return [f.name for f in df.schema.fields if predicate(f.dataType)]


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {', '.join(missing)}")


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes null and decimals become doubles, so that one notion of missing holds everywhere."""
    out = []
    for f in df.schema.fields:
        c = ident(f.name)
        if isinstance(f.dataType, (T.MapType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)):
            raise ValueError(f"column {f.name!r} of type {f.dataType.simpleString()} is not supported")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c).alias(f.name)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double").alias(f.name)
        out.append(c)
    return df.select(*out)


def round_half_up(c: Column, places: int) -> Column:
    """``floor(x * 10^p + 0.5) / 10^p``: the same double in every engine, unlike ``round``."""
    k = float(10**places)
    c = c.cast("double")
    return F.when(~F.isnan(c), F.floor(c * F.lit(k) + F.lit(0.5)) / F.lit(k))


def distinct_sketch(c: Column, lg_k: int) -> Column:
    """Approximate distinct count from one compact sketch per task; nulls are not counted."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(c.cast("string"), F.lit(lg_k)))


def py_round_half_up(x: float | None, places: int) -> float | None:
    import math

    if x is None or math.isnan(x):
        return None
    if math.isinf(x):
        return x
    k = 10.0**places
    return math.floor(x * k + 0.5) / k
