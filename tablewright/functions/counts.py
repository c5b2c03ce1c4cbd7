"""Value counts of many columns in one scan, and what follows from them.

Every column becomes one (position, value) cell; values of one type share a slot, so nothing is
converted to text. Cells are counted map-side first, so a value that fills a third of the table
reaches the shuffle as one row per task. Where only the number of distinct values matters, ``key_counts`` moves texts as their
length and two hashes, so a table of long texts shuffles a few bytes per value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import ident, is_text

TEXT_KEY = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "hash", "other")])
OTHER_SEED = 1  # hashed before the text, which starts the second hash elsewhere

def _countable(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.ArrayType, T.StructType)):
        return F.to_json(ident(name)), T.StringType()
    return ident(name), dtype


def _keyed(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    """The value, texts as (length, hash, hash of another seed): 128 bits of hash tell them apart."""
    value, dtype = _countable(df, name)
    if not is_text(dtype):
        return value, dtype
    value = value.cast("string")
    key = F.struct(F.length(value).cast("long"), F.xxhash64(value), F.xxhash64(F.lit(OTHER_SEED), value)).cast(TEXT_KEY)
    return F.when(value.isNotNull(), key), TEXT_KEY


def _counts(df: DataFrame, cell_values: Sequence[tuple[Column, T.DataType]]) -> DataFrame:
    types: list[T.DataType] = []
    for _, dtype in cell_values:
        if dtype not in types:
            types.append(dtype)
    cells = []
    for pos, (value, dtype) in enumerate(cell_values):
        fields = [
            (value if t == dtype else F.lit(None).cast(t)).alias(f"v{j}") for j, t in enumerate(types)
        ]
        cells.append(F.struct(F.lit(pos).alias("pos"), *fields))
    keys = ["pos", *[f"v{j}" for j in range(len(types))]]
    return df.select(F.inline(F.array(*cells))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(pos, v0.., n): one row per distinct value of each column, nulls included."""
    return _counts(df, [_countable(df, name) for name in columns])


def key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``value_counts`` with texts, arrays and structs as keys of 24 bytes."""
    return _counts(df, [_keyed(df, name) for name in columns])


def smallest(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """One row with ``s0..``: the ``k`` smallest distinct values of each column as text, in order.

    The next value is the minimum of those above the last one: a pass per value, each a running minimum per task without
    sorting or shuffling the values, whatever their length.
    """
    places = range(len(columns))
    values = [_countable(df, name)[0].alias(f"x{i}") for i, name in enumerate(columns)]
    found = []
    for _ in range(k):
        # The last row of minima is one column, so that it is one subquery however many columns compare with it.
        rows = df.select(*values, found[-1].alias("last")) if found else df.select(*values)
        above = [F.when(F.col(f"x{i}") > F.col(f"last.m{i}"), F.col(f"x{i}")) if found else F.col(f"x{i}") for i in places]
        row = rows.agg(*[F.min(v).alias(f"m{i}") for i, v in enumerate(above)])
        found.append(row.select(F.struct(*[f"m{i}" for i in places])).scalar())
    row = df.sparkSession.range(1).select(F.array(*found).alias("rows"))
    return row.select(*[F.array_compact(F.col("rows").getField(f"m{i}").cast("array<string>")).alias(f"s{i}") for i in places])


def value_columns(counts: DataFrame) -> list[str]:
    return [c for c in counts.columns if c not in ("pos", "n")]


def is_present(counts: DataFrame) -> Column:
    present = [F.col(v).isNotNull() for v in value_columns(counts)]
    return present[0] if len(present) == 1 else F.greatest(*present)


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value per column; ties go to the smallest; all-null columns are absent."""
    if not columns:
        return {}
    counts = value_counts(df, columns)
    vs = value_columns(counts)
    best = (
        counts.where(is_present(counts))
        .groupBy("pos")
        .agg(F.min(F.struct((-F.col("n")).alias("neg"), *vs)).alias("best"))
    )
    out: dict[str, object] = {}
    for row in best.collect():  # one row per column
        filled = [row["best"][v] for v in vs if row["best"][v] is not None]
        out[columns[row["pos"]]] = filled[0]
    return out
