"""Enlarging a sparse table with rows that follow its own distributions.

Every random number is a hash of the new row's number, the column and the seed, so a recomputed
partition yields the same rows. Drawing a value from a column's frequency table is drawing the value
of a random non-null row, which is an equi-join on a dense row number instead of a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import columns_where, ident, is_number, normalise, round_half_up
from tablewright.session import local_table, numbered

# When a table is sparse, how far it grows, and the noise relative to the deviation.
MIN_ROWS, TARGET_ROWS, NOISE = 30, 100, 0.08
SMALL_TABLE = 1_000  # rows up to which the base table is broadcast
_UNIT = float(1 << 52)


def _uniform(name: str, seed: int) -> Column:
    """A number in (0, 1) fixed by the row number, a name and the seed."""
    h = F.pmod(F.xxhash64(F.col("__n"), F.lit(name), F.lit(seed)), F.lit(1 << 52))
    return (h.cast("double") + F.lit(0.5)) / F.lit(_UNIT)


def _normal(name: str, seed: int) -> Column:
    radius = F.sqrt(F.lit(-2.0) * F.log(_uniform(name + "/r", seed)))
    return radius * F.cos(F.lit(2.0) * F.pi() * _uniform(name + "/a", seed))


def _draw(name: str, seed: int, size: int) -> Column:
    """A row number in [0, size)."""
    return F.pmod(F.xxhash64(F.col("__n"), F.lit(name), F.lit(seed)), F.lit(size).cast("bigint"))


def _numbered(fixed: DataFrame, keep: Column | None, columns: list[str], index: str) -> tuple[DataFrame, int]:
    """Dense numbers for the rows of a numbered table for which ``keep`` holds."""
    rows = fixed if keep is None else fixed.where(keep)
    part = F.shiftright(F.col("__id"), 33)
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, seen = [], 0
    for p, n in counts:  # one entry per partition
        offsets.append((p, seen))
        seen += n
    table = local_table(fixed.sparkSession, offsets or [(-1, 0)], "__p bigint, __offset bigint")
    rows = rows.withColumn("__p", part)
    if keep is None:
        local = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    else:
        local = F.row_number().over(Window.partitionBy("__p").orderBy("__id")) - 1
    rows = rows.withColumn("__local", local).join(table, "__p")
    return rows.select((F.col("__offset") + F.col("__local")).alias(index), *[ident(c) for c in columns]), seen


def synthesise(
    df: DataFrame,
    min_rows: int = MIN_ROWS,
    target_rows: int = TARGET_ROWS,
    seed: int = 42,
    joint: bool = False,
) -> tuple[DataFrame, bool]:
    """(table with ``is_synthetic``, whether it grew). Tables of ``min_rows`` or more stay as they are.

    Numbers are those of a random base row plus small normal noise; other columns are redrawn
    independently, or with ``joint`` kept from the base row.
    """
    df = normalise(df)
    columns = df.columns
    numbers = columns_where(df, is_number)
    others = [c for c in columns if c not in numbers]
    first = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(ident(c).cast("double")).alias(f"m{i}") for i, c in enumerate(numbers)],
        *[F.stddev_samp(ident(c).cast("double")).alias(f"s{i}") for i, c in enumerate(numbers)],
        *[F.count(ident(c)).alias(f"k{i}") for i, c in enumerate(others)],
    ).first()
    n = first["n"]
    if n >= min_rows or n == 0 or target_rows <= n:
        return df.withColumn("is_synthetic", F.lit(False)), False
    needed = target_rows - n
    # Numbers turn into doubles on both sides, since noise is fractional.
    original = df.select(*[ident(c).cast("double").alias(c) if c in numbers else ident(c) for c in columns])
    fixed = numbered(original)
    draws = df.sparkSession.range(needed).withColumnRenamed("id", "__n")

    base, _ = _numbered(fixed, None, columns, "__base")
    base = F.broadcast(base) if n <= SMALL_TABLE else base  # size checked by the count above
    rows = draws.withColumn("__base", _draw("base row", seed, n)).join(base, "__base").drop("__base")

    out: dict[str, Column] = {}
    for i, c in enumerate(numbers):
        mean, std = first[f"m{i}"] or 0.0, first[f"s{i}"]
        if std is None or not std > 0:
            std = NOISE * (abs(mean) + 1.0)
        out[c] = round_half_up(ident(c) + F.lit(NOISE * std) * _normal(c, seed), 4)
    for i, c in enumerate(others):
        out[c] = ident(c)
        if joint or first[f"k{i}"] == 0:
            continue
        whole = first[f"k{i}"] == n
        pool, size = _numbered(fixed, None if whole else ident(c).isNotNull(), [c], f"__i{i}")
        pool = pool.withColumnRenamed(c, f"__v{i}")
        pool = F.broadcast(pool) if size <= SMALL_TABLE else pool
        rows = rows.withColumn(f"__i{i}", _draw(c, seed, size)).join(pool, f"__i{i}")
        out[c] = F.col(f"__v{i}")
    new = rows.select(*[out[c].alias(c) for c in columns], F.lit(True).alias("is_synthetic"))
    return original.withColumn("is_synthetic", F.lit(False)).unionByName(new), True
