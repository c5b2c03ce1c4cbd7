"""Exact, reproducible 70/15/15 split and dense row numbers, neither with a global sort.

Rows are ordered by a hash of their key. The two cut points are order statistics of that hash: a
histogram over its leading digits finds the bin of each cut, the rows of that bin alone are
ordered, and every row is then placed by comparing its hash with the cut points. A class that
holds a third of the table is only ever counted, never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tablewright.functions.columns import ident, require_columns, round_half_up
from tablewright.session import local_or_written, local_table, numbered

DIGITS = 4  # 65,536 bins: 15 million rows per bin at 10^12 rows
MAX_LOCAL_CUTS = 100_000


def row_hash(df: DataFrame, key: str | Sequence[str] | None, seed: int = 42) -> Column:
    """md5 of the key's text followed by the seed; without a key, of the whole row."""
    if isinstance(key, str):
        key = [key]
    names = list(key) if key else df.columns
    parts = []
    for c in names:
        text = (
            F.to_json(F.struct(ident(c)))
            if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType))
            else ident(c).cast("string")
        )
        parts.append(F.coalesce(text, F.lit("\x00")) if len(names) > 1 else text)
    joined = parts[0] if len(parts) == 1 else F.concat_ws("\x1f", *parts)
    return F.md5(F.concat(F.coalesce(joined, F.lit("\x00")), F.lit(str(seed))).cast("binary"))


def _cuts(hashed: DataFrame) -> DataFrame:
    """(c, cut, upto, at, m, h): for each class and cut the hash of the last row before it.

    ``hashed`` is (c, h). ``cut`` 1 ends train, ``cut`` 2 ends val. ``upto`` is the wanted number of
    rows, ``at`` the number up to and including the ``m`` rows with that hash.
    """
    binned = hashed.withColumn("p", F.substring("h", 1, DIGITS))
    hist = binned.groupBy("c", "p").agg(F.count(F.lit(1)).alias("n"))
    by_class = Window.partitionBy("c")
    hist = hist.withColumn("total", F.sum("n").over(by_class)).withColumn(
        "upto_bin", F.sum("n").over(by_class.orderBy("p"))
    )
    held = F.expr("CASE WHEN total > 1 THEN (3 * total + 9) div 10 ELSE 0 END")
    wanted = hist.withColumn("held", held).withColumn("tested", F.expr("(held + 1) div 2"))
    cuts = F.array(
        F.struct(F.lit(1).alias("cut"), (F.col("total") - F.col("held")).alias("upto")),
        F.struct(F.lit(2).alias("cut"), (F.col("total") - F.col("tested")).alias("upto")),
    )
    bins = (
        wanted.select("c", "p", "n", "upto_bin", F.inline(cuts))
        .where((F.col("upto") <= F.col("upto_bin")) & (F.col("upto") > F.col("upto_bin") - F.col("n")))
        .select("c", "p", (F.col("upto_bin") - F.col("n")).alias("before"), "cut", "upto")
    )
    # At most two bins per class, so this is a few rows unless classes abound; the bins of one class
    # hold n / 65,536 rows each.
    bins = local_or_written(bins, MAX_LOCAL_CUTS)
    inside = binned.alias("b").join(
        bins.select("c", "p").distinct().alias("w"), (F.col("b.c").eqNullSafe(F.col("w.c"))) & (F.col("b.p") == F.col("w.p")), "left_semi"
    )
    counted = inside.groupBy("c", "p", "h").agg(F.count(F.lit(1)).alias("m"))
    running = counted.withColumn("run", F.sum("m").over(Window.partitionBy("c", "p").orderBy("h")))
    return (
        running.alias("r")
        .join(bins.alias("w"), (F.col("r.c").eqNullSafe(F.col("w.c"))) & (F.col("r.p") == F.col("w.p")))
        .select("r.c", "cut", "upto", (F.col("before") + F.col("run")).alias("at"), "m", "h")
        .where((F.col("at") >= F.col("upto")) & (F.col("at") - F.col("m") < F.col("upto")))
    )


def _last_copies(numbered_rows: DataFrame, ties: DataFrame) -> DataFrame:
    """(c, cut, last): the row number of the last copy before each cut that falls inside a group of copies.

    Copies are counted per partition of the written table, so a group that holds a third of all rows is many tasks;
    only the partition in which the cut falls is ranked row by row.
    """
    part = F.shiftright(F.col("id"), 33)
    wanted = ties.select(F.col("c").alias("tc"), F.col("h").alias("th"), "cut", (F.col("upto") - F.col("at") + F.col("m")).alias("keep"))
    copies = numbered_rows.join(
        wanted.select("tc", "th").distinct(), F.col("c").eqNullSafe(F.col("tc")) & (F.col("h") == F.col("th")), "left_semi"
    ).withColumn("p", part)
    counts = copies.groupBy("c", "h", "p").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("c", "h").orderBy("p")) - F.col("n")
    counts = counts.withColumn("before", before)
    hit = counts.join(wanted, F.col("c").eqNullSafe(F.col("tc")) & (F.col("h") == F.col("th"))).where(
        (F.col("keep") > F.col("before")) & (F.col("keep") <= F.col("before") + F.col("n"))
    ).select("tc", "th", "cut", F.col("p").alias("tp"), (F.col("keep") - F.col("before")).alias("k"))
    ranked = copies.withColumn("r", F.row_number().over(Window.partitionBy("c", "h", "p").orderBy("id")))
    same = F.col("c").eqNullSafe(F.col("tc")) & (F.col("h") == F.col("th")) & (F.col("p") == F.col("tp")) & (F.col("r") == F.col("k"))
    return ranked.join(hit, same).select("c", "cut", F.col("id").alias("last"))


def split_70_15_15(
    df: DataFrame,
    key: str | Sequence[str] | None = None,
    seed: int = 42,
    stratify: str | None = None,
    name: str = "split",
) -> DataFrame:
    """The table with a column ``split``: exactly ceil(30 %) held out, half of it (rounded up) for test.

    With ``stratify`` the sizes hold per class, however many classes there are. Rows that share a hash at a cut point
    (copies) are told apart by their place in a written copy of the table, so the sizes stay exact.
    """
    if stratify is not None:
        require_columns(df, stratify)
    cls = ident(stratify) if stratify is not None else F.lit(0)
    h = row_hash(df, key, seed)
    columns = df.columns
    cuts = local_or_written(_cuts(df.select(cls.alias("c"), h.alias("h"))), MAX_LOCAL_CUTS)
    ties = cuts.where("at > upto")
    last = cuts.where(F.lit(False)).select("c", "cut", F.lit(None).cast("bigint").alias("last"))
    row_id = F.lit(0).cast("bigint")
    if ties.limit(1).count():
        df, row_id = numbered(df), F.col("__id")
        last = _last_copies(df.select(cls.alias("c"), h.alias("h"), row_id.alias("id")), ties)
    named = last.select(F.col("c").alias("lc"), F.col("cut").alias("lcut"), "last")
    placed_cuts = cuts.join(named, F.col("c").eqNullSafe(F.col("lc")) & (F.col("cut") == F.col("lcut")), "left")
    at = lambda cut, value: F.max(F.when(F.col("cut") == cut, F.col(value)))
    bounds = placed_cuts.groupBy(F.col("c").alias("__c")).agg(
        at(1, "h").alias("__h1"), at(2, "h").alias("__h2"), at(1, "last").alias("__i1"), at(2, "last").alias("__i2")
    )
    # One row per class: broadcast while few, so that rows stay where they are; many classes are joined as a table.
    bounds = local_or_written(bounds, MAX_LOCAL_CUTS)

    def before(bound: Column, last_id: Column) -> Column:
        return F.coalesce((h < bound) | ((h == bound) & (last_id.isNull() | (row_id <= last_id))), F.lit(False))

    split = (
        F.when(before(F.col("__h1"), F.col("__i1")), F.lit("train"))
        .when(before(F.col("__h2"), F.col("__i2")), F.lit("val"))
        .otherwise(F.lit("test"))
    )
    placed = df.join(bounds, cls.eqNullSafe(F.col("__c")), "left")
    return placed.withColumn(name, split).select(*[ident(c) for c in columns], name)


def split_counts(df: DataFrame, name: str = "split") -> DataFrame:
    """Rows and share of each part."""
    counts = df.groupBy(ident(name).alias("split")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # three rows
    return counts.select("split", "n", round_half_up(F.try_divide(100.0 * F.col("n"), total), 1).alias("share_pct"))


def dense_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """0..n-1 without a gap. A copy of the table is written, so the numbers survive a lost executor."""
    fixed = numbered(df)
    part = F.shiftright(F.col("__id"), 33)
    counts = sorted((r["p"], r["n"]) for r in fixed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, seen = [], 0
    for p, n in counts:  # one entry per partition
        offsets.append((p, seen))
        seen += n
    table = local_table(df.sparkSession, offsets, "__p bigint, __offset bigint")
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        fixed.withColumn("__p", part)
        .join(table, "__p")
        .withColumn(name, F.col("__offset") + within)
        .select(*[ident(c) for c in df.columns], name)
    )
