"""Association rules over text and boolean columns.

Rows collapse map-side to distinct baskets of frequent items before any itemset is formed, so the
itemset step works on a table whose size depends on the categories, not on the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import columns_where, ident, is_text, round_half_up
from tablewright.functions.counts import value_columns, value_counts
from tablewright.session import materialised

CUBE_ROWS = 50_000_000  # distinct baskets times groupings; above it the itemsets come from FP-growth
LISTED_VALUES = 10_000  # more frequent values than this are not sent back as a filter; the result is the same
ITEMSET_SCHEMA = "items array<string>, n bigint, support double"
RULE_SCHEMA = "antecedent string, consequent string, support double, confidence double, lift double"
# Default thresholds and report length.
MIN_SUPPORT, MIN_CONFIDENCE, TOP_RULES = 0.05, 0.6, 10


def basket_columns(df: DataFrame) -> list[str]:
    return columns_where(df, lambda t: is_text(t) or isinstance(t, T.BooleanType))


def _items(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column's item as text: ``column_value``, a true boolean as ``column``, otherwise null."""
    out = []
    for i, c in enumerate(columns):
        if isinstance(df.schema[c].dataType, T.BooleanType):
            out.append(F.when(ident(c), F.lit(c)).alias(f"i{i}"))
        else:
            out.append(F.concat(F.lit(f"{c}_"), ident(c)).alias(f"i{i}"))
    return df.select(*out)


def frequent_itemsets(df: DataFrame, min_support: float = MIN_SUPPORT, columns: Sequence[str] | None = None) -> DataFrame:
    """Every itemset found in at least ``min_support`` of all rows, of any size."""
    spark = df.sparkSession
    columns = list(columns) if columns is not None else basket_columns(df)
    if not columns:
        return spark.createDataFrame([], ITEMSET_SCHEMA)
    items = _items(df, columns)
    counts = value_counts(items, items.columns)
    v = value_columns(counts)[0]
    # The total is a subquery over the same exchange.
    floor = F.lit(float(min_support))
    total = counts.agg(F.sum(F.when(F.col("pos") == 0, F.col("n")))).scalar()
    found = counts.withColumn("total", total).where(F.col("n") / F.col("total").cast("double") >= floor)
    # Nulls are left out here: as a filter they would move below the exchange and cost a second scan.
    rows = found.select("pos", v, "total").limit(LISTED_VALUES + len(columns) + 1).collect()
    n = rows[0]["total"] if rows else 0
    if not any(r[v] is not None for r in rows):
        return spark.createDataFrame([], ITEMSET_SCHEMA)
    kept = items
    if len(rows) <= LISTED_VALUES:  # leaving out rare values only makes the baskets fewer
        frequent: dict[int, list[str]] = {}
        for r in rows:
            if r[v] is not None:
                frequent.setdefault(r["pos"], []).append(r[v])
        kept = items.select(*[F.when(F.col(f"i{i}").isin(frequent[i]), F.col(f"i{i}")).alias(f"i{i}") for i in sorted(frequent)])
    names = kept.columns
    support = (F.col("n") / F.lit(float(n))).alias("support")
    baskets = materialised(kept.groupBy(*names).agg(F.count(F.lit(1)).alias("w")))
    few = len(names) <= 20 and baskets.count() << len(names) <= CUBE_ROWS
    sets = _cube_itemsets(baskets, names) if few else _grown_itemsets(kept, names, min_support, n)
    sets = sets.select(F.array_sort("items").alias("items"), "n", support).where(F.col("support") >= floor)
    return materialised(sets)  # rules read it three times


def _grown_itemsets(kept: DataFrame, names: Sequence[str], min_support: float, n: int) -> DataFrame:
    baskets = kept.select(F.array_compact(F.array(*names)).alias("items")).where(F.size("items") > 0)
    share = 0.0 if min_support <= 0 else min_support * n / max(baskets.count(), 1)
    # A little lower, so that rounding loses no set at the limit; the exact filter follows.
    fitted = FPGrowth(itemsCol="items", minSupport=min(1.0, share * (1 - 1e-9)))
    return fitted.fit(baskets).freqItemsets.select("items", F.col("freq").alias("n"))


def _cube_itemsets(baskets: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every grouping of the distinct baskets (``w`` rows each)."""
    cubed = baskets.cube(*names).agg(
        F.sum("w").alias("n"), *[F.grouping(c).alias(f"g_{c}") for c in names]
    )
    named: Column = F.lit(True)
    some: Column = F.lit(False)
    for c in names:
        # A null that is grouped in means "no item here", which is not an itemset.
        named = named & ((F.col(f"g_{c}") == 1) | F.col(c).isNotNull())
        some = some | (F.col(f"g_{c}") == 0)
    return cubed.where(named & some).select(F.array_compact(F.array(*names)).alias("items"), "n")


def association_rules(itemsets: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Every split of every itemset into two non-empty parts, with support, confidence and lift."""
    masks = F.sequence(F.lit(1).cast("bigint"), F.expr("shiftleft(1L, size(items)) - 2"))
    splits = (
        itemsets.where(F.size("items") > 1)
        .select("items", "support", F.explode(masks).alias("mask"))
        .select(
            "support",
            F.expr("filter(items, (x, i) -> shiftright(mask, i) % 2 = 1)").alias("lhs"),
            F.expr("filter(items, (x, i) -> shiftright(mask, i) % 2 = 0)").alias("rhs"),
        )
    )
    left = itemsets.select(F.col("items").alias("lhs"), F.col("support").alias("lhs_support"))
    right = itemsets.select(F.col("items").alias("rhs"), F.col("support").alias("rhs_support"))
    confidence = F.col("support") / F.col("lhs_support")
    return (
        splits.join(left, "lhs")
        .join(right, "rhs")
        .where(confidence >= F.lit(float(min_confidence)))
        .select(
            F.array_join("lhs", ", ").alias("antecedent"),
            F.array_join("rhs", ", ").alias("consequent"),
            round_half_up(F.col("support"), 3).alias("support"),
            round_half_up(confidence, 3).alias("confidence"),
            round_half_up(confidence / F.col("rhs_support"), 3).alias("lift"),
        )
    )


def top_rules(rules: DataFrame, limit: int = TOP_RULES) -> DataFrame:
    """The report's rules: highest rounded lift first, ties by confidence and then by name."""
    return rules.orderBy(F.desc("lift"), F.desc("confidence"), "antecedent", "consequent").limit(limit)


def mine_rules(
    df: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    columns: Sequence[str] | None = None,
    limit: int = TOP_RULES,
) -> DataFrame:
    itemsets = frequent_itemsets(df, min_support, columns)
    return top_rules(association_rules(itemsets, min_confidence), limit)
