from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.tables import rounded, table
from tablewright.operators import assoc


def _baskets(spark, d):
    return table(spark, d, "lineitem").select(
        F.when(F.col("l_orderkey") % 11 != 0, F.col("l_returnflag")).alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_linenumber").cast("string").alias("line"),
        F.when(F.col("l_quantity") < 10, F.lit("low")).when(F.col("l_quantity") < 35, F.lit("mid")).otherwise(F.lit("high")).alias("band"),
        (F.col("l_quantity") >= 30).alias("bulk"),
        "l_tax",
    )


def itemsets_lineitem(spark, d):
    sets = assoc.frequent_itemsets(_baskets(spark, d))
    return sets.select(F.array_join("items", ", ").alias("items"), "n")


def itemsets_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority")
    return assoc.frequent_itemsets(o, 0.01).select(F.array_join("items", ", ").alias("items"), "n")


def rules_all_splits(spark, d):
    return assoc.association_rules(assoc.frequent_itemsets(_baskets(spark, d)))


def rules_top(spark, d):
    return assoc.mine_rules(_baskets(spark, d))


QUERIES = {f.__name__: f for f in (itemsets_lineitem, itemsets_orders, rules_all_splits, rules_top)}

_SETS = """
    WITH base AS (
      SELECT 'flag_' || CASE WHEN l_orderkey % 11 <> 0 THEN l_returnflag END AS a, 'status_' || l_linestatus AS b,
             'line_' || l_linenumber::VARCHAR AS c,
             'band_' || CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 35 THEN 'mid' ELSE 'high' END AS d,
             CASE WHEN l_quantity >= 30 THEN 'bulk' END AS e FROM lineitem),
    cubed AS (
      SELECT list_sort([x FOR x IN [a, b, c, d, e] IF x IS NOT NULL]) AS items, count(*) AS n,
             count(*) / (SELECT count(*) FROM base)::DOUBLE AS support
      FROM base GROUP BY CUBE (a, b, c, d, e)
      HAVING (grouping(a) = 1 OR a IS NOT NULL) AND (grouping(b) = 1 OR b IS NOT NULL)
         AND (grouping(c) = 1 OR c IS NOT NULL) AND (grouping(d) = 1 OR d IS NOT NULL)
         AND (grouping(e) = 1 OR e IS NOT NULL)),
    sets AS MATERIALIZED (SELECT * FROM cubed WHERE len(items) > 0 AND support >= 0.05),
    parts AS MATERIALIZED (
      SELECT support, [items[i + 1] FOR i IN range(0, len(items)) IF (mask >> i) % 2 = 1] AS lhs,
             [items[i + 1] FOR i IN range(0, len(items)) IF (mask >> i) % 2 = 0] AS rhs
      FROM (SELECT items, support, unnest(range(1, (1 << len(items)) - 1)) AS mask FROM sets WHERE len(items) > 1)),
    rules AS (
      SELECT array_to_string(l.items, ', ') AS antecedent, array_to_string(r.items, ', ') AS consequent,
             s.support AS sup, s.support / l.support AS conf, s.support / l.support / r.support AS lft
      FROM parts s JOIN sets l ON s.lhs = l.items JOIN sets r ON s.rhs = r.items),
    final AS (
      SELECT antecedent, consequent, SUP AS support, CONF AS confidence, LFT AS lift FROM rules WHERE conf >= 0.6)
""".replace("SUP", rounded("sup", 3)).replace("CONF", rounded("conf", 3)).replace("LFT", rounded("lft", 3))

ORACLES = {
    "itemsets_lineitem": _SETS + "SELECT array_to_string(items, ', ') AS items, n FROM sets",
    "itemsets_orders": """
      WITH base AS (SELECT 'o_orderstatus_' || o_orderstatus AS a, 'o_orderpriority_' || o_orderpriority AS b FROM orders)
      SELECT array_to_string(list_sort([x FOR x IN [a, b] IF x IS NOT NULL]), ', ') AS items, count(*) AS n
      FROM base GROUP BY CUBE (a, b)
      HAVING grouping(a) + grouping(b) < 2 AND count(*) / (SELECT count(*) FROM base)::DOUBLE >= 0.01""",
    "rules_all_splits": _SETS + "SELECT * FROM final",
    "rules_top": _SETS + "SELECT * FROM final ORDER BY lift DESC, confidence DESC, antecedent, consequent LIMIT 10",
}
