from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.tables import rounded, table
from tablewright.functions.columns import columns_where, is_number, round_half_up
from tablewright.operators import features, split


def _orders_with_gaps(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("o_orderdate"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_orderpriority",
        (F.col("o_totalprice") > 250000).alias("large"),
    )


def _rounded(df, places=4):
    doubles = columns_where(df, is_number)
    return df.select(*[round_half_up(df[f"`{c}`"], places).alias(c) if c in doubles and c != "o_orderkey" else df[f"`{c}`"] for c in df.columns])


def features_orders(spark, d):
    o = _orders_with_gaps(spark, d)
    return _rounded(features.fit_features(o, exclude=["o_orderkey"]).transform(o, keep=["o_orderkey"]))


def _text_dates(spark, d, every):
    o = table(spark, d, "orders")
    day = F.when(F.col("o_orderkey") % every == 0, F.lit("bad")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", day.alias("order_date"), "o_totalprice")


def features_string_dates(spark, d):
    o = _text_dates(spark, d, 4)
    return _rounded(features.fit_features(o, exclude=["o_orderkey"]).transform(o, keep=["o_orderkey"]))


def features_string_dates_rejected(spark, d):
    """Half of the texts parse, which is too few: the column stays text."""
    o = _text_dates(spark, d, 2)
    model = features.fit_features(o, exclude=["o_orderkey"])
    return spark.createDataFrame([(len(model.date_texts), "order_date_year" in model.columns)], "date_columns int, expanded boolean")


def features_high_card(spark, d):
    c = table(spark, d, "customer")
    return _rounded(features.fit_features(c).transform(c, keep=["c_custkey"]).drop("c_custkey").withColumn("n", F.lit(1)))


def features_wide_categories(spark, d):
    """More categories than indicator columns allowed: each row carries one sparse vector."""
    from pyspark.ml.functions import vector_to_array

    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    model = features.fit_features(p, exclude=["p_partkey"], max_indicators=10)
    out = model.transform(p, keep=["p_partkey"])
    a = vector_to_array("p_brand_onehot")
    return out.select(
        "p_partkey", "p_size", F.size(a).alias("width"), F.aggregate(a, F.lit(0.0), lambda s, x: s + x).alias("ones")
    )


def standardise_lineitem(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", F.lit(1.0).alias("one"))
    return _rounded(features.fit_standardiser(li, li.columns).transform(li), 6)


def label_encode(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority")
    )
    return features.label_encode(o, "o_orderpriority").drop("o_orderpriority")


def split_rows(spark, d):
    return split.split_70_15_15(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), key="o_orderkey")


def split_counts(spark, d):
    return split.split_counts(split_rows(spark, d))


def split_stratified(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return split.split_70_15_15(o, key="o_orderkey", stratify="o_orderpriority")


def split_with_copies(spark, d):
    """No key column and many copies: the sizes are exact all the same."""
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_discount")
    return split.split_counts(split.split_70_15_15(li))


def row_index(spark, d):
    o = split.dense_row_index(table(spark, d, "orders").select("o_orderkey"))
    return o.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("row_index").alias("first"),
        F.max("row_index").alias("last"),
        F.sum("row_index").alias("total"),
        F.sum("o_orderkey").alias("keys"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        features_orders,
        features_string_dates,
        features_string_dates_rejected,
        features_high_card,
        features_wide_categories,
        standardise_lineitem,
        label_encode,
        split_rows,
        split_counts,
        split_stratified,
        split_with_copies,
        row_index,
    )
}


def _indicators(column: str, values: list[str]) -> str:
    return ", ".join(
        f"CASE WHEN {column} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"{column}_{v}\"" for v in values
    )


_PRIORITIES = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_SPLIT = """
    ranked AS (SELECT *, row_number() OVER ({part} ORDER BY md5(o_orderkey::VARCHAR || '42')) AS r,
                      count(*) OVER ({part}) AS n FROM orders),
    sized AS (SELECT *, CASE WHEN n > 1 THEN (3 * n + 9) // 10 ELSE 0 END AS held FROM ranked),
    placed AS (SELECT *, CASE WHEN r <= n - held THEN 'train' WHEN r <= n - (held + 1) // 2 THEN 'val' ELSE 'test' END AS split
               FROM sized)
"""
_SHARES = """
    SELECT split, n, floor(100.0::DOUBLE * n / (SELECT sum(n) FROM c)::DOUBLE * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS share_pct
    FROM c"""
_DATE_PART = "coalesce({p}, (SELECT median({p}) FROM x))"

ORACLES = {
    "features_orders": f"""
      WITH base AS (
        SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
               CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS dt,
               CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS o_orderstatus,
               o_orderpriority, o_totalprice > 250000 AS large FROM orders),
      x AS (SELECT *, year(dt)::DOUBLE AS y, month(dt)::DOUBLE AS mo, day(dt)::DOUBLE AS da,
                   (isodow(dt) - 1)::DOUBLE AS dw FROM base)
      SELECT o_orderkey, {rounded("coalesce(o_totalprice, (SELECT median(o_totalprice) FROM x))", 4)} AS o_totalprice,
             {_DATE_PART.format(p="y")} AS o_orderdate_year, {_DATE_PART.format(p="mo")} AS o_orderdate_month,
             {_DATE_PART.format(p="da")} AS o_orderdate_day, {_DATE_PART.format(p="dw")} AS o_orderdate_dayofweek,
             CASE WHEN large THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS large,
             {_indicators("o_orderstatus", ["O", "P"])}, {_indicators("o_orderpriority", _PRIORITIES)} FROM x""",
    "features_string_dates": f"""
      SELECT o_orderkey, {rounded("o_totalprice", 4)} AS o_totalprice,
             CASE WHEN o_orderkey % 4 = 0 THEN 2026 ELSE year(o_orderdate) END::DOUBLE AS order_date_year,
             CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE month(o_orderdate) END::DOUBLE AS order_date_month,
             CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE day(o_orderdate) END::DOUBLE AS order_date_day,
             CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE isodow(o_orderdate) - 1 END::DOUBLE AS order_date_dayofweek
      FROM orders""",
    "features_string_dates_rejected": """
      SELECT CASE WHEN avg(CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE 1.0 END) > 0.6 THEN 1 ELSE 0 END AS date_columns,
             avg(CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE 1.0 END) > 0.6 AS expanded FROM orders""",
    "features_high_card": f"""
      SELECT c_nationkey::DOUBLE AS c_nationkey, {rounded("c_acctbal", 4)} AS c_acctbal,
             {_indicators("c_mktsegment", _SEGMENTS)}, 1.0::DOUBLE AS n FROM customer""",
    "features_wide_categories": """
      SELECT p_partkey, p_size::DOUBLE AS p_size, ((SELECT count(DISTINCT p_brand) FROM part) - 1)::INTEGER AS width,
             CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ones FROM part""",
    "standardise_lineitem": f"""
      WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp,
                        stddev_pop(l_extendedprice) AS sp FROM lineitem)
      SELECT {rounded("(l_quantity - mq) / sq", 6)} AS l_quantity,
             {rounded("(l_extendedprice - mp) / sp", 6)} AS l_extendedprice, 0.0::DOUBLE AS one FROM lineitem, s""",
    "label_encode": """
      WITH base AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS p FROM orders),
      codes AS (SELECT p, (row_number() OVER (ORDER BY p) - 1)::INTEGER AS code FROM (SELECT DISTINCT p FROM base WHERE p IS NOT NULL))
      SELECT o_orderkey, coalesce(code, -1) AS label_code FROM base LEFT JOIN codes USING (p)""",
    "split_rows": f"WITH {_SPLIT.format(part='')} SELECT o_orderkey, o_orderstatus, split FROM placed",
    "split_counts": f"WITH {_SPLIT.format(part='')}, c AS (SELECT split, count(*) AS n FROM placed GROUP BY 1) {_SHARES}",
    "split_stratified": f"WITH {_SPLIT.format(part='PARTITION BY o_orderpriority')} SELECT o_orderkey, o_orderpriority, split FROM placed",
    "split_with_copies": f"""
      WITH t AS (SELECT count(*) AS n, (3 * count(*) + 9) // 10 AS held FROM lineitem),
      c AS (SELECT 'train' AS split, n - held AS n FROM t UNION ALL SELECT 'val', held - (held + 1) // 2 FROM t
            UNION ALL SELECT 'test', (held + 1) // 2 FROM t) {_SHARES}""",
    "row_index": """
      SELECT count(*) AS n, 0::BIGINT AS first, count(*) - 1 AS last, (count(*) * (count(*) - 1) // 2)::BIGINT AS total,
             sum(o_orderkey)::BIGINT AS keys FROM orders""",
}
