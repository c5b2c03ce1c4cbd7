from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.tables import CUSTOMER_WITH_NULLS, customer_with_nulls, rounded, table
from tablewright.functions.columns import py_round_half_up, round_half_up
from tablewright.functions.ranks import exact_medians
from tablewright.operators import clean, profile, rules

RECIPE = clean.CleaningRecipe(
    replace_negatives_with_null=("c_acctbal", "c_name", "absent"),
    impute_median=("c_acctbal",),
    impute_mode=("c_mktsegment",),
    drop_columns=("c_name",),
)
DROP_RECIPE = clean.CleaningRecipe(
    replace_negatives_with_null=("c_acctbal",),
    drop_rows_with_nulls_in=("c_mktsegment", "c_acctbal"),
    drop_columns=("c_nationkey", "c_name"),
)


def clean_customer(spark, d):
    out, _ = clean.clean(customer_with_nulls(spark, d), RECIPE)
    return out.withColumn("c_acctbal", round_half_up(out["c_acctbal"], 3))


def clean_customer_drop_rows(spark, d):
    out, _ = clean.clean(customer_with_nulls(spark, d), DROP_RECIPE)
    return out


def clean_log(spark, d):
    _, log = clean.clean(customer_with_nulls(spark, d), RECIPE)
    return log.select("step", "action", "column", "n_affected")


def clean_log_drop_rows(spark, d):
    _, log = clean.clean(customer_with_nulls(spark, d), DROP_RECIPE)
    return log.drop("fill_value")


def clean_lineitem_medians(spark, d):
    """Medians of four columns of the largest table after one column lost part of its values."""
    li = table(spark, d, "lineitem").select(
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_quantity",
        "l_discount",
        "l_partkey",
    )
    rows = [(c, py_round_half_up(v, 4)) for c, v in exact_medians(li, li.columns).items()]
    return spark.createDataFrame(rows, "column string, median double")


def intent_orders(spark, d):
    columns = rules.column_profiles(profile.profile(table(spark, d, "orders")))
    return rules.intent_table(spark, rules.infer_intent(columns))


def intent_named_target(spark, d):
    columns = rules.column_profiles(profile.profile(table(spark, d, "orders")))
    return rules.intent_table(spark, rules.infer_intent(columns, "predict o_totalprice for planning"))


def recipe_customer(spark, d):
    columns = rules.column_profiles(profile.profile(customer_with_nulls(spark, d)))
    return rules.recipe_table(spark, rules.derive_recipe(columns, "c_mktsegment", positive=["c_acctbal"]))


def recipe_customer_default(spark, d):
    """The default hints: an account balance may be negative and stays as it is."""
    columns = rules.column_profiles(profile.profile(customer_with_nulls(spark, d)))
    return rules.recipe_table(spark, rules.derive_recipe(columns, "c_mktsegment"))


def recipe_lineitem_default(spark, d):
    """The default hints on a table with quantities; a discount is no count and an extended price no price."""
    li = table(spark, d, "lineitem").select(
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"), "l_discount",
        F.when(F.col("l_orderkey") % 9 != 0, F.col("l_tax")).alias("tax_change_amount"), "l_returnflag",
    )
    return rules.recipe_table(spark, rules.derive_recipe(rules.column_profiles(profile.profile(li)), "l_returnflag"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_customer,
        clean_customer_drop_rows,
        clean_log,
        clean_log_drop_rows,
        clean_lineitem_medians,
        intent_orders,
        intent_named_target,
        recipe_customer,
        recipe_customer_default,
        recipe_lineitem_default,
    )
}

_STEP1 = f"""
    WITH base AS ({CUSTOMER_WITH_NULLS}),
    step1 AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal,
                     c_mktsegment FROM base),
    fill AS (SELECT (SELECT median(c_acctbal) FROM step1) AS med,
                    (SELECT c_mktsegment FROM step1 WHERE c_mktsegment IS NOT NULL
                     GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode)
"""
_TOTALPRICE_TASK = "CASE WHEN count(DISTINCT {c}) > 20 AND count(DISTINCT {c}) / count(*)::DOUBLE > 0.05 THEN 'Regression' ELSE 'Classification' END"

ORACLES = {
    "clean_customer": _STEP1 + f"""
      SELECT c_custkey, c_nationkey, {rounded("coalesce(c_acctbal, (SELECT med FROM fill))", 3)} AS c_acctbal,
             coalesce(c_mktsegment, (SELECT mode FROM fill)) AS c_mktsegment FROM step1""",
    "clean_customer_drop_rows": _STEP1
    + "SELECT c_custkey, c_acctbal, c_mktsegment FROM step1 WHERE c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL",
    "clean_log": _STEP1 + """
      SELECT 1 AS step, 'negative_to_null' AS action, 'c_acctbal' AS "column",
             (SELECT count(*) FROM base WHERE c_acctbal < 0) AS n_affected
      UNION ALL SELECT 2, 'impute_median', 'c_acctbal', (SELECT count(*) FROM step1 WHERE c_acctbal IS NULL)
      UNION ALL SELECT 3, 'impute_mode', 'c_mktsegment', (SELECT count(*) FROM step1 WHERE c_mktsegment IS NULL)
      UNION ALL SELECT 4, 'drop_column', 'c_name', 0""",
    "clean_log_drop_rows": _STEP1 + """,
      raw AS (
        SELECT 1 AS step, 'negative_to_null' AS action, 'c_acctbal' AS "column",
               (SELECT count(*) FROM base WHERE c_acctbal < 0) AS n_affected, ' negative values set to missing' AS m
        UNION ALL SELECT 2, 'drop_rows', 'c_mktsegment', (SELECT count(*) FROM step1 WHERE c_mktsegment IS NULL),
               ' rows dropped because the column is missing'
        UNION ALL SELECT 3, 'drop_rows', 'c_acctbal',
               (SELECT count(*) FROM step1 WHERE c_mktsegment IS NOT NULL AND c_acctbal IS NULL),
               ' rows dropped because the column is missing'
        UNION ALL SELECT 4, 'drop_column', 'c_nationkey', 0, ' column dropped'
        UNION ALL SELECT 5, 'drop_column', 'c_name', 0, ' column dropped')
      SELECT step, action, "column", n_affected, "column" || ': ' || n_affected::VARCHAR || m AS message FROM raw""",
    "clean_lineitem_medians": f"""
      SELECT 'l_extendedprice' AS "column",
             {rounded("median(CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END)", 4)} AS median FROM lineitem
      UNION ALL SELECT 'l_quantity', {rounded("median(l_quantity)", 4)} FROM lineitem
      UNION ALL SELECT 'l_discount', {rounded("median(l_discount)", 4)} FROM lineitem
      UNION ALL SELECT 'l_partkey', {rounded("median(l_partkey)", 4)} FROM lineitem""",
    "intent_orders": f"""
      WITH t AS (SELECT count(DISTINCT o_orderstatus) AS u FROM orders)
      SELECT CASE WHEN u > 1 THEN 'Classification' ELSE 'Clustering / Segmentation' END AS task,
             CASE WHEN u > 1 THEN 'o_orderstatus' END AS target,
             CASE WHEN u > 1 THEN 'the name of o_orderstatus marks a target' ELSE 'no obvious target' END AS reasoning
      FROM t""",
    "intent_named_target": f"""
      SELECT {_TOTALPRICE_TASK.format(c="o_totalprice")} AS task, 'o_totalprice' AS target,
             'the goal names o_totalprice' AS reasoning FROM orders""",
    "recipe_customer": f"""
      WITH base AS ({CUSTOMER_WITH_NULLS}),
      c AS (
        SELECT 0 AS p, 'c_custkey' AS name, true AS num, count(*) AS n, count(DISTINCT c_custkey) AS u,
               count(*) - count(c_custkey) AS z FROM base
        UNION ALL SELECT 1, 'c_name', false, count(*), count(DISTINCT c_name), count(*) - count(c_name) FROM base
        UNION ALL SELECT 2, 'c_nationkey', true, count(*), count(DISTINCT c_nationkey), count(*) - count(c_nationkey) FROM base
        UNION ALL SELECT 3, 'c_acctbal', true, count(*), count(DISTINCT c_acctbal), count(*) - count(c_acctbal) FROM base),
      k AS (SELECT *, (u = n AND n > 1 AND name <> 'c_acctbal') OR u <= 1 AS gone FROM c),
      steps AS (
        SELECT 'drop_columns' AS action, p, name FROM k WHERE gone
        UNION ALL SELECT 'impute_median', p, name FROM k WHERE NOT gone AND num AND (z > 0 OR name = 'c_acctbal')
        UNION ALL SELECT 'impute_mode', p, name FROM k WHERE NOT gone AND NOT num AND z > 0
        UNION ALL SELECT 'replace_negatives_with_null', p, name FROM k WHERE NOT gone AND name = 'c_acctbal'
        UNION ALL SELECT 'drop_rows_with_nulls_in', 0, 'c_mktsegment')
      SELECT action, (row_number() OVER (PARTITION BY action ORDER BY p) - 1)::INTEGER AS ordinal, name AS "column"
      FROM steps""",
    "recipe_customer_default": f"""
      WITH base AS ({CUSTOMER_WITH_NULLS}),
      c AS (
        SELECT 0 AS p, 'c_custkey' AS name, true AS num, count(*) AS n, count(DISTINCT c_custkey) AS u,
               count(*) - count(c_custkey) AS z FROM base
        UNION ALL SELECT 1, 'c_name', false, count(*), count(DISTINCT c_name), count(*) - count(c_name) FROM base
        UNION ALL SELECT 2, 'c_nationkey', true, count(*), count(DISTINCT c_nationkey), count(*) - count(c_nationkey) FROM base
        UNION ALL SELECT 3, 'c_acctbal', true, count(*), count(DISTINCT c_acctbal), count(*) - count(c_acctbal) FROM base),
      k AS (SELECT *, (u = n AND n > 1 AND name <> 'c_acctbal') OR u <= 1 AS gone FROM c),
      steps AS (
        SELECT 'drop_columns' AS action, p, name FROM k WHERE gone
        UNION ALL SELECT 'impute_median', p, name FROM k WHERE NOT gone AND num AND z > 0
        UNION ALL SELECT 'impute_mode', p, name FROM k WHERE NOT gone AND NOT num AND z > 0
        UNION ALL SELECT 'drop_rows_with_nulls_in', 0, 'c_mktsegment')
      SELECT action, (row_number() OVER (PARTITION BY action ORDER BY p) - 1)::INTEGER AS ordinal, name AS "column"
      FROM steps""",
    "recipe_lineitem_default": """
      SELECT 'replace_negatives_with_null' AS action, 0 AS ordinal, 'l_quantity' AS "column"
      UNION ALL SELECT 'impute_median', 0, 'l_quantity' FROM lineitem HAVING count(*) FILTER (l_orderkey % 7 = 0) > 0
      UNION ALL SELECT 'impute_median', 1, 'tax_change_amount' FROM lineitem HAVING count(*) FILTER (l_orderkey % 9 = 0) > 0
      UNION ALL SELECT 'drop_rows_with_nulls_in', 0, 'l_returnflag'""",
}
