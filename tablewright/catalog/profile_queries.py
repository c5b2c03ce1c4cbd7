from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.tables import CUSTOMER_WITH_NULLS, customer_with_nulls, rounded, table
from tablewright.operators import profile, profile_state
from tablewright.session import scratch_path


def profile_orders(spark, d):
    return profile.profile(table(spark, d, "orders"))


def profile_customer_nulls(spark, d):
    return profile.profile(customer_with_nulls(spark, d))


def profile_lineitem(spark, d):
    return profile.profile(table(spark, d, "lineitem"))


def profile_documents(spark, d):
    return profile.profile(table(spark, d, "documents"))


def profile_single_pass(spark, d):
    # No exact counterpart for a sketch: the exact parts are compared, the sketch is not returned.
    return profile.profile_approx(customer_with_nulls(spark, d)).drop("unique_values", "sample_values")


def _order_batches(spark, d):
    """Orders in three batches by year; the first has no priority yet."""
    o, year = table(spark, d, "orders"), F.year("o_orderdate")
    path = scratch_path(spark, "profile-states")
    profile_state.add_batch(o.where(year < 1994).drop("o_orderpriority"), path, "to-1993")
    profile_state.add_batch(o.where(year.between(1994, 1996)), path, "to-1996")
    profile_state.add_batch(o.where((year > 1996) | year.isNull()), path, "to-now")
    return profile_state.merged(profile_state.read_batches(spark, path))


def profile_batches(spark, d):
    """The exact parts of the profile that is merged from the states of three batches."""
    return _order_batches(spark, d).drop("unique_estimate", "quantiles")


def profile_batches_estimates(spark, d):
    """The sketched parts: distinct values and quartiles. No SQL, as SQL has no such sketches."""
    return _order_batches(spark, d).select("column", "unique_estimate", "quantiles")


def shape_customer_nulls(spark, d):
    return profile.shape(customer_with_nulls(spark, d))


def preview_orders(spark, d):
    return profile.preview(table(spark, d, "orders"), "o_orderkey", 10)


QUERIES = {
    f.__name__: f
    for f in (
        profile_orders,
        profile_customer_nulls,
        profile_lineitem,
        profile_documents,
        profile_single_pass,
        profile_batches,
        profile_batches_estimates,
        shape_customer_nulls,
        preview_orders,
    )
}

_ORDERS = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
]
_CUSTOMER = [
    ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
    ("c_mktsegment", "string"),
]
_LINEITEM = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
]
_DOCUMENTS = [
    ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
]


def profile_sql(relation: str, columns: list[tuple[str, str]], sketch: bool = False) -> str:
    parts = []
    for i, (c, t) in enumerate(columns):
        ranged = t in ("bigint", "int", "double")
        lo, hi = (f"min({c})::DOUBLE", f"max({c})::DOUBLE") if ranged else ("NULL::DOUBLE", "NULL::DOUBLE")
        distinct = "" if sketch else f"""
             count(DISTINCT {c}) AS unique_values,
             coalesce((SELECT list(v::VARCHAR ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM base
                       WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 3)), []::VARCHAR[]) AS sample_values,"""
        parts.append(f"""
      SELECT {i} AS position, '{c}' AS "column", '{t}' AS dtype, count(*) AS num_rows,
             count(*) - count({c}) AS null_count,
             {rounded(f"100 * (count(*) - count({c})) / nullif(count(*), 0)::DOUBLE", 2)} AS null_pct,{distinct}
             {lo} AS min, {hi} AS max FROM base""")
    return f"WITH base AS ({relation})" + " UNION ALL ".join(parts)


ORACLES = {
    "profile_orders": profile_sql("SELECT * FROM orders", _ORDERS),
    "profile_customer_nulls": profile_sql(CUSTOMER_WITH_NULLS, _CUSTOMER),
    "profile_lineitem": profile_sql("SELECT * FROM lineitem", _LINEITEM),
    "profile_documents": profile_sql("SELECT * FROM documents", _DOCUMENTS),
    "profile_single_pass": profile_sql(CUSTOMER_WITH_NULLS, _CUSTOMER, sketch=True),
    "profile_batches": profile_sql(
        "SELECT * REPLACE (CASE WHEN year(o_orderdate) < 1994 THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM orders",
        _ORDERS, sketch=True),
    "shape_customer_nulls": f"""
      SELECT count(*) AS num_rows, 5 AS num_columns,
             (5 * count(*) - count(c_custkey) - count(c_name) - count(c_nationkey) - count(c_acctbal)
              - count(c_mktsegment))::BIGINT AS missing_cells
      FROM ({CUSTOMER_WITH_NULLS})""",
    "preview_orders": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
}
