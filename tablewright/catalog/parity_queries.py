from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.tables import rounded, table
from tablewright.operators import parity


def _labelled(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality")
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return labels.join(docs, "doc_id")


def _customer_orders(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    return o.join(c, o["o_custkey"] == c["c_custkey"])


def parity_quality_source(spark, d):
    return parity.parity_audit(_labelled(spark, d), "source", "quality")


def parity_quality_verdict(spark, d):
    return parity.parity_verdict(_labelled(spark, d), "source", "quality")


def parity_violating_sources(spark, d):
    return parity.parity_violations(parity_quality_source(spark, d))


def parity_all_slices(spark, d):
    return parity.parity_audit_all(_labelled(spark, d), ["source", "lang"], "quality")


def parity_segment_status(spark, d):
    return parity.parity_audit(_customer_orders(spark, d), "c_mktsegment", "o_orderstatus", favorable="F")


def parity_segment_verdict(spark, d):
    return parity.parity_verdict(_customer_orders(spark, d), "c_mktsegment", "o_orderstatus", favorable="F")


def parity_null_outcome(spark, d):
    df = _labelled(spark, d).select(
        F.when(F.col("doc_id") % 13 != 0, F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 5 != 0, F.col("quality")).alias("quality"),
    )
    return parity.parity_audit(df, "source", "quality")


def parity_default_mode(spark, d):
    return parity.parity_verdict(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


def parity_bool_outcome(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").alias("finished"))
    return parity.parity_audit(o, "o_orderpriority", "finished")


def parity_chart(spark, d):
    return parity.parity_chart(parity_quality_source(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        parity_quality_source,
        parity_quality_verdict,
        parity_violating_sources,
        parity_all_slices,
        parity_segment_status,
        parity_segment_verdict,
        parity_null_outcome,
        parity_default_mode,
        parity_bool_outcome,
        parity_chart,
    )
}


def _audit(base: str, fav: str) -> str:
    """Cohort table over a relation (s, o); ``fav`` is an expression over the relation ``base``."""
    return f"""
    WITH base AS ({base}),
    fav AS (SELECT {fav} AS v),
    rates AS (
      SELECT s, count(*) AS n,
             {rounded("avg(CASE WHEN o = (SELECT v FROM fav) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", 4)} AS rate
      FROM base WHERE s IS NOT NULL GROUP BY s),
    judged AS (
      SELECT s AS cohort, n, rate,
             CASE WHEN max(rate) OVER () > 0 THEN {rounded("rate / max(rate) OVER ()", 3)} ELSE 1.0::DOUBLE END AS ratio
      FROM rates),
    audit AS (
      SELECT cohort::VARCHAR AS cohort, n, rate, ratio, 0.8::DOUBLE AS floor, ratio < 0.8::DOUBLE AS violation
      FROM judged)
    """


_LABELLED = "SELECT d.source AS s, l.quality AS o FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
_SEGMENT = "SELECT c_mktsegment AS s, o_orderstatus AS o FROM orders JOIN customer ON o_custkey = c_custkey"
_MAX = "(SELECT max(o) FROM base)"
_MODE = "(SELECT o FROM base WHERE o IS NOT NULL GROUP BY o ORDER BY count(*) DESC, o LIMIT 1)"


def _verdict(base: str, fav: str) -> str:
    return (
        _audit(base, fav)
        + """
    SELECT CASE WHEN count(*) FILTER (violation) = 0 THEN 'PASS' ELSE 'WARNING' END AS status,
           (SELECT v::VARCHAR FROM fav) AS favorable,
           (SELECT cohort FROM audit ORDER BY rate DESC, cohort LIMIT 1) AS benchmark_cohort,
           max(rate) AS benchmark_rate,
           count(*) AS n_cohorts,
           sum(n)::BIGINT AS n_rows,
           count(*) FILTER (violation) AS n_violations,
           CASE WHEN count(*) FILTER (violation) = 0
                THEN 'Every cohort reaches four fifths of the benchmark rate.'
                ELSE (count(*) FILTER (violation))::VARCHAR || ' cohort(s) stay below four fifths of the rate of '
                     || (SELECT cohort FROM audit ORDER BY rate DESC, cohort LIMIT 1) || '.' END AS verdict
    FROM audit"""
    )


ORACLES = {
    "parity_quality_source": _audit(_LABELLED, _MAX) + "SELECT * FROM audit",
    "parity_quality_verdict": _verdict(_LABELLED, _MAX),
    "parity_violating_sources": _audit(_LABELLED, _MAX) + "SELECT cohort, rate, ratio FROM audit WHERE violation",
    "parity_all_slices": "SELECT 'source' AS attribute, * FROM ("
    + _audit(_LABELLED, _MAX)
    + "SELECT * FROM audit) UNION ALL SELECT 'lang' AS attribute, * FROM ("
    + _audit(_LABELLED.replace("d.source", "d.lang"), _MAX)
    + "SELECT * FROM audit)",
    "parity_segment_status": _audit(_SEGMENT, "'F'") + "SELECT * FROM audit",
    "parity_segment_verdict": _verdict(_SEGMENT, "'F'"),
    "parity_null_outcome": _audit(
        """SELECT CASE WHEN l.doc_id % 13 <> 0 THEN d.source END AS s, CASE WHEN l.doc_id % 5 <> 0 THEN l.quality END AS o
           FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
        _MAX,
    )
    + "SELECT * FROM audit",
    "parity_default_mode": _verdict("SELECT o_orderstatus AS s, o_orderpriority AS o FROM orders", _MODE),
    "parity_bool_outcome": _audit("SELECT o_orderpriority AS s, o_orderstatus = 'F' AS o FROM orders", "true")
    + "SELECT * FROM audit",
    "parity_chart": _audit(_LABELLED, _MAX) + "SELECT cohort, ratio, floor FROM audit",
}
