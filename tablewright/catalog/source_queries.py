from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.tables import CUSTOMER_WITH_NULLS, customer_with_nulls, table
from tablewright.operators import synth
from tablewright.session import scratch_path
from tablewright.sources import jsonlines, readers


def csv_roundtrip(spark, d):
    """The customer table with gaps, written as CSV and read back with inferred types."""
    path = scratch_path(spark, "customer-csv")
    readers.write_csv(customer_with_nulls(spark, d), path)
    return readers.read_csv(spark, path)


def csv_null_tokens(spark, d):
    tokens = F.element_at(F.array(*[F.lit(t) for t in ("NA", "n/a", "NULL", "-nan", "#N/A")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderkey") % 7 == 0, tokens).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 11 == 0, tokens).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_orderstatus") == "F", F.lit("True")).otherwise(F.lit("False")).alias("finished"),
    )
    return readers.infer_column_types(readers.null_tokens_to_null(o))


def _event_lines(spark, d):
    """Event properties as lines, every fiftieth broken and every ninetieth blank."""
    return table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 50 == 0, F.lit("{broken")).when(F.col("event_id") % 90 == 1, F.lit(" ")).otherwise(F.col("props")).alias("line"),
    )


def json_props(spark, d):
    return jsonlines.parse_json_lines(_event_lines(spark, d), "line")[0]


def json_quarantine(spark, d):
    return jsonlines.parse_json_lines(_event_lines(spark, d), "line")[1]


def json_flatten(spark, d):
    """Nested objects of a JSON-lines file become dotted columns."""
    nested = table(spark, d, "events").select(
        F.to_json(
            F.struct(
                F.col("event_id").alias("id"),
                F.struct(F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("kind")).alias("last")).alias("user"),
                F.from_json("props", "k bigint").alias("props"),
            )
        ).alias("value")
    )
    path = scratch_path(spark, "events-jsonl")
    nested.write.text(path)
    rows, _ = readers.read_json_lines(spark, path)
    return jsonlines.flatten(rows)


def _event_objects(spark, d):
    return table(spark, d, "events").select(
        F.to_json(F.struct("event_id", F.struct("user_id", "event_type").alias("by"), F.from_json("props", "k bigint").alias("props"))).alias("value")
    )


def read_any_json_lines(spark, d):
    """Every event, from a .json path with one object per line."""
    path = scratch_path(spark, "events") + ".json"
    _event_objects(spark, d).write.text(path)
    return readers.read_any(spark, path)


def read_any_log_with_bad_lines(spark, d):
    """Rows and quarantined lines of a log in which every seventh line is cut off."""
    path = scratch_path(spark, "events") + ".log"
    cut = F.expr("get_json_object(value, '$.event_id') % 7 = 3")
    lines = _event_objects(spark, d).withColumn("cut", cut)
    lines.select(F.when(F.col("cut"), F.expr("substr(value, 1, 20)")).otherwise(F.col("value")).alias("value")).write.text(path)
    rows, bad = readers.read_json(spark, path)
    whole = rows.select("event_id", F.lit("row").alias("part"), F.col("`by.event_type`").alias("text"))
    return whole.unionByName(bad.select(F.lit(None).cast("bigint").alias("event_id"), F.lit("line").alias("part"), F.col("line").alias("text")))


def read_any_json_document(spark, d):
    """Nations as one indented JSON list per region, each in a file of its own."""
    path = scratch_path(spark, "nations") + ".json"
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(
        F.lit('  {"key": '), x["n_nationkey"].cast("string"), F.lit(',\n   "nation": {"name": "'), x["n_name"], F.lit('"}}')))
    lists = table(spark, d, "nation").groupBy("n_regionkey").agg(
        F.concat(F.lit("[\n"), F.array_join(rows, ",\n"), F.lit("\n]")).alias("value")
    )
    lists.repartition(5, "n_regionkey").write.partitionBy("n_regionkey").text(path)
    return readers.read_any(spark, path).drop("n_regionkey")


def csv_documents_roundtrip(spark, d):
    """Texts with line breaks, written as CSV and read back."""
    path = scratch_path(spark, "documents") + ".csv"
    readers.write_csv(table(spark, d, "documents"), path)
    return readers.read_any(spark, path)


def text_lines(spark, d):
    """Document texts written as a text file and read back line by line."""
    path = scratch_path(spark, "texts")
    table(spark, d, "documents").select("text").write.text(path)
    lines = readers.read_text(spark, path, whole=False).select("text")
    return lines.agg(F.count_if(F.length("text") > 0).alias("filled_lines"), F.sum(F.length("text")).alias("chars"))


def synthesise_customer(spark, d):
    """The customer table doubled: counts, category support, bounds and moments of the new rows."""
    c = table(spark, d, "customer").withColumn(
        "c_mktsegment", F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment"))
    )
    n = c.count()
    out, grown = synth.synthesise(c, min_rows=n + 1, target_rows=2 * n)
    named = out.join(c.select(F.col("c_name").alias("known")).distinct(), F.col("c_name") == F.col("known"), "left")
    return named.groupBy("is_synthetic").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("c_mktsegment").alias("segments"),
        F.count_if(F.col("known").isNull()).alias("unknown_names"),
        F.count_if(F.col("c_mktsegment").isNull()).alias("null_segments"),
        (F.count_if((F.col("c_acctbal") < -20000) | (F.col("c_acctbal") > 30000)) == 0).alias("balance_in_range"),
        F.lit(grown).alias("grown"),
    )


def synthesise_not_needed(spark, d):
    out, grown = synth.synthesise(table(spark, d, "customer"), min_rows=30)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_synthetic").alias("synthetic"), F.lit(grown).alias("grown"))


QUERIES = {
    f.__name__: f
    for f in (
        csv_roundtrip,
        csv_null_tokens,
        json_props,
        json_quarantine,
        json_flatten,
        read_any_json_lines,
        read_any_log_with_bad_lines,
        read_any_json_document,
        csv_documents_roundtrip,
        text_lines,
        synthesise_customer,
        synthesise_not_needed,
    )
}

ORACLES = {
    "csv_roundtrip": f"SELECT * REPLACE (c_nationkey::BIGINT AS c_nationkey) FROM ({CUSTOMER_WITH_NULLS})",
    "csv_null_tokens": """
      SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
             CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS o_orderpriority, o_orderstatus = 'F' AS finished
      FROM orders""",
    "json_props": """
      SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 50 <> 0 AND event_id % 90 <> 1""",
    "json_quarantine": """
      SELECT event_id, '{broken' AS line, 'not a JSON object' AS reason FROM events WHERE event_id % 50 = 0""",
    "json_flatten": """
      SELECT event_id AS id, user_id AS "user.id", event_type AS "user.last.kind", json_extract(props, '$.k')::BIGINT AS "props.k"
      FROM events""",
    "read_any_json_lines": """
      SELECT event_id, user_id AS "by.user_id", event_type AS "by.event_type", json_extract(props, '$.k')::BIGINT AS "props.k" FROM events""",
    "read_any_log_with_bad_lines": """
      SELECT event_id, 'row' AS part, event_type AS text FROM events WHERE event_id % 7 <> 3
      UNION ALL SELECT NULL, 'line', substr('{"event_id":' || event_id::VARCHAR || ',"by":{"user_id":' || user_id::VARCHAR, 1, 20)
      FROM events WHERE event_id % 7 = 3""",
    "read_any_json_document": "SELECT n_nationkey::BIGINT AS key, n_name AS \"nation.name\" FROM nation",
    "csv_documents_roundtrip": "SELECT * FROM documents",
    "text_lines": """
      SELECT (SELECT count(*) FROM (SELECT unnest(string_split(text, chr(10))) AS s FROM documents) WHERE length(s) > 0) AS filled_lines,
             (SELECT sum(length(replace(text, chr(10), '')))::BIGINT FROM documents) AS chars""",
    "synthesise_customer": """
      WITH c AS (SELECT count(*) AS n, count(DISTINCT CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END) AS segments,
                        count(*) FILTER (c_custkey % 11 = 0) AS gaps FROM customer)
      SELECT false AS is_synthetic, n, segments, 0::BIGINT AS unknown_names, gaps AS null_segments, true AS balance_in_range, true AS grown FROM c
      UNION ALL SELECT true, n, segments, 0, 0, true, true FROM c""",
    "synthesise_not_needed": "SELECT count(*) AS n, 0::BIGINT AS synthetic, false AS grown FROM customer",
}
