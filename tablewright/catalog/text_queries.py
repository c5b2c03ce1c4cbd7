from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.tables import table
from tablewright.functions.columns import round_half_up
from tablewright.operators import text
from tablewright.plans import unstructured
from tablewright.session import spread

LEXICON = text.Lexicon(
    categories={
        "english": ("the", "of", "and", "to", "in"),
        "german": ("der", "die", "und", "das", "ist"),
        "french": ("de", "la", "le", "les", "des"),
    },
    positive=("for", "with", "von", "que"),
    negative=("is", "was", "nicht", "pas"),
    urgent=("on", "as", "en"),
    action=("this", "that", "it"),
)
DIRECTIVE = {
    "words_with_th": (r"\b(th[a-z]+)", "string"),
    "first_number": (r"([0-9]+)", "bigint"),
    "not_a_number": (r"([A-Z][a-z]+)", "bigint"),
}


def _documents(spark, d):
    """The given file is a single row group; text work is spread over the cores while the table is small."""
    return spread(table(spark, d, "documents"))


def chunks_paragraph(spark, d):
    out = text.chunk_documents(_documents(spark, d), "doc_id", "text", separator="\n")
    return out.where("kind = 'paragraph'").drop("kind")


def chunks_window(spark, d):
    """Documents whose every paragraph is short fall back to windows over the whole text."""
    docs = _documents(spark, d).select("doc_id", F.replace("text", F.lit(" "), F.lit("\n\n")).alias("text"))
    return text.chunk_documents(docs, "doc_id", "text").where("kind = 'window'").drop("kind")


def chunks_capped(spark, d):
    """The report's cap: the first 30 chunks of each document."""
    out = text.chunk_documents(_documents(spark, d), "doc_id", "text", separator="\n", max_chunks=text.CHUNK_CAP)
    return out.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("chunk")).alias("chars"))


def batch_records(spark, d):
    c = table(spark, d, "conversations").withColumn(
        "text", F.when(F.col("turn") % 3 == 0, F.lit(" \n ")).otherwise(F.col("text"))
    )
    return text.batch(c, ["conv_id", "turn"], "text").select("conv_id", "turn")


def extract_records(spark, d):
    out = text.extract_records(table(spark, d, "conversations"), "text", LEXICON, keep=["conv_id", "turn"])
    return out.withColumn("sentiment_score", round_half_up(F.col("sentiment_score"), 6))


def extract_topic(spark, d):
    return text.main_topic(table(spark, d, "conversations"), ["conv_id", "turn"], "text")


def extract_topic_documents(spark, d):
    return text.main_topic(_documents(spark, d), ["doc_id"], "text")


def extract_directive(spark, d):
    return text.extract_fields(_documents(spark, d), "text", DIRECTIVE, keep=["doc_id"])


def extract_rejects(spark, d):
    c = table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.lit("  ")).otherwise(F.col("text")).alias("text")
    )
    fields = text.extract_fields(c, "text", {"der": (r"\b(der)\b", "string"), "the": (r"\b(the)\b", "string")}, keep=c.columns)
    return text.split_rejects(fields, "text", ["der", "the"])[1].drop("text")


def text_table(spark, d):
    """The records of every chunk of every document, with their topics."""
    out = unstructured.text_table(_documents(spark, d), "doc_id", "text", LEXICON, separator="\n")[0]
    return out.withColumn("sentiment_score", round_half_up(F.col("sentiment_score"), 6))


def union_ragged(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("amount"), F.col("p_brand").alias("brand"))
    return text.union_records(orders, parts)


QUERIES = {
    f.__name__: f
    for f in (
        chunks_paragraph,
        chunks_window,
        chunks_capped,
        batch_records,
        extract_records,
        extract_topic,
        extract_topic_documents,
        extract_directive,
        extract_rejects,
        text_table,
        union_ragged,
    )
}

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PARTS = f"""
    WITH parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i
                   FROM documents),
    kept AS (SELECT doc_id, i, {_TRIM.format("s")} AS chunk FROM parts WHERE length({_TRIM.format("s")}) > 20),
    ranked AS (SELECT doc_id AS key, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS pos, chunk FROM kept)
"""
_TOKENS = r"[t FOR t IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF length(t) > 0]"


# Paragraphs, and windows of the texts that have none.
_EVERYTHING = _PARTS + f""",
      cut AS (SELECT doc_id, i, substring(text, (i * 350 + 1)::INTEGER, 350) AS chunk
              FROM documents d, LATERAL (SELECT unnest(range((length(text) + 349) // 350)) AS i)
              WHERE d.doc_id NOT IN (SELECT key FROM ranked)),
      wins AS (SELECT doc_id AS key, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, chunk
               FROM cut WHERE length({_TRIM.format("chunk")}) > 15),
      everything AS (SELECT key, pos, 'paragraph' AS kind, chunk FROM ranked UNION ALL SELECT key, pos, 'window', chunk FROM wins)
"""


def _hits(words) -> str:
    inside = ", ".join(f"'{w}'" for w in words)
    return f"len([t FOR t IN w IF t IN ({inside})])"


_C = LEXICON.categories
_TOPIC = r"""
    WITH words AS (SELECT {k}, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS w FROM {t}),
    n AS (SELECT {k}, w, count(*) AS n FROM words WHERE length(w) >= 3 AND w NOT IN ({stop}) GROUP BY ALL),
    best AS (SELECT {k}, w FROM n QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY n DESC, w) = 1)
    SELECT {k}, w AS main_topic FROM {t} LEFT JOIN best USING ({k})
"""
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)

ORACLES = {
    "chunks_paragraph": _PARTS + "SELECT * FROM ranked",
    "chunks_window": f"""
      WITH docs AS (SELECT doc_id, replace(text, ' ', repeat(chr(10), 2)) AS text FROM documents),
      parts AS (SELECT doc_id, unnest(string_split(text, repeat(chr(10), 2))) AS s FROM docs),
      short AS (SELECT doc_id FROM parts GROUP BY 1 HAVING max(length({_TRIM.format("s")})) <= 20),
      cut AS (SELECT doc_id, i, substring(text, (i * 350 + 1)::INTEGER, 350) AS chunk
              FROM docs JOIN short USING (doc_id), LATERAL (SELECT unnest(range((length(text) + 349) // 350)) AS i))
      SELECT doc_id AS key, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS pos, chunk
      FROM cut WHERE length({_TRIM.format("chunk")}) > 15""",
    "chunks_capped": _EVERYTHING + """
      SELECT key, kind, count(*) AS n, sum(length(chunk))::BIGINT AS chars FROM everything WHERE pos < 30 GROUP BY 1, 2""",
    "batch_records": f"""
      SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 0 AND length({_TRIM.format("text")}) > 0""",
    "extract_records": f"""
      WITH w AS (SELECT conv_id, turn, {_TOKENS} AS w FROM conversations),
      h AS (SELECT conv_id, turn, {_hits(_C["english"])} AS e, {_hits(_C["german"])} AS g, {_hits(_C["french"])} AS f,
                   {_hits(LEXICON.positive)} AS p, {_hits(LEXICON.negative)} AS m, {_hits(LEXICON.urgent)} AS u,
                   {_hits(LEXICON.action)} AS a FROM w)
      SELECT conv_id, turn,
             CASE WHEN greatest(e, g, f) = 0 THEN 'General' WHEN e >= g AND e >= f THEN 'english' WHEN g >= f THEN 'german'
                  ELSE 'french' END AS category,
             CASE WHEN p + m = 0 THEN 0.0::DOUBLE
                  ELSE floor((p - m)::DOUBLE / (p + m)::DOUBLE * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE END AS sentiment_score,
             least(5, u + 1)::INTEGER AS urgency, (a > 0)::INTEGER AS action_required FROM h""",
    "text_table": _EVERYTHING + f""",
      w AS (SELECT key, pos, {_TOKENS.replace("lower(text)", "lower(chunk)")} AS w FROM everything),
      words AS (SELECT key, pos, unnest(w) AS t FROM w),
      counted AS (SELECT key, pos, t, count(*) AS n FROM words WHERE length(t) >= 3 AND t NOT IN ({_STOP}) GROUP BY ALL),
      best AS (SELECT key, pos, t FROM counted QUALIFY row_number() OVER (PARTITION BY key, pos ORDER BY n DESC, t) = 1),
      h AS (SELECT key, pos, {_hits(_C["english"])} AS e, {_hits(_C["german"])} AS g, {_hits(_C["french"])} AS f,
                   {_hits(LEXICON.positive)} AS p, {_hits(LEXICON.negative)} AS m, {_hits(LEXICON.urgent)} AS u,
                   {_hits(LEXICON.action)} AS a FROM w)
      SELECT key, pos::INTEGER AS pos,
             CASE WHEN greatest(e, g, f) = 0 THEN 'General' WHEN e >= g AND e >= f THEN 'english' WHEN g >= f THEN 'german'
                  ELSE 'french' END AS category,
             CASE WHEN p + m = 0 THEN 0.0::DOUBLE
                  ELSE floor((p - m)::DOUBLE / (p + m)::DOUBLE * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE END AS sentiment_score,
             least(5, u + 1)::INTEGER AS urgency, (a > 0)::INTEGER AS action_required, t AS main_topic
      FROM h LEFT JOIN best USING (key, pos)""",
    "extract_topic": _TOPIC.format(k="conv_id, turn", t="conversations", stop=_STOP),
    "extract_topic_documents": _TOPIC.format(k="doc_id", t="documents", stop=_STOP),
    "extract_directive": r"""
      SELECT doc_id, nullif(regexp_extract(text, '\b(th[a-z]+)', 1), '') AS words_with_th,
             TRY_CAST(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS BIGINT) AS first_number,
             TRY_CAST(nullif(regexp_extract(text, '([A-Z][a-z]+)', 1), '') AS BIGINT) AS not_a_number FROM documents""",
    "extract_rejects": r"""
      WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '  ' ELSE text END AS text FROM conversations)
      SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'blank text' ELSE 'no field found' END AS reason FROM c
      WHERE trim(text) = '' OR NOT (regexp_matches(text, '\bder\b') OR regexp_matches(text, '\bthe\b'))""",
    "union_ragged": """
      SELECT o_orderkey AS id, o_totalprice AS amount, NULL::VARCHAR AS brand FROM orders
      UNION ALL SELECT p_partkey, p_size::DOUBLE, p_brand FROM part""",
}
