"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest, one row per different text. A batch is reduced to one row per digest
(combined before the shuffle), the digests that the index already holds are taken out by a sort-merge anti-join that
does not shuffle the index, and the rest is appended. Running a batch again appends nothing, so a run that
broke off can simply be repeated.

Defined cases: a null text counts as empty; empty texts equal each other. Rows that repeat a doc_id are separate rows of
their group; if that id stays, all of them are marked kept. A null doc_id stays only in a group without another id,
and is then not marked kept. An empty table adds nothing. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.store import Scratch, shuffle_partitions

WHITE_SPACE = r"[\x20\x09-\x0D]"
SCHEMA = "digest string, keep_id long, n_chars long, group_size long, batch string"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_chars): SHA-256 of the text without white space, code points of the original."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(F.regexp_replace(text, WHITE_SPACE, ""), 256).alias("digest"),
        F.char_length(text).cast("long").alias("n_chars"),
    )


def representatives(rows: DataFrame) -> DataFrame:
    """One row per digest: the most code points, then the smallest id (as the largest complement)."""
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("inverse")))
    return (
        rows.groupBy("digest")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select(
            "digest",
            F.bitwise_not("best.inverse").alias("keep_id"),
            F.col("best.n_chars").alias("n_chars"),
            "group_size",
        )
    )


class DigestIndex:
    """The index at ``path``. ``buckets`` is part of the folder, so an index is opened with the count it was made with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.buckets = spark, buckets
        self.path = f"{path}/buckets_{buckets}"
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def close(self) -> None:
        """Forgets the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def rows(self) -> DataFrame:
        """The index as plain files: a join with it shuffles both sides, so hot digests can be split."""
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def append(self, rows: DataFrame, batch: str) -> None:
        """Adds the digests of ``rows`` that the index lacks."""
        known = self.spark.table(self.table).select("digest").hint("merge")
        new = representatives(rows).join(known, "digest", "left_anti").withColumn("batch", F.lit(batch))
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)


def deduplicate(docs: DataFrame, index: DigestIndex, scratch: Scratch, batch: str, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Adds the batch to the index and returns every row's fate.

    Columns: doc_id, keep_id (the row that stays, maybe of an earlier batch), group_size (rows with this text in the
    batch that brought it), kept, text_sha256. The digests are written once, so texts are read once.
    """
    rows = scratch.write(digests(docs, id_col, text_col), "digests")
    index.append(rows, batch)
    owner = index.rows().select("digest", "keep_id", "group_size", "batch")
    return rows.join(owner.hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce((F.col("doc_id") == F.col("keep_id")) & (F.col("batch") == batch), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicate_new(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``deduplicate`` against a new index in the shared folder."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    index = DigestIndex(spark, scratch.path("index"), shuffle_partitions(spark))
    try:
        return deduplicate(docs, index, scratch, "first", id_col, text_col)
    finally:
        index.close()
