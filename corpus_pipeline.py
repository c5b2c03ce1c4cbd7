"""From documents to token files: five stages, each on all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.catalog.tables import table
from tablewright.llm import decontam, minhash, mixing, quality, queries, tokens
from tablewright.llm.store import Scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words)."""
    return minhash.keep_one(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark passages."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document that is taken twice is two rows."""
    return mixing.Mix(docs).rows_in_order()


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, read back: one row per document of the mix."""
    return tokens.token_table(docs, queries.tokenizer_path())


STAGES = [
    ("quality classifier", good_documents),
    ("near-duplicates", one_of_each),
    ("decontamination", clean_documents),
    ("mixing", mixed_documents),
    ("token files", token_files),
]

ORACLE_SQL = None  # the classifier can't be fitted in SQL; tests/llm checks every stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
