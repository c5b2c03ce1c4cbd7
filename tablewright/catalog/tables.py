"""Reading the given tables and deriving the fixtures with injected nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        "c_name",
        "c_nationkey",
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
    )


CUSTOMER_WITH_NULLS = """
    SELECT c_custkey, c_name, c_nationkey,
           CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal,
           CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS c_mktsegment
    FROM customer
"""


def rounded(expr: str, places: int) -> str:
    k = f"1e{places}"
    return f"(floor(({expr})::DOUBLE * {k}::DOUBLE + 0.5::DOUBLE) / {k}::DOUBLE)"
