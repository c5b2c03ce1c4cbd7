"""Shared-folder handling. The library never changes session settings that exist."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPREAD_ROWS = (10_000, 5_000_000)
ROWS_PER_TASK = 250_000
LOCAL_ROWS = 100_000


_OWN_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. A local session without one gets a folder of its own, which goes
    when the process ends; the session's settings stay as they are."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir"
    )
    if current:
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN_FOLDERS:
        _OWN_FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="tablewright-")
        atexit.register(shutil.rmtree, _OWN_FOLDERS[sc.applicationId], ignore_errors=True)
    return _OWN_FOLDERS[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table this job writes."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def spread(df: DataFrame) -> DataFrame:
    """A table of moderate size over all cores, a large one over so many partitions that none holds many rows.

    Small files often arrive as one partition, which would keep every later step on one core; well compressed ones as a
    few, and what a task reads of them later, with vectors or kernel features, would grow with the table.
    """
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    if n < SPREAD_ROWS[0]:
        return df
    return df.repartition(cores if n <= SPREAD_ROWS[1] else max(cores, -(-n // ROWS_PER_TASK)))


def persisted(df: DataFrame) -> DataFrame:
    """The table in memory and on disk, filled, for steps that read it many times."""
    df = spread(df).persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df


def materialised(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read back.

    Cuts the lineage, survives lost executors and gives later scans column pruning and known sizes.
    """
    path = scratch_path(df.sparkSession, "table")
    names = df.columns
    df.toDF(*[f"c{i}" for i in range(len(names))]).write.parquet(path)
    return df.sparkSession.read.parquet(path).toDF(*names)


def local_table(spark: SparkSession, rows: Sequence, schema: str | T.StructType) -> DataFrame:
    """Rows the driver already holds, as a table. Their number is checked: up to LOCAL_ROWS are broadcast,
    so that the large side of a join is not shuffled; more are joined as Spark sees fit."""
    table = spark.createDataFrame(list(rows), schema)
    return F.broadcast(table) if len(rows) <= LOCAL_ROWS else table


def local_or_written(df: DataFrame, limit: int) -> DataFrame:
    """A result of at most ``limit`` rows as a local table, a larger one as a written table."""
    rows = df.limit(limit + 1).collect()
    return materialised(df) if len(rows) > limit else local_table(df.sparkSession, rows, df.schema)


def numbered(df: DataFrame, name: str = "__id") -> DataFrame:
    """A materialised copy with a unique row number: partition number times 2^33 plus place in it.

    The numbers are stored with the rows, so every later read sees the same ones.
    """
    return materialised(spread(df).withColumn(name, F.monotonically_increasing_id()))
