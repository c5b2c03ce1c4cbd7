"""Tables that one run writes to the shared folder and drops when nothing reads them any more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.session import scratch_path

BROADCAST_ROWS = 100_000


class Scratch:
    """Intermediate tables of one run.

    A written table cuts the lineage: a lost executor repeats the tasks of the step at hand only. ``drop`` removes a
    table that no later step reads; what the returned DataFrame reads stays in the folder of ``spark.checkpoint.dir``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
