"""python tests/run_oracle.py [sf] [name ...]: compares the registered queries with DuckDB."""

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import oracle  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    d = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(d)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not sys.argv[2:] or any(a in n for a in sys.argv[2:])]
    bad = 0
    for n in names:
        try:
            msg, rows, s, o = oracle.compare(spark, con, d, qs[n], sqls.get(n))
        except Exception as e:  # report and go on with the next query
            msg, rows, s, o = f"{type(e).__name__}: {str(e)[:1500]}", -1, 0, 0
        bad += msg is not None
        tag = "FAIL" if msg else ("ok" if n in sqls else "rows")
        print(f"{tag:5} {n:32} rows={rows:7} spark={s:6.2f}s duckdb={o:6.2f}s {msg or ''}", flush=True)
    print("failed:", bad, "of", len(names))


if __name__ == "__main__":
    main()
