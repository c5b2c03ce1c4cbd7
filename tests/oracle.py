"""Runs a registered query and its SQL on DuckDB and compares columns, types and every value."""

import datetime
import decimal
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, int):
        return ("num", float(v))
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else ("num", v + 0.0)
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return _plain(v.asDict())
    return str(v)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, query, sql):
    """Returns (message or None, rows, spark seconds, duckdb seconds)."""
    t0 = time.time()
    df = query(spark, sf_dir)
    got_cols, got = _table(df.columns, df.collect())
    t1 = time.time()
    if sql is None:
        return None, len(got), t1 - t0, 0.0
    rel = con.execute(sql)
    want_cols, want = _table([c[0] for c in rel.description], rel.fetchall())
    t2 = time.time()
    msg = None
    if got_cols != want_cols:
        msg = f"columns {got_cols} != {want_cols}"
    elif got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
        msg = f"{len(got)} rows against {len(want)}; first differences {diff}"
    return msg, len(got), t1 - t0, t2 - t1
