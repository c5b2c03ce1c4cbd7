"""Every registered query with SQL gives DuckDB's values; the others run and keep a stable schema."""

import os

import pytest

import __spark_entry__ as entry
import oracle

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SLOW = {n for n in QUERIES if n.startswith(("leaderboard_", "advisory_", "importances_forest"))} - set(ORACLES)


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, duck, name):
    message, _, _, _ = oracle.compare(spark, duck, SF_DIR, QUERIES[name], ORACLES[name])
    assert message is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["cohort", "n", "rate", "ratio", "floor", "violation"]
    assert df.count() > 0
