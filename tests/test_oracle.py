"""Every registered query with a DuckDB twin agrees with it (sf0.001)."""

import pytest

import __spark_entry__ as E
from conftest import SMALL
from oracle_compare import compare, duck_con

QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_con(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = con.execute(SQL[name]).fetchdf()
    compare(got, want)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 0
    assert df.columns == ["dow", "sales", "customers", "avg_spend", "rank"]
