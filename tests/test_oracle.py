"""Every registered query with an SQL oracle agrees with DuckDB on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"
ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF)


def test_every_query_has_a_builder():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "url_length" in df.columns
