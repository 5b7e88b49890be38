"""Every registered query against its DuckDB oracle on the sf0.001 fixtures."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import rows_of  # noqa: E402
from kiln.sources.tables import ALL_TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ALL_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "distinct_count" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(scols) > 0
        return
    res = duck.sql(sql)
    a, ac = rows_of(scols, srows)
    b, bc = rows_of(res.columns, res.fetchall())
    assert ac == bc
    assert a == b
