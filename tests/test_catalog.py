"""Every registered query gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def _plain(x):
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = tables.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(_plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["page_id", "markdown"]
