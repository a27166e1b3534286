"""Each registered query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from rondel import queries as own

SF = os.environ.get("RONDEL_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return str(x)
    x = float(x)
    return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = own.QUERIES[name](spark, SF)
    want = duck.execute(own.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = rows(got.columns, got.collect()), rows(columns, want.fetchall())
    assert len(a) == len(b)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.SQL)))
def test_query_without_sql_runs(spark, name):
    assert own.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
