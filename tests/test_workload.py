"""Every registered query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from keyfold import workload

QUERIES, ORACLES = workload.queries(), workload.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        table = name.removesuffix(".parquet")
        con.execute(f"create view {table} as select * from '{data}/{name}'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def cell(value):
    return repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    want = duck.sql(ORACLES[name])
    types = dict(zip(want.columns, map(str, want.types)))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    expected = sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == expected
