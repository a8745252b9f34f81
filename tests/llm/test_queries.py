"""The registered queries of the package over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from keyfold.llm import queries

ORACLES = queries.oracle_sql()


def test_names():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, data, name):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{data}/{file}'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    df = queries.queries()[name](spark, data)
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, df.select(*columns).collect())) == sorted(map(key, want.fetchall()))
