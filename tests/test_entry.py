import os

import pytest

import __spark_entry__ as entry
from textsieve.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(map(repr, con.sql(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
