"""Every registered query runs, and those with a SQL twin agree with it."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def shown(row):
    return tuple("null" if x is None else round(x, 5) + 0.0 if isinstance(x, float) and math.isfinite(x) else x for x in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    expected = duck.sql(entry.oracle_sql()[name])
    assert sorted(expected.columns) == cols
    got = sorted((shown(r) for r in df.select(cols).collect()), key=str)
    assert got == sorted((shown(r) for r in expected.select(*cols).fetchall()), key=str)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
