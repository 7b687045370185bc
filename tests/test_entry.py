"""Every query against its SQL on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SQL = {n: s for n, s in entry.oracle_sql().items() if n in __import__("caskwise.queries", fromlist=["SQL"]).SQL}


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    left = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    right = sorted((tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert left == right


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
