"""Every query with SQL gives the rows that the SQL gives on the same tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from groundwork import registry
from tests.conftest import DATA


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sample_is_stable_and_whole(spark, data):
    a = {tuple(r) for r in registry.QUERIES["sample_per_county"](spark, data).collect()}
    b = {tuple(r) for r in registry.QUERIES["sample_per_county"](spark, data).collect()}
    assert a == b
    sizes = dict(spark.read.parquet(f"{data}/customer.parquet").groupBy("c_nationkey").count().collect())
    got = {}
    for nation, _ in a:
        got[nation] = got.get(nation, 0) + 1
    assert got == {k: min(5, n) for k, n in sizes.items()}
