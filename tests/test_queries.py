"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from litlake.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def value(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.astimezone(datetime.UTC).replace(tzinfo=None).isoformat() if v.tzinfo else v.isoformat()
    return tuple(map(value, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted((repr(tuple(map(value, r))) for r in df.select(*columns).collect()))
    if name not in catalogue.ORACLES:
        assert rows
        return
    result = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(value(r[p]) for p in places)) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
