"""Every query with SQL against DuckDB over the same files, and every other one for rows that do not change from run to run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from leafmill.catalog import ORACLES, QUERIES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, db, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = db.execute(ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    first, again = (sorted(map(repr, QUERIES[name](spark, data).collect())) for _ in range(2))
    assert first and first == again


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_catalogues_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
