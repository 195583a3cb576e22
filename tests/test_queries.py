"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, kind

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


def test_every_sql_has_its_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(kind(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    want = con.execute(SQL[name])
    heads = [d[0] for d in want.description]
    assert sorted(heads) == columns
    at = [heads.index(c) for c in columns]
    assert got == sorted((tuple(kind(r[i]) for i in at) for r in want.fetchall()), key=repr)
