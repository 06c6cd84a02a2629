"""Queries beside their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from cistron import catalog
from jobs import queries as jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, SQL = catalog.queries() | jobs.queries(), catalog.oracle_sql() | jobs.oracle_sql()
CHECKED = sorted(SQL)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or (isinstance(x, float) and y == pytest.approx(x, abs=2e-5)) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
