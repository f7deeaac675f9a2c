"""Every registered query with SQL gives the rows that DuckDB gives; shared with the corpus queries when they are there."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries over many forms of text, also held against SQL over the larger tables.
AT_LARGE = ["text_forms", "address_forms", "reference_entries", "authoryear_matches"]


@pytest.fixture(scope="session")
def duck():
    return connected(SF)


def connected(folder):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, float):
        return f"{v:.7g}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    check(spark, duck, name, SF)


@pytest.mark.parametrize("name", AT_LARGE)
def test_query_matches_sql_at_large(spark, name):
    check(spark, connected("/root/testdata/sf0.01"), name, "/root/testdata/sf0.01")


def check(spark, duck, name, folder):
    got = entry.queries()[name](spark, folder)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    left = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    right = sorted(tuple(plain(dict(zip(want.columns, r, strict=True))[c]) for c in order) for r in want.fetchall())
    assert left == right


def test_entry(spark):
    assert entry.entry(spark).count() > 0
