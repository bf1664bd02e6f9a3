"""Every page query against its SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from pagewright.plans import image_queries as queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_rows_equal_those_of_the_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    want = duck.sql(queries.ORACLE[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    assert got == Counter(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["page_id", "y", "x", "b", "g", "r"] and df.count() > 0


def test_every_query_is_registered():
    found = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)
