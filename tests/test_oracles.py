"""Every registered search against its SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from needlework.plans.queries import QUERIES
from needlework.plans.sql import SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, db, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)
    assert got == want
