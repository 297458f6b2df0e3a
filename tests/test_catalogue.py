from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from vigil.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def database(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, sf, database, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        return
    oracle = database.sql(ORACLES[name])
    assert sorted(oracle.columns) == cols
    at = [oracle.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in oracle.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
