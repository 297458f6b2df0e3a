from __future__ import annotations

import duckdb
import pytest

from vigil.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.sql(oracle_sql()[name])
    got = queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = [tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()]
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == sorted(rows, key=repr)
