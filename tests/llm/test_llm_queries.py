from __future__ import annotations

import duckdb
import pytest

from sparkloom.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries()[name](spark, sf)
    cur = con.execute(oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, cur.fetchall()))
