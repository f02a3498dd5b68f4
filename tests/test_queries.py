"""Every query of the core package equals its SQL on the smallest tables; those without SQL run and give rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from sparkloom.plans import data_queries, extra_queries, measure_queries, mechanism_queries, more_queries, registry, stream_queries, text_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf, duck, name):
    frame = registry.QUERIES[name](spark, sf)
    got = frame.collect()
    if name not in registry.ORACLE:
        assert frame.columns
        return
    cur = duck.execute(registry.ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(frame.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got)
    assert mine == sorted(repr(tuple(map(plain, r))) for r in cur.fetchall())


def test_every_benchmark_item_is_asked(spark, sf):
    asked = {r.item_id for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert {r.query_id for r in registry.QUERIES["engine_answers"](spark, sf).select("query_id").collect()} == asked


def same_as_sql(spark, tmp_path, name, table, rows, schema):
    """The query and its SQL agree on a table of these rows, signs of zeros included; the rows are returned."""
    path = str(tmp_path / f"{table}.parquet")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    cur = con.execute(registry.ORACLE[name])
    columns = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    got = registry.QUERIES[name](spark, str(tmp_path)).select(columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    return got


def test_words_of_answers_keep_their_letters(spark, tmp_path):
    """The SQL's tokens are lower-case words, not folded ones: "ß" is no "ss"."""
    rows = [(1, 0, "user", "Straße ok"), (1, 1, "assistant", "strasse OK")]
    got = same_as_sql(spark, tmp_path, "evl_token_f1", "conversations", rows, "conv_id long, turn int, role string, text string")
    assert [r.token_f1 for r in got] == [0.5]


def test_centroids_that_are_as_near_to_six_digits(spark, tmp_path):
    """The SQL rounds squared distances to six digits; then the smaller label is taken, if it is the farther one as well."""
    rows = [(1, [1.0, 0.0], 1), (2, [0.0, 0.9999999], 2), (3, [0.0, 0.0], 0)]
    got = same_as_sql(spark, tmp_path, "vec_assign_nearest_centroid", "embeddings", rows, "vec_id long, embedding array<float>, label int")
    assert {r.vec_id: r.label for r in got}[3] == 1


def test_means_just_below_zero(spark, tmp_path):
    """Rounded, they are -0.0 in SQL."""
    rows = [(1, [-0.00001, 1.0, 0.0], 1), (2, [-0.00002, -1.0, 0.00001], 1)]
    got = same_as_sql(spark, tmp_path, "vec_cluster_centroids", "embeddings", rows, "vec_id long, embedding array<float>, label int")
    assert [math.copysign(1, x) for x in got[0].centroid] == [-1, 1, 1]


#: Distances from row 0 that are equal to six digits, the smaller id being the farther; and some whose scores are decided by the sixth digit, or by how 0.8735 and 0.29995 are rounded.
_AS_NEAR = [1 - (0.51 + i * 1e-8) for i in range(12)]
_BETWEEN = [0.48949975, 0.1265, 0.2515, 0.7000504, 0.70005, 0.3765]


@pytest.mark.parametrize("name", ["vec_overfetch_threshold", "vec_index_all_lists", "vec_topk_batched", "vec_topk_cosine", "vec_category_or_general"])
@pytest.mark.parametrize("gaps", [_AS_NEAR, _BETWEEN], ids=["ties", "scores"])
def test_ranks_and_scores_go_by_six_digits(spark, tmp_path, name, gaps):
    rows = [(0, [1.0, 0.0], 3)] + [(i + 1, [1 - d, math.sqrt(1 - (1 - d) ** 2)], 3) for i, d in enumerate(gaps)]
    got = same_as_sql(spark, tmp_path, name, "embeddings", rows, "vec_id long, embedding array<double>, label int")
    if gaps is _AS_NEAR:
        assert sorted(r.id for r in got) == list(range(len(got))) and len(got) in (5, 10)


def test_a_row_without_a_label_is_no_evidence(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 3), (1, [1.0, 0.1], None), (2, [1.0, 0.2], 9), (3, [1.0, 0.3], 1)]
    got = same_as_sql(spark, tmp_path, "vec_overfetch_threshold", "embeddings", rows, "vec_id long, embedding array<double>, label int")
    assert sorted(r.id for r in got) == [0, 3]
