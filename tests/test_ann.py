from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ann, vectors


@pytest.fixture(scope="module")
def rows(spark):
    """A mixture of directions, with repeats, a zero vector, nulls and another width."""
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 1, (12, 16))
    x = (centre[rng.integers(0, 12, 900)] + 0.3 * rng.normal(0, 1, (900, 16))).round(4)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900 + i, x[0].tolist()) for i in range(40)]
    data += [(950, [0.0] * 16), (951, None), (952, [None] + [1.0] * 15), (953, [1.0] * 8)]
    return spark.createDataFrame(data, "id long, embedding array<double>")


def asked(rows):
    return rows.where("id % 50 = 0 OR id > 945").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))


def shown(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())


def brute(rows, k, with_self=True):
    ok = [(r.id, np.array(r.embedding, float)) for r in rows.collect() if r.embedding and None not in r.embedding and any(r.embedding) and len(r.embedding) == 16]
    out = []
    for i, v in ok:
        if i % 50 and i <= 945:
            continue
        gaps = sorted((round(1 - float(v @ w) / float(np.linalg.norm(v) * np.linalg.norm(w)), 12), j) for j, w in ok if with_self or j != i)
        out += [(i, n + 1, j, round(g, 9)) for n, (g, j) in enumerate(gaps[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return ann.build(rows, f"file://{tmp_path_factory.mktemp('index')}/a", width=16)


def test_exact_search_equals_brute_force(rows):
    assert [x for x in shown(vectors.vector_topk(rows, asked(rows), 7)) if x[0] != 953] == brute(rows, 7)


def test_all_lists_give_the_exact_result(rows, index, monkeypatch):
    assert index.lists > 20 and index.rows(rows.sparkSession).count() == 940
    assert shown(ann.search(index, asked(rows), 7, probes=index.lists)) == brute(rows, 7)
    monkeypatch.setattr(ann, "BLOCK", 16)  # lists and queries in several blocks
    assert shown(ann.search(index, asked(rows), 7, probes=index.lists)) == brute(rows, 7)
    assert shown(ann.search(index, asked(rows), 3, probes=index.lists, with_self=False)) == brute(rows, 3, False)


def test_few_probes_find_most(rows, index):
    found = ann.search(index, asked(rows), 10, probes=8)
    got = ann.recall(found, vectors.vector_topk(rows.where("size(embedding) = 16"), asked(rows), 10)).first()
    assert got.recall >= 0.9 and got.wanted == 10 * got.queries


def test_upserts_move_rows_between_lists(spark, rows, tmp_path):
    index = ann.build(rows, f"file://{tmp_path}/b", width=16)
    moved = rows.where("id < 30").select("id", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(1).alias("seq"))
    older = rows.where("id < 30").select("id", "embedding", F.lit(0).alias("seq"))
    fresh = spark.createDataFrame([(5000, [1.0] * 16, 1)], moved.schema)
    ann.upsert(index, moved.unionByName(older).unionByName(fresh), "seq")
    again = ann.load(spark, index.path)
    now = rows.where("id >= 30").unionByName(moved.drop("seq")).unionByName(fresh.drop("seq"))
    assert again.rows(spark).count() == 941
    assert shown(ann.search(again, asked(now), 7, probes=again.lists)) == brute(now, 7)


def test_a_list_that_loses_all_its_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i < 5 else [0.0, 1.0]) for i in range(10)], "id long, embedding array<double>")
    index = ann.build(rows, f"file://{tmp_path}/c", lists=2)
    ann.upsert(index, rows.where("id < 5").select("id", F.array(F.lit(0.0), F.lit(2.0)).alias("embedding"), F.lit(1).alias("seq")), "seq")
    assert sorted(r.id for r in index.rows(spark).collect()) == list(range(10))
    assert index.rows(spark).select("list").distinct().count() == 1


def test_empty_tables(spark, rows, tmp_path):
    index = ann.build(rows.limit(0), f"file://{tmp_path}/d")
    assert ann.search(index, asked(rows), 5).count() == 0
    assert vectors.vector_topk(rows, asked(rows).limit(0), 5).count() == 0
    assert vectors.vector_topk(rows.limit(0), asked(rows), 5).count() == 0


def test_ids_that_are_strings(rows, tmp_path):
    named = rows.withColumn("id", F.format_string("c%05d", "id"))
    index = ann.build(named, f"file://{tmp_path}/e", width=16)
    got = ann.search(index, asked(rows).withColumn("query_id", F.format_string("c%05d", "query_id")), 7, probes=index.lists)
    assert sorted((int(r.query_id[1:]), r["rank"], int(r.id[1:]), round(r.distance, 9)) for r in got.collect()) == brute(rows, 7)


def test_repeated_vectors_come_in_bounded_batches():
    """A query that probes many lists is repeated for each: a task yields these a part at a time (before: all of a batch's at once, 1.6 GB for 10,000 queries and 320 lists)."""
    import types

    centre, rows = np.eye(64).repeat(10, axis=0), 4000
    batch = pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array(list(np.ones((rows, 64))), pa.list_(pa.float64()))], ["id", "v"])
    sizes = [b.num_rows for b in ann._nearest_lists(types.SimpleNamespace(value=centre), 320, "id")([batch])]
    assert sum(sizes) == rows * 320 and max(sizes) * 64 <= ann.HELD


@pytest.mark.parametrize("euclidean", [False, True])
def test_cells_of_all_pairs_agree_with_one_product(spark, monkeypatch, euclidean):
    """Many cells and blocks, more equal vectors than are wanted, and groups of them that ask."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[50:120] = x[7]
    x[200:230] = x[9]
    x = x if euclidean else x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(300)
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, v array<double>").repartition(5)
    for name, module in (("BLOCK_ROWS", vectors), ("BLOCK_QUERIES", vectors), ("CELL_ROWS", ann)):
        monkeypatch.setattr(module, name, 64)
    qids, found, gap = vectors.block_best(pa.array(ids), x, pa.array(ids), x, 4, False, euclidean)
    want = sorted((a, b, round(c, 9) + 0.0) for a, b, c in zip(qids.to_pylist(), found.to_pylist(), gap.to_pylist()))
    got = ann.all_pairs(table, table.withColumnRenamed("id", "query_id"), 4, False, euclidean).collect()
    assert sorted((r.query_id, r.id, round(r.distance, 9) + 0.0) for r in got) == want and len(want) == 1200
