from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import topk as K


def brute(qid, q, cid, c, k):
    out = set()
    for i, (a, v) in enumerate(zip(qid, q)):
        scores = [(-int(sum(int(x) * int(y) for x, y in zip(v, w))), int(b)) for b, w in zip(cid, c) if b != a]
        out |= {(i, b, -s) for s, b in sorted(scores)[:k]}
    return out


def found(walks):
    return {(i, int(b), int(s)) for i, w in enumerate(walks) for b, s in zip(w.ids, w.scores)}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 3), st.sampled_from([1, 7, 60, 700]))
def test_block_search_matches_brute_force(seed, width, n):
    rng = np.random.default_rng(seed)
    c = rng.integers(-3, 4, (n, width)).astype(float)
    cid = rng.permutation(n * 2)[:n]
    q = np.r_[rng.integers(-3, 4, (4, width)), np.zeros((1, width))].astype(float)
    qid = np.array([cid[0], 10**6, 10**6 + 1, cid[-1], 10**6 + 2])
    assert found(K.threshold_topk(qid, q, cid, c, 5)) == brute(qid, q, cid, c, 5)


def test_skewed_lists_stop_early_and_stay_exact():
    rng = np.random.default_rng(5)
    c = rng.normal(0, 1, (3000, 4)).round(2) * 10
    c[:20] += 500
    q = np.abs(rng.normal(0, 1, (5, 4))).round(2) * 10
    qid, cid = np.arange(10_000, 10_005), np.arange(3000)
    walks = K.threshold_topk(qid, np.floor(q), cid, np.floor(c), 5)
    assert found(walks) == brute(qid, np.floor(q), cid, np.floor(c), 5)
    assert all(stopped and scored < 300 for w in walks for _, scored, stopped in w.ends)


def test_best_of_one_block_stops_the_next():
    rng = np.random.default_rng(6)
    c, q = rng.integers(0, 50, (4000, 3)).astype(float), np.ones((1, 3))
    c[:10] += 100
    first = K.threshold_topk(np.array([-1]), q, np.arange(2000), c[:2000], 5)
    both = K.threshold_topk(np.array([-1]), q, np.arange(2000, 4000), c[2000:], 5, first)
    assert found(both) == brute([-1], q, np.arange(4000), c, 5)
    assert both[0].ends[1][2] and both[0].ends[1][0] == K.FIRST_DEPTH


def test_every_score_comes_from_the_lists(spark, sf):
    """On the test vectors the threshold never gets below a score: the walks end when the lists have shown every row, none before that by another way."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    c, cid = np.floor(np.array([r.embedding for r in rows], float) * 256), np.array([r.vec_id for r in rows])
    asked = cid % 50 == 0
    walks = K.threshold_topk(cid[asked], c[asked], cid, c, 5)
    assert found(walks) == brute(cid[asked], c[asked], cid, c, 5)
    for w in walks:
        (depth, scored, stopped), = w.ends
        assert stopped or depth == len(c) or scored == len(c) - 1


def test_large_components_stay_exact():
    c = np.array([[2.0**40, 1.0], [2.0**40, 2.0], [-(2.0**40), 3.0]])
    walk, = K.threshold_topk(np.array([9]), np.array([[2.0**30, 1.0]]), np.arange(3), c, 2)
    assert list(walk.ids) == [1, 0] and list(walk.scores) == [2**70 + 2, 2**70 + 1]


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [0.5, None]), (1, [1.0, float("nan")]), (2, None), (None, [1.0, 1.0]), (3, [3.0, 1.0]), (4, [1.0]), (100, [float("inf"), 0.0]), (5, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = K.exact_topk(frame, frame.where("vec_id % 50 = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 3, 768 * 256 + 256 * 512)]
    assert K.exact_topk(frame.limit(0), frame.limit(0)).count() == 0


def test_ties_repeats_and_clashing_names(spark):
    rows = [(0, [1.0]), (0, [2.0]), (7, [1.0]), (7, [1.0]), (3, [1.0]), (9, [0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS score", "'x' AS rank", "vec_id AS query_id")
    got = [(r["rank"], r.vec_id, r.score) for r in K.exact_topk(frame, frame.where("vec_id = 0"), k=4).orderBy("rank").collect()]
    assert got == [(1, 3, 65536), (2, 7, 65536), (3, 7, 65536), (4, 9, 32768)]


def test_query_blocks_agree(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = frame.where("vec_id % 50 = 0")
    one = {tuple(r) for r in K.exact_topk(frame, asked).collect()}
    assert one == {tuple(r) for r in K.exact_topk(frame, asked, query_rows=3).collect()}
