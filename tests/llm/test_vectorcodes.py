from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import vectorcodes as V


def nearest(x, entries):
    """Index and squared distance by trying all entries, in Python's integers."""
    return min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(entries))[::-1]


def brute(rows, parts=16, entries=64, rounds=2):
    """vec_id, code, error, label_error and the codebooks' digest of rows (vec_id, vector, label), one width."""
    ok = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v and not any(x is None or not math.isfinite(x) for x in v)]
    if not ok:
        return []
    size = len(ok[0][1]) // parts
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(parts)]
    first = sorted(ok, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for _, v, _ in ok:
                mine[nearest(cut(v)[p], books[p])[0]].append(cut(v)[p])
            for k, xs in mine.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    name = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by = [], defaultdict(int)
    for i, v, lab in ok:
        found = [nearest(x, b) for x, b in zip(cut(v), books)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found), lab))
        by[lab] += out[-1][2]
    return sorted((str(i), c, e, by[lab], name) for i, c, e, lab in out)


def shown(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 70), st.integers(1, 6), st.sampled_from([2, 60, 10**6, 1 << 40]))
def test_annuli_find_the_nearest_entry(seed, count, width, size):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-size, size + 1, (count, width))
    x = np.r_[rng.integers(-size, size + 1, (30, width)), entries[: min(count, 5)], np.zeros((1, width), np.int64)]
    index, gap = V.Annuli(entries).nearest(x)
    assert [(int(i), int(d)) for i, d in zip(index, gap)] == [nearest(row, entries) for row in x]


def test_entries_outside_the_annulus_are_not_compared():
    rng = np.random.default_rng(3)
    entries = rng.integers(-5, 6, (64, 4)) + 1000 * np.arange(64)[:, None]
    x = entries[rng.integers(0, 64, 5000)] + rng.integers(-3, 4, (5000, 4))
    annuli = V.Annuli(entries)
    index, gap = annuli.nearest(x)
    assert annuli.compared <= 2 * len(x)
    assert all((int(i), int(d)) == nearest(row, entries) for i, d, row in zip(index[:50], gap, x))


def test_entries_on_the_circle_are_compared():
    """Entries exactly at the annulus' edge tie with the best and win by their index."""
    entries = np.array([[10, 0], [2, 0], [6, 0]])
    index, gap = V.Annuli(entries).nearest(np.array([[6, 0], [4, 0], [8, 0]]))
    assert index.tolist() == [2, 1, 0] and gap.tolist() == [0, 4, 4]


def test_query_equals_brute_force(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    assert shown(V.compressed(frame)) == brute(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    vec = lambda: [float(x) for x in rng.normal(0, 1, 32).round(2)]
    same = vec()
    rows = [(1, same, 0), (1, same, 0), (None, vec(), 1), (2, None, 1), (3, [None] + vec()[1:], 1), (4, [float("nan")] + vec()[1:], 2), (5, [float("inf")] + vec()[1:], 2), (6, [], 0), (7, vec(), None), (8, vec(), None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS code", "'x' AS v", "map('a', 1) AS error", "2 AS salt", "3 AS of")
    assert shown(V.compressed(frame)) == brute(rows)
    other = spark.createDataFrame([(9, [1.0] * 17, 0), (10, [0.5] * 16, 0)], "vec_id long, embedding array<double>, label int")
    got = V.compressed(frame.select("vec_id", "embedding", "label").unionByName(other)).where("vec_id >= 9").collect()
    assert [(r.vec_id, r.code, r.error) for r in got] == [(10, "00" * 16, 0)]  # a width of its own; 17 can't be cut
    assert V.compressed(frame.limit(0)).count() == 0


def test_labels_that_are_joined_by_a_shuffle(spark, sf, monkeypatch):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("label", F.when(F.col("label") > 2, F.col("label")))
    whole = shown(V.compressed(frame))
    monkeypatch.setattr(V, "BROADCAST_LABELS", 1)
    assert shown(V.compressed(frame)) == whole == brute([(r.vec_id, r.embedding, r.label) for r in frame.collect()])


def test_codes_decode_to_their_entries(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").limit(90)
    books = V.fit(frame)
    codes = V.encode(frame, books)
    back = {r.vec_id: (np.array(r.vector) * 256, r.error) for r in V.decode(codes, books[64]).collect()}
    for r in frame.collect():
        vector, error = back[r.vec_id]
        assert int(((np.floor(np.array(r.embedding, float) * 256) - vector) ** 2).sum()) == error


def test_huge_components_are_held(spark):
    rows = [(i, [3e38 * (-1) ** i] * 16, 0) for i in range(3)]
    got = V.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 3 and all(r.error >= 0 for r in got)


@pytest.mark.parametrize("parts", [1, 4])
def test_other_numbers_of_parts(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)], 0) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    books = V.fit(frame, parts=parts, entries=7, rounds=3)
    got = sorted((str(r.vec_id), r.code, r.error) for r in V.encode(frame, books, parts=parts).collect())
    assert got == [x[:3] for x in brute(rows, parts, 7, 3)]
