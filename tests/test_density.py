from __future__ import annotations

import math

import numpy as np
import pytest

from sparkloom.operators import density, vectors


def brute(points, min_cluster_size, min_samples):
    """Labels and probabilities by splitting the whole tree from its heaviest edge down."""
    ids = sorted(points)
    dist = {a: {b: round(math.dist(points[a], points[b]), 12) for b in ids if b != a} for a in ids}
    core = {a: sorted(dist[a].values())[min_samples - 1] for a in ids}
    every = sorted((max(dist[a][b], core[a], core[b]), a, b) for a in ids for b in ids if a < b)
    up = {a: a for a in ids}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    tree = []
    for w, a, b in every:
        if root(a) != root(b):
            up[root(a)] = root(b)
            tree.append((w, a, b))

    def part(start, edges):
        near = {}
        for _, a, b in edges:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        seen, todo = {start}, [start]
        while todo:
            for x in near.get(todo.pop(), []):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    nodes = []  # dicts: birth, falls {point: density}, kids

    def grow(members, edges, birth):
        node = {"birth": birth, "falls": {}, "kids": [], "sizes": [], "top": 0.0}
        nodes.append(node)
        edges = sorted(edges)
        while members:
            w, a, b = edges.pop()
            d = 1 / max(w, 1e-12)
            node["top"] = max(node["top"], d)
            left, right = part(a, edges), part(b, edges)
            mine = lambda s: [e for e in edges if e[1] in s]
            if len(left) >= min_cluster_size and len(right) >= min_cluster_size:
                node["kids"] = [grow(s, mine(s), d) for s in (left, right)]
                node["sizes"] = [(len(left), d), (len(right), d)]
                return node
            stay = None
            for s in (left, right):
                if len(s) >= min_cluster_size:
                    stay = s
                else:
                    node["falls"] |= {p: d for p in s}
            if stay is None:
                return node
            members, edges = stay, mine(stay)
        return node

    if len(ids) < max(2, min_cluster_size):
        return {a: (-1, 0.0) for a in ids}
    top = grow(set(ids), tree, 0.0)

    def worth(node):
        own = sum(d - node["birth"] for d in node["falls"].values()) + sum(n * (d - node["birth"]) for n, d in node["sizes"])
        kids = sum(worth(k) for k in node["kids"])
        node["own"] = own >= kids - 1e-9 * abs(kids)
        return max(own, kids)

    worth(top)
    out = {a: (-1, 0.0) for a in ids}

    def members(node):
        got = dict(node["falls"])
        for k in node["kids"]:
            got |= members(k)
        return got

    def walk(node, root=False):
        if node["own"] and not root:
            got = members(node)
            for p, d in got.items():
                out[p] = (min(got), min(1.0, d / node["top"]))
        else:
            for k in node["kids"]:
                walk(k)

    walk(top, True)
    order = {f: i for i, f in enumerate(sorted({a for a, _ in out.values() if a != -1}))}
    return {p: (order.get(a, -1), pr) for p, (a, pr) in out.items()}


def blobs(seed, n=90, width=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 4, (4, width))
    x = np.r_[centre[rng.integers(0, 4, n)] + rng.normal(0, 0.4, (n, width)) * rng.uniform(0.3, 2, (n, 1)), rng.uniform(-8, 8, (15, width))]
    return {i: v.round(6).tolist() for i, v in enumerate(x)}


def table(spark, points):
    return spark.createDataFrame(list(points.items()), "vec_id long, embedding array<double>")


def same(got, want):
    assert {p: a for p, (a, _) in got.items()} == {p: a for p, (a, _) in want.items()}
    assert all(abs(got[p][1] - want[p][1]) < 1e-6 for p in want)


def labelled(df):
    return {r.vec_id: (r.label, r.probability) for r in df.collect()}


@pytest.mark.parametrize(("seed", "size", "samples"), [(0, 5, 1), (1, 4, 3), (2, 8, 1)])
def test_equal_to_the_tree_of_all_pairs(spark, seed, size, samples):
    points = blobs(seed)
    want = brute(points, size, samples)
    assert len({a for a, _ in want.values()}) > 2
    same(labelled(density.density_clusters(table(spark, points), size, samples, k=len(points) - 1)), want)


def test_rounds_and_chunks_give_the_same(spark, monkeypatch):
    """Borůvka rounds to the end and a tree in many chunks."""
    points = blobs(3)
    monkeypatch.setattr(density, "TAIL", 0)
    monkeypatch.setattr(density, "CHUNK", 30)
    same(labelled(density.density_clusters(table(spark, points), 5, 1, k=len(points) - 1)), brute(points, 5, 1))


def test_the_forest_is_minimal(spark, monkeypatch):
    rng = np.random.default_rng(8)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (150, 2)) if a < b})
    rows = [(a, b, float(rng.integers(1, 9))) for a, b in edges]
    up = {i: i for i in range(60)}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    want = set()
    for w, a, b in sorted((w, a, b) for a, b, w in rows):
        if root(a) != root(b):
            up[root(a)] = root(b)
            want.add((a, b, w))
    frame = spark.createDataFrame(rows, "u long, v long, w double")
    for tail in (0, 10**6):
        monkeypatch.setattr(density, "TAIL", tail)
        assert {tuple(r) for r in density.spanning_forest(frame).collect()} == want


def test_repeats_odd_rows_and_small_tables(spark):
    rows = [(i, [0.0, 0.0]) for i in range(6)] + [(10 + i, [5.0, 5.0 + 0.1 * i]) for i in range(6)] + [(30, [100.0, 0.0]), (31, None), (32, [1.0, None]), (33, [float("nan"), 1.0]), (34, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS label", "1 AS c", "2 AS cluster", "map(1, 2) AS w")
    got = labelled(density.density_clusters(frame, 5))
    assert {p: a for p, (a, _) in got.items()} == {**{i: 0 for i in range(6)}, **{10 + i: 1 for i in range(6)}, 30: -1}
    assert labelled(density.density_clusters(frame.where("vec_id < 3"), 5)) == {0: (-1, 0.0), 1: (-1, 0.0), 2: (-1, 0.0)}
    assert labelled(density.density_clusters(frame.limit(0), 5)) == {}


def test_parts_that_the_graph_does_not_connect(spark):
    """Two far groups, each with its own neighbours only: both are clusters."""
    rng = np.random.default_rng(5)
    points = {i: (rng.normal(0, 1, 2) + (0 if i < 20 else 1000)).tolist() for i in range(40)}
    got = labelled(density.density_clusters(table(spark, points), 5, k=4))
    assert len({got[i][0] for i in range(20)} & {got[i][0] for i in range(20, 40)} - {-1}) == 0
    assert {a for a, _ in got.values()} - {-1}


def test_noise_joins_the_nearest_cluster(spark):
    points = blobs(0)
    frame = table(spark, points)
    labels = density.density_clusters(frame, 5)
    full = vectors.assign_noise(frame.join(labels, "vec_id"), "label", -1, "vec_id", "embedding")
    assert full.where("label = -1").count() == 0 and full.count() == len(points)
