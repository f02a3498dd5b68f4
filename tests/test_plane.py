from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ann, density, plane, vectors
from sparkloom.plans import mechanism_queries, registry  # noqa: F401


def edges(df):
    return sorted((r.u, r.v, r.distance) for r in df.select("u", "v", "distance").collect())


@pytest.mark.parametrize("tile", [2048, 40])
def test_neighbours_in_the_plane_are_those_of_all_pairs(spark, monkeypatch, tile):
    """One tile and many; clusters, a lattice full of ties, a crowd at one place, outliers, and rows without a place."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (200, 2)), rng.normal(8, 0.01, (150, 2)), np.stack(np.indices((9, 9)), axis=-1).reshape(-1, 2) - 20.0, np.full((60, 2), 3.5), [[1e6, -1e6], [-1e5, 7.0], [0.0, 1e4]], np.stack([np.arange(30) * 0.1, np.zeros(30)], axis=1)])
    ids = rng.permutation(len(x))
    data = [(int(i), v.tolist()) for i, v in zip(ids, x)] + [(9000, None), (9001, [float("nan"), 1.0]), (9002, [1.0]), (9003, [float("inf"), 0.0])]
    rows = spark.createDataFrame(data, "vec_id long, reduced array<double>").repartition(4)
    monkeypatch.setattr(plane, "TILE", tile)
    monkeypatch.setattr(plane, "SAMPLE", 8)
    for k in (1, 15):
        want = density.neighbours(rows.where("vec_id < 9000"), k, None, "vec_id", "reduced")
        assert edges(plane.neighbours(rows, k)) == edges(want)


def test_few_places(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 3.0]), (3, [4.0, 0.0])], "vec_id long, reduced array<double>")
    assert edges(plane.neighbours(rows, 15)) == [(1, 2, 3.0), (1, 3, 4.0), (2, 1, 3.0), (2, 3, 5.0), (3, 1, 4.0), (3, 2, 5.0)]
    assert plane.neighbours(rows.where("vec_id = 1"), 15).count() == 0
    assert plane.neighbours(rows.limit(0), 15).count() == 0


def test_a_place_asks_few_tiles():
    """Each circle meets the tiles that it touches; the work grows with the rows, not with their square."""
    rng = np.random.default_rng(1)
    x, tiles = rng.random((20_000, 2)), []
    tree = plane._cut(x, 200, tiles)
    held = [len(rows) for rows, _ in plane._touched(tree, x, np.zeros(len(x)))]
    assert sum(held) == len(x) and max(held) <= 200 and len(held) == len(tiles)
    assert sum(len(rows) for rows, _ in plane._touched(tree, x, np.full(len(x), 0.02))) < 3 * len(x)


def test_kept_neighbours_form_all_pairs_once(spark, sf, monkeypatch):
    """The layout's own search tells the nearest vectors as well; places in the plane need none (before: four searches)."""
    met, whole = [], ann.all_pairs
    monkeypatch.setattr(ann, "all_pairs", lambda *a, **k: met.append(1) or whole(*a, **k))
    rows = {r.method: r.kept for r in registry.QUERIES["vec_layout_kept_neighbours"](spark, sf).collect()}
    assert len(met) == 1 and rows["layout"] > rows["components"] > 0


def test_a_length_is_formed_once_a_vector(spark):
    """Not once more for each of its components."""
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id int, v array<double>").select("id", vectors.l2_normalize(F.col("v")).alias("v"))
    assert rows._jdf.queryExecution().analyzed().toString().count("zip_with") == 1
    assert {r.id: r.v for r in rows.collect()} == {1: [0.6, 0.8], 2: None, 3: None}


def test_single_precision_loses_no_neighbour():
    """Distances that single precision cannot tell apart, and ties of equal vectors."""
    rng = np.random.default_rng(2)
    x = np.array([1.0] + [0.0] * 15) + 1e-4 * rng.normal(size=(700, 16))
    x[300:340] = x[4]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = pa.array(rng.permutation(len(x)))
    for with_self in (True, False):
        one, two = (f(ids, x, ids, x, 9, with_self) for f in (vectors.block_best, vectors.cell_best))
        assert len(two[0]) == 9 * len(x)
        gaps = lambda a: sorted(zip(a[0].to_pylist(), np.round(a[2].to_numpy(), 11)))
        assert np.allclose(gaps(one), gaps(two), atol=2e-11, rtol=0)
