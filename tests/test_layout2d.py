from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import density, layout2d, vectors


@pytest.fixture(scope="module")
def rows(spark):
    """Twelve groups of directions in sixteen dimensions: two components cannot tell them apart."""
    rng = np.random.default_rng(7)
    centre = rng.normal(0, 1, (12, 16))
    x = centre[np.arange(360) % 12] + 0.25 * rng.normal(0, 1, (360, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_the_curve_has_its_known_parameters():
    a, b = layout2d.curve(0.1)
    assert abs(a - 1.577) < 0.01 and abs(b - 0.895) < 0.01


def test_memberships_sum_to_the_logarithm(spark):
    near = spark.createDataFrame([(1, j, 0.1 + 0.07 * j**1.5) for j in range(16)] + [(2, j, 0.0) for j in range(4)], "u long, v long, distance double")
    got = {r.u: (r.total, r.most) for r in layout2d.fuzzy_sets(near).groupBy("u").agg(F.sum("p").alias("total"), F.max("p").alias("most")).collect()}
    assert abs(got[1][0] - 4) < 1e-4 and got[1][1] == 1.0 and got[2] == (4.0, 1.0)


def test_the_union_of_memberships(spark):
    near = spark.createDataFrame([(1, 2, 0.5), (1, 3, 1.0), (2, 1, 0.5), (2, 3, 0.7), (3, 2, 0.7), (3, 4, 0.9), (4, 3, 0.9), (4, 1, 2.0)], "u long, v long, distance double")
    one = {(r.u, r.v): r.p for r in layout2d.fuzzy_sets(near).collect()}
    want = {(a, b): 1 - (1 - one.get((a, b), 0)) * (1 - one.get((b, a), 0)) for a, b in [*one, *((b, a) for a, b in one)]}
    got = {(r.u, r.v): r.p for r in layout2d.fuzzy_graph(near).collect()}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-11 for e in want)


@pytest.mark.parametrize("shard", [20_000, 60])
def test_the_layout_keeps_more_neighbours_than_components(spark, rows, shard, monkeypatch):
    monkeypatch.setattr(layout2d, "SHARD", shard)
    near = density.neighbours(rows, 15)
    share = lambda placed: layout2d.kept_neighbours(near, placed).first().kept
    out = layout2d.reduce(rows)
    mine, pca = share(out), share(vectors.reduce_dimensions(rows).select("vec_id", "reduced"))
    print(mine, pca)
    assert mine > pca + 0.03
    if shard == 20_000:
        again = layout2d.reduce(rows.repartition(7))
        assert {r.vec_id: tuple(np.round(r.reduced, 6)) for r in out.collect()} == {r.vec_id: tuple(np.round(r.reduced, 6)) for r in again.collect()}


def test_new_rows_get_places_near_their_neighbours(spark, rows):
    held = []
    placed = layout2d.reduce(rows, keep_index=held)
    at = {r.vec_id: np.array(r.reduced) for r in placed.collect()}
    new = rows.where("vec_id < 24").select((F.col("vec_id") + 1000).alias("vec_id"), F.transform("embedding", lambda x: x * 3).alias("embedding"))
    got = {r.vec_id - 1000: np.array(r.reduced) for r in layout2d.transform(held[0], placed, new).collect()}
    assert len(got) == 24 and all(np.allclose(got[i], at[i]) for i in got)  # scaled copies
    mixed = rows.where("vec_id IN (0, 12)").agg(F.lit(5000).cast("long").alias("vec_id"), F.collect_list("embedding").alias("e")).select("vec_id", F.zip_with(F.col("e")[0], F.col("e")[1], lambda a, b: a + b).alias("embedding"))
    place = np.array(layout2d.transform(held[0], placed, mixed).first().reduced)
    own = np.array([at[i] for i in at if i % 12 == 0])
    assert np.linalg.norm(place - own.mean(axis=0)) <= np.linalg.norm(own - own.mean(axis=0), axis=1).max()


def test_odd_rows(spark, rows):
    odd = spark.createDataFrame([(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0])], rows.schema)
    few = rows.where("vec_id < 2")
    assert sorted(r.vec_id for r in layout2d.reduce(few.unionByName(odd)).collect()) == [0, 1]
    assert layout2d.reduce(rows.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0, 0.5]) for i in range(20)], rows.schema)
    assert all(np.isfinite(r.reduced).all() for r in layout2d.reduce(same).collect())
