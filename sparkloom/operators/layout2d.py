"""Reduction by a neighbour graph: fuzzy neighbour sets, laid out by stochastic gradient steps with negative samples.

Vectors are dealt over shards of bounded size, near ones together (by the lists
of the index; larger lists in parts).  In each round a shard gets its own
vectors' places, its edges with the present places of their other ends, and a
bounded sample of all places for negative samples, and runs some epochs; then
the places are written and the next round begins.  Rows in one shard move
against each other step by step, others against where they were.  With one
shard this is the plain algorithm.  Draws come from a seed, shard and round,
and rows from sorted tables: reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators import ann, plane, vectors
from sparkloom.sources import workspace
from sparkloom.sources.workspace import written

#: Vectors of a shard, and places in the sample that all shards get.
SHARD, POOL = 20_000, 2_000
NEGATIVE = 5


def curve(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a x^2b) nearest to a curve that is 1 up to min_dist and falls off exponentially beyond."""
    x = np.linspace(0, 3 * spread, 300)
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b, step = 1.0, 1.0, 0.5
    loss = lambda a, b: ((1 / (1 + a * x ** (2 * b)) - y) ** 2).sum()
    while step > 1e-6:
        best = min(((loss(p, q), p, q) for p in (a - step, a, a + step) for q in (b - step, b, b + step) if p > 0 and q > 0))
        if best[1:] == (a, b):
            step /= 2
        a, b = best[1:]
    return a, b


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _strengths(gaps: pd.Series) -> pd.Series:
    """exp(-(d - rho) / sigma) of each row's ascending distances; sigma makes them sum to log2 of their number."""

    def one(d: np.ndarray) -> np.ndarray:
        d = np.asarray(d, float)
        above = d[d > 0]
        over = np.maximum(0.0, d - (above[0] if len(above) else 0.0))
        want, lo, hi, sigma = math.log2(max(2, len(d))), 0.0, math.inf, 1.0
        for _ in range(64):
            total = np.exp(-over / sigma).sum()
            if abs(total - want) < 1e-6:
                break
            lo, hi = (lo, sigma) if total > want else (sigma, hi)
            sigma = 2 * sigma if hi == math.inf else (lo + hi) / 2
        return np.exp(-over / max(sigma, 1e-3 * d.mean() if d.mean() > 0 else 1e-12))

    return gaps.map(one)


def fuzzy_sets(near: DataFrame) -> DataFrame:
    """u, v, p: membership of v in the neighbourhood of u, from u, v, distance."""
    lists = near.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("distance", "v"))).alias("n"))  # k entries a row
    known = lists.select("u", F.col("n.v").alias("v"), _strengths(F.col("n.distance")).alias("p"))
    return known.select("u", F.explode(F.arrays_zip("v", "p")).alias("e")).select("u", "e.v", "e.p")


def fuzzy_graph(near: DataFrame) -> DataFrame:
    """u, v, p in both directions: the fuzzy union p + q - pq of the two ends' memberships."""
    one = fuzzy_sets(near)
    both = one.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "p").groupBy("u", "v").agg(F.round(1 - F.product(1 - F.col("p")), 12).alias("p"))
    return both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "p"))


def _epochs(sent, seed: int, turn: int, epochs: int, total: int):
    """A shard's epochs of one round."""

    def run(key, mine: pa.Table, edges: pa.Table) -> pa.Table:
        pool, n, a, b = sent.value
        mine = mine.sort_by("id")
        ids = mine.column("id").to_numpy()
        y = np.stack([mine.column(c).to_numpy() for c in ("x0", "x1")], axis=1).copy()
        rng = np.random.default_rng([seed, turn, key[0].as_py() & 0xFFFFFFFF])
        if edges.num_rows:
            edges = edges.sort_by([("u", "ascending"), ("v", "ascending")])
            u = np.searchsorted(ids, edges.column("u").to_numpy())
            v = edges.column("v").to_numpy()
            at = np.minimum(np.searchsorted(ids, v), len(ids) - 1)
            inside = ids[at] == v
            there = np.stack([edges.column(c).to_numpy() for c in ("x0", "x1")], axis=1)
            p = edges.column("p").to_numpy()
            for e in range(epochs):
                rate = 1.0 - (turn * epochs + e) / total
                drawn = rng.permutation(np.flatnonzero(rng.random(len(p)) < p))
                for lo in range(0, len(drawn), max(64, len(ids))):
                    some = drawn[lo : lo + max(64, len(ids))]
                    other = np.where(inside[some, None], y[at[some]], there[some])
                    gap = y[u[some]] - other
                    square = gap[..., :1] ** 2 + gap[..., 1:] ** 2
                    near = np.maximum(square, 1e-12)
                    pull = np.where(square > 0, -2 * a * b * near ** (b - 1) / (1 + a * near**b), 0.0)
                    move = np.zeros_like(y)
                    np.add.at(move, u[some], np.clip(pull * gap, -4, 4))
                    # a share of the draws that the shard has of all rows falls on its own, where they are now
                    own = rng.random((len(some), NEGATIVE, 1)) < len(ids) / n
                    far = np.where(own, y[rng.integers(0, len(ids), own.shape[:2])], pool[rng.integers(0, len(pool), own.shape[:2])])
                    gap = y[u[some]][:, None, :] - far
                    square = gap[..., :1] ** 2 + gap[..., 1:] ** 2
                    push = np.where(square > 0, 2 * b / ((0.001 + square) * (1 + a * square**b)), 0.0)
                    np.add.at(move, u[some], np.clip(push * gap, -4, 4).sum(axis=1))
                    met = np.maximum(1, np.bincount(u[some], minlength=len(ids)))[:, None]
                    y += rate * move / met
        return pa.table([mine.column("id"), mine.column("shard"), pa.array(y[:, 0]), pa.array(y[:, 1])], ["id", "shard", "x0", "x1"])

    return run


def _pool(places: DataFrame, seed: int) -> np.ndarray:
    """At most about POOL places, drawn by a hash."""
    n, draw = places.count(), F.xxhash64("id", F.lit(seed))
    some = places if n <= POOL else places.where(draw < F.lit((POOL << 64) // n - (1 << 63)))
    return np.array([(r.x0, r.x1) for r in some.select("id", "x0", "x1").orderBy("id").collect()], float).reshape(-1, 2)


def _start(spark, unit: DataFrame) -> DataFrame:
    """First places: principal components, scaled to a spread of 10, with a little noise from a hash of the id."""
    first = vectors.reduce_dimensions(unit, 2, "v", "y").select("id", F.get("y", 0).alias("a"), F.get("y", 1).alias("b"))
    size = first.agg(F.max(F.greatest(F.abs("a"), F.abs("b")))).first()[0] or 1.0
    noise = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2001)) - 1000) * 1e-7
    placed = lambda c, k: F.round(F.col(c) * (10.0 / size), 4) + noise(k)  # noqa: E731  sums in another order must not move the start
    return first.select("id", placed("a", 1).alias("x0"), placed("b", 2).alias("x1"))


def reduce(rows: DataFrame, k: int = 15, min_dist: float = 0.1, rounds: int = 6, epochs: int = 40, probes: int | None = None, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding", keep_index: list | None = None, keep_near: list | None = None) -> DataFrame:
    """id_col and reduced, two coordinates, of each row with a usable vector.

    Ids are unique longs.  Nearness is that of directions (cosine).  Null, zero
    or non-finite vectors and those of another width than the first are left
    out; up to two rows, and rows without neighbours, stay where they begin.
    keep_index, a list, gets the index, which `transform` needs; keep_near gets
    the neighbours that the layout rests on: u, v and their cosine distance.
    """
    spark = rows.sparkSession
    index = ann.build(rows, workspace.new_path(spark, "layout-index"), None, id_col, vector_col)
    if keep_index is not None:
        keep_index.append(index)
    if not index.lists:
        if keep_near is not None:
            keep_near.append(spark.createDataFrame([], "u long, v long, distance double"))
        return spark.createDataFrame([], f"{id_col} long, reduced array<double>")
    unit = index.rows(spark).select(F.col("id").cast("long").alias("id"), "v", "list")
    found = ann.search(index, unit.select(F.col("id").alias("query_id"), F.col("v").alias("query_vector")), k, probes or index.lists, with_self=False)
    near = written(found.select(F.col("query_id").alias("u"), F.col("id").alias("v"), "distance"), "layout-near")
    if keep_near is not None:
        keep_near.append(near)
    n = unit.count()
    sizes = unit.groupBy("list").agg(F.count("*").alias("n")).withColumn("subs", F.ceil(F.col("n") / SHARD))
    if n <= SHARD:
        shards = unit.select("id", F.lit(0).cast("long").alias("shard"))
    else:
        shards = unit.join(F.broadcast(sizes), "list").select("id", (F.col("list").cast("long") * 1_000_000 + F.pmod(F.xxhash64("id"), F.col("subs"))).alias("shard"))
    # shards stay, so each edge is told its own once
    graph = written(fuzzy_graph(near).join(shards.withColumnRenamed("id", "u"), "u").select("shard", "u", "v", "p"), "layout-graph")
    places = written(_start(spark, unit).join(shards, "id").select("id", "shard", "x0", "x1"), "layout-places")
    for turn in range(rounds if n > 2 else 0):
        sent = spark.sparkContext.broadcast((_pool(places, seed + turn), n, *curve(min_dist)))
        there = spark.read.schema(places.schema).parquet(places.path)  # columns of its own, for the cogroup
        ends = graph.join(there.select(F.col("id").alias("v"), "x0", "x1"), "v")
        moved = places.groupBy("shard").cogroup(ends.select("shard", "u", "v", "p", "x0", "x1").groupBy("shard"))
        places = written(moved.applyInArrow(_epochs(sent, seed, turn, epochs, rounds * epochs), "id long, shard long, x0 double, x1 double"), "layout-places")
    return places.select(F.col("id").alias(id_col), F.array("x0", "x1").alias("reduced"))


def transform(index: ann.Index, placed: DataFrame, new: DataFrame, k: int = 15, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col and reduced of new rows: the mean place of their nearest placed rows, weighted by membership. An equal vector gets the place itself."""
    found = ann.search(index, new.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("query_vector")), k, probes or max(1, index.lists))
    same = F.min("distance").over(Window.partitionBy("query_id")) <= 1e-9
    met = found.withColumn("same", same).where(~F.col("same") | (F.col("distance") <= 1e-9))
    sets = fuzzy_sets(met.select(F.col("query_id").alias("u"), F.col("id").alias("v"), "distance"))
    there = placed.select(F.col(id_col).alias("v"), F.get("reduced", 0).alias("x0"), F.get("reduced", 1).alias("x1"))
    mean = lambda c: F.sum(F.col("p") * F.col(c)) / F.sum("p")
    return sets.join(there, "v").groupBy("u").agg(F.array(mean("x0"), mean("x1")).alias("reduced")).withColumnRenamed("u", id_col)


def kept_neighbours(near: DataFrame, placed: DataFrame, k: int = 15, id_col: str = "vec_id") -> DataFrame:
    """kept: the share of edges u, v of a neighbour graph that the graph of the rows reduced to two coordinates has too."""
    there = plane.neighbours(placed, k, id_col).select("u", "v", F.lit(1).alias("hit"))
    met = near.select("u", "v").join(there, ["u", "v"], "left")
    return met.agg(F.round(F.count("hit") / F.count("*"), 4).alias("kept"))
