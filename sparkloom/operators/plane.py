"""Exact nearest neighbours of places in the plane, without all pairs of them.

The plane is cut into tiles of bounded size by the medians of a sample.  In its
own tile each place learns how far its neighbours are at most, and then asks
the tiles that this circle touches, and no others.  Rows at one place ask once,
and only as many of them as can be among the nearest are stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import ann, vectors
from sparkloom.sources.workspace import written

#: Rows of a tile, tiles at most (beyond that they grow), and rows of the sample for each.
TILE, MOST_TILES, SAMPLE = 2048, 16_384, 32


def _cut(x: np.ndarray, most: int, tiles: list):
    """A tree of (axis, value, below, from there on); its leaves are numbers of tiles."""
    axis = int(np.argmax(np.ptp(x, axis=0))) if len(x) else 0
    s = np.sort(x[:, axis])
    if len(x) <= most or s[0] == s[-1]:
        tiles.append(len(tiles))
        return tiles[-1]
    at = s[len(s) // 2]
    if at == s[0]:  # something must be below
        at = s[np.searchsorted(s, at, "right")]
    low = x[:, axis] < at
    return axis, float(at), _cut(x[low], most, tiles), _cut(x[~low], most, tiles)


def _touched(tree, x: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Rows and the number of each tile that their circles touch; with a radius of zero every row is in one."""
    open_nodes = [(tree, np.arange(len(x)))]
    while open_nodes:
        node, rows = open_nodes.pop()
        if not len(rows):
            continue
        if isinstance(node, int):
            yield rows, node
            continue
        axis, at, below, above = node
        open_nodes.append((below, rows[x[rows, axis] - radius[rows] < at]))
        open_nodes.append((above, rows[x[rows, axis] + radius[rows] >= at]))


def _places(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(table.column(c)) for c in ("x0", "x1")], axis=1)


def _dealt(sent):
    """Rows (id, x0, x1, nth or radius) with the tiles that they touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _places(b)
            radius = np.zeros(len(x))
            if "radius" in b.schema.names:
                r = b.column("radius").to_numpy(zero_copy_only=False)
                radius = r + 1e-11 + 1e-12 * (np.abs(x).sum(axis=1) + r)  # more than rounding
            for rows, tile in _touched(sent.value, x, radius):
                some = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), tile, np.int32)), *some.columns], ["tile", *b.schema.names])

    return run


def _reach(k: int):
    """How far the k nearest of each place are at most, by its own tile."""

    def run(members: pa.Table) -> pa.Table:
        asked = members.filter(pc.equal(members.column("nth"), 1))
        ids = asked.column("id").combine_chunks()
        qids, _, far = vectors.cell_best(ids, _places(asked), members.column("id").combine_chunks(), _places(members), k, True, True)
        row = pc.index_in(qids, ids).to_numpy()
        last = np.zeros(len(ids))
        np.maximum.at(last, row, far.to_numpy())
        last[np.bincount(row, minlength=len(ids)) < k] = np.inf
        return pa.table([ids, asked.column("x0"), asked.column("x1"), pa.array(last)], ["id", "x0", "x1", "radius"])

    return run


def _nearest(k: int):
    def run(members: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "id", "distance"]
        if not members.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        ids, qids = members.column("id").combine_chunks(), asked.column("id").combine_chunks()
        return pa.table(list(vectors.cell_best(qids, _places(asked), ids, _places(members), k, True, True)), names)

    return run


def neighbours(rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "reduced") -> DataFrame:
    """u, v, distance: each row's k nearest by euclidean distance to twelve digits, ties by the smaller id; ids are unique longs, rows without a usable place are left out."""
    spark = rows.sparkSession
    points = ann.usable(rows, id_col, vector_col, euclidean=True, width=2)
    points = written(points.select(F.col("id").cast("long").alias("id"), F.get("v", 0).alias("x0"), F.get("v", 1).alias("x1")), "plane-points")
    nth = F.row_number().over(Window.partitionBy("x0", "x1").orderBy("id"))
    # with its own row gone, k are left
    first = written(points.withColumn("nth", nth).where(F.col("nth") <= k + 1), "plane-first")
    n, draw = first.count(), F.xxhash64("id", F.lit(42))
    wanted = SAMPLE * max(1, min(MOST_TILES, -(-n // TILE)))
    sample = first if n <= wanted else first.where(draw < F.lit((wanted << 64) // n - (1 << 63)))
    tree = _cut(_places(sample.select("x0", "x1").toArrow()), SAMPLE if n > TILE else max(1, n), [])
    sent = spark.sparkContext.broadcast(tree)
    members = first.mapInArrow(_dealt(sent), "tile int, id long, x0 double, x1 double, nth int")
    reach = members.groupBy("tile").applyInArrow(_reach(k + 1), "id long, x0 double, x1 double, radius double")
    turns = reach.mapInArrow(_dealt(sent), "tile int, id long, x0 double, x1 double, radius double")
    found = members.groupBy("tile").cogroup(turns.groupBy("tile")).applyInArrow(_nearest(k + 1), "query_id long, id long, distance double")
    lists = found.groupBy(F.col("query_id").alias("id")).agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, k + 1).alias("n"))  # k + 1 entries a touched tile
    known = written(first.where("nth = 1").select("id", "x0", "x1").join(lists, "id").select("x0", "x1", "n"), "plane-known")
    others = F.slice(F.filter("n", lambda e: e["id"] != F.col("id")), 1, k)
    return points.join(known, ["x0", "x1"]).select(F.col("id").alias("u"), F.explode(others).alias("e")).select("u", F.col("e.id").alias("v"), F.col("e.distance").alias("distance"))
