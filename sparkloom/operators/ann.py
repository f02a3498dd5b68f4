"""Vector index of coarse centroids and inverted lists: every row is in the list of its nearest centroid, and a search reads the lists nearest to the query.

Centroids are fitted on a bounded sample (SAMPLE_PER_LIST rows a list, drawn by
a hash of the id) and saved beside the lists, which are partitions of one
Parquet table: a search prunes to the partitions it probes, an upsert rewrites
those it touches.  Lists of any size are searched in blocks of BLOCK rows, and
the queries that probe a list in blocks too, each pair of blocks by one matrix
product in a task of bounded memory.  With as many probes as lists the search
is exact: it is then one over all pairs, in cells of bounded size, in which no
query is repeated for each list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import vectors
from sparkloom.sources import sinks, workspace

MAX_LISTS = 4096
SAMPLE_PER_LIST = 64
LLOYD_ROUNDS = 10
BLOCK = 4096
#: Vectors of one side of a cell of a search over all pairs: at most this many, and bytes of them.
CELL_ROWS, CELL_BYTES = 1 << 16, 32 << 20
#: Distances to centroids, and numbers of repeated vectors, that a task holds at once.
HELD = 1 << 21


@dataclass
class Index:
    """Where the lists lie, and their centroids: unit vectors, or any under the euclidean metric."""

    path: str
    centroids: np.ndarray
    euclidean: bool = False

    @property
    def lists(self) -> int:
        return len(self.centroids)

    def rows(self, spark: SparkSession) -> DataFrame:
        """id, v and list of all rows; v has length 1 unless the metric is euclidean."""
        return spark.read.parquet(f"{self.path}/lists")


def _usable(rows: DataFrame, id_col: str, vector_col: str, euclidean: bool, width: int | None = None) -> DataFrame:
    v = vectors.as_double(F.col(vector_col))
    out = rows.select(F.col(id_col).alias("id"), (v if euclidean else vectors.l2_normalize(v)).alias("v"))
    out = out.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return out if width is None else out.where(F.size("v") == width)


def usable(rows: DataFrame, id_col: str, vector_col: str, euclidean: bool = False, width: int | None = None) -> DataFrame:
    """id and v of the rows with a usable vector of the width (that of the first, if not given)."""
    return _of_one_width(_usable(rows, id_col, vector_col, euclidean, width), width)


def _of_one_width(unit: DataFrame, width: int | None) -> DataFrame:
    if width is None and (first := unit.orderBy("id").select(F.size("v")).first()):
        unit = unit.where(F.size("v") == first[0])
    return unit


def fit_centroids(unit: DataFrame, lists: int | None = None, euclidean: bool = False, seed: int = 42) -> np.ndarray:
    """Centroids by k-means (spherical for unit vectors) on a sample of at most SAMPLE_PER_LIST rows a list; about the root of the number of rows, MAX_LISTS at most."""
    n = unit.count()
    lists = max(1, min(MAX_LISTS, lists or round(n**0.5)))
    wanted = SAMPLE_PER_LIST * lists
    draw = F.xxhash64("id", F.lit(seed))
    sample = unit if n <= wanted else unit.where(draw < F.lit((wanted << 64) // n - (1 << 63)))
    held = sample.select("v", draw.alias("h")).orderBy("h", "v").select("v").toArrow().column("v").combine_chunks()
    if not len(held):
        return np.zeros((0, 0))
    x = _matrix(held)
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(LLOYD_ROUNDS):
        near = np.concatenate([np.argmin(_far(x[lo : lo + BLOCK], centre), axis=1) for lo in range(0, len(x), BLOCK)])
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        size = np.bincount(near, minlength=len(centre))[:, None] if euclidean else np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centre)
    return centre


def _far(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances less what is the same for all centroids."""
    return (centre * centre).sum(axis=1) - 2.0 * (x @ centre.T)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _nearest_lists(sent, probes: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = sent.value
        step = max(1, HELD // max(len(centre), probes * centre.shape[1]))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                b = batch.slice(lo, step)
                near = _far(_matrix(b.column(1)), centre)
                take = np.argpartition(near, probes - 1, axis=1)[:, :probes] if probes < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
                rows = np.repeat(np.arange(len(near)), take.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(take.ravel().astype(np.int32))], [name, "v", "list"])

    return run


def _dealt(unit: DataFrame, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """Rows with each of their nearest lists."""
    sent = unit.sparkSession.sparkContext.broadcast(centroids)
    name = unit.columns[0]
    kind = unit.schema[name].dataType.simpleString()
    return unit.mapInArrow(_nearest_lists(sent, min(probes, len(centroids)), name), f"{name} {kind}, v array<double>, list int")


def build(rows: DataFrame, path: str, lists: int | None = None, id_col: str = "id", vector_col: str = "embedding", width: int | None = None, euclidean: bool = False) -> Index:
    """Write the index of a table of vectors with unique ids; rows without a usable vector of the width (that of the first, if not given) are left out."""
    spark, held = rows.sparkSession, workspace.written(_usable(rows, id_col, vector_col, euclidean, width), "index-rows")  # else normalised for each pass
    unit = _of_one_width(held, width)
    centre = fit_centroids(unit, lists, euclidean)
    spark.createDataFrame([(i, c.tolist(), euclidean) for i, c in enumerate(centre)], "list int, v array<double>, euclidean boolean").write.mode("overwrite").parquet(f"{path}/centroids")
    dealt = _dealt(unit, centre) if len(centre) else unit.withColumn("list", F.lit(0))
    dealt.repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    workspace.remove(spark, held.path)
    return Index(path, centre, euclidean)


def load(spark: SparkSession, path: str) -> Index:
    """An index that `build` wrote."""
    held = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # at most MAX_LISTS
    return Index(path, np.array([r.v for r in held], float), any(r.euclidean for r in held))


def upsert(index: Index, new: DataFrame, order: str, id_col: str = "id", vector_col: str = "embedding") -> None:
    """Put new rows (the last of each id by `order`) in the place of stored ones, whichever list those were in.

    Lists that rows leave and lists that they enter are staged beside the index
    and put in place as partitions; others are not read beyond their ids.
    """
    spark = new.sparkSession
    last = new.groupBy(F.col(id_col).alias("id")).agg(F.max_by(vector_col, order).alias("x"))
    dealt = workspace.written(_dealt(_usable(last, "id", "x", index.euclidean, index.centroids.shape[1]), index.centroids), "index-new")
    stored = index.rows(spark)
    left = stored.select("id", "list").join(dealt.select("id"), "id", "left_semi").select("list")
    touched = workspace.written(left.union(dealt.select("list")).distinct(), "index-touched")
    kept = stored.join(F.broadcast(touched), "list", "left_semi").join(dealt.select("id"), "id", "left_anti")
    staged = workspace.written(kept.select("id", "v", "list").unionByName(dealt), "index-staged")
    sinks.write_partitions(staged.repartition("list"), f"{index.path}/lists", "list")
    for r in touched.join(staged.select("list").distinct(), "list", "left_anti").collect():  # at most MAX_LISTS
        workspace.remove(spark, f"{index.path}/lists/list={r.list}")
    for t in (dealt, touched, staged):
        workspace.remove(spark, t.path)


def _pairs(k: int, with_self: bool, euclidean: bool, digits: int, best=vectors.block_best):
    def run(_, members: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "id", "distance"]
        if not members.num_rows or not asked.num_rows:
            empty = (asked.schema.field("query_id").type, members.schema.field("id").type, pa.float64())
            return pa.table([pa.array([], t) for t in empty], names)
        ids, qids = members.column("id").combine_chunks(), asked.column("query_id").combine_chunks()
        out = best(qids, _matrix(asked.column("v").combine_chunks()), ids, _matrix(members.column("v").combine_chunks()), k, with_self, euclidean, digits)
        return pa.table(list(out), names)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", vectors.distance_to_score(F.col("distance")))


def all_pairs(stored: DataFrame, asked: DataFrame, k: int, with_self: bool = True, euclidean: bool = False, digits: int = 12) -> DataFrame:
    """query_id, id, distance, score, rank: the k nearest of all stored rows (id, v) for each query (query_id, v); vectors are usable and of one width.

    Rows and queries are dealt by hashes over a grid of cells of at most about
    CELL_ROWS of either, and over enough cells for all cores; a task holds one
    cell.  A vector goes to one row or column of cells, so what is shuffled
    grows with the root of the number of cells, and a cell returns k rows a query.
    """
    cores = asked.sparkSession.sparkContext.defaultParallelism
    width = (stored.select(F.size("v").alias("n")).first() or {"n": 1})["n"]
    most = max(1, min(CELL_ROWS, CELL_BYTES // (8 * max(1, width))))
    deal = lambda n: max(1, -(-n // most), min(-(-n // BLOCK), math.ceil((2 * cores) ** 0.5)))
    rows, cols = deal(stored.count()), deal(asked.count())
    every = lambda n: F.explode(F.array(*(F.lit(i) for i in range(n))) if n <= 64 else F.sequence(F.lit(0), F.lit(n - 1)))
    members = stored.select(F.pmod(F.xxhash64("id"), F.lit(rows)).cast("int").alias("row"), every(cols).alias("col"), "id", "v")
    turns = asked.select(every(rows).alias("row"), F.pmod(F.xxhash64("query_id"), F.lit(cols)).cast("int").alias("col"), "query_id", "v")
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {stored.schema['id'].dataType.simpleString()}, distance double"
    # few cells meet in one of many partitions; with as many as cores, one core would get a third of them
    spread = lambda x: x.repartition(min(4096, 8 * rows * cols), "row", "col").groupBy("row", "col")
    found = spread(members).cogroup(spread(turns)).applyInArrow(_pairs(k, with_self, euclidean, digits, vectors.cell_best), schema)
    return _ranked(found, k)


def search(index: Index, queries: DataFrame, k: int, probes: int = 8, id_col: str = "query_id", vector_col: str = "query_vector", with_self: bool = True, digits: int = 12) -> DataFrame:
    """query_id, id, distance, score, rank: the k nearest rows in the `probes` lists nearest to each query; ties go to the smaller id.

    Cosine distances count to that many digits.  with_self=False leaves out the row whose id is the query's.  Queries without
    a usable vector of the index's width give no rows.
    """
    spark = queries.sparkSession
    if not index.lists:
        kind = queries.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kind}, id {kind}, distance double, rank int, score double")
    asked = _usable(queries, id_col, vector_col, index.euclidean, index.centroids.shape[1]).withColumnRenamed("id", "query_id")
    stored = index.rows(spark)
    if probes >= index.lists:
        return all_pairs(stored.select("id", "v"), asked, k, with_self, index.euclidean, digits)
    asked = workspace.written(_dealt(asked, index.centroids, probes), "index-asked")
    # blocks of each list, on both sides; at most MAX_LISTS rows
    sizes = {r.list: r.n for r in stored.groupBy("list").agg(F.count("*").alias("n")).collect()}
    wanted = {r.list: r.n for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    cut = [(i, -(-sizes[i] // BLOCK), -(-n // BLOCK)) for i, n in wanted.items() if i in sizes]
    blocks = F.broadcast(spark.createDataFrame(cut, "list int, subs int, q_subs int"))
    members = stored.join(blocks, "list").select("list", F.pmod(F.xxhash64("id"), F.col("subs")).alias("sub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_subs") - F.lit(1).cast("long"))).alias("q_sub"), "id", "v")
    turns = asked.join(blocks, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - F.lit(1).cast("long"))).alias("sub"), F.pmod(F.xxhash64("query_id"), F.col("q_subs")).alias("q_sub"), "query_id", "v")
    keys = ["list", "sub", "q_sub"]
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {stored.schema['id'].dataType.simpleString()}, distance double"
    found = members.groupBy(*keys).cogroup(turns.groupBy(*keys)).applyInArrow(_pairs(k, with_self, index.euclidean, digits), schema)
    return _ranked(found, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, wanted, met and their share: how many of the exact results (query_id, id) a search found."""
    met = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    out = met.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("met"))
    return out.withColumn("recall", F.round(F.col("met") / F.col("wanted"), 6))
