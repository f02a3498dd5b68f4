"""Exact top-k inner products by the threshold algorithm.

Candidates are cut into blocks.  In a block every dimension has its list of
rows sorted by value; a query walks each list from its favourable end (the
large values for a positive weight, the small ones for a negative), and scores
every row when it first meets it.  After depth t no unseen row can score more
than the threshold
    sum over d of max(q_d * top_d[t], q_d * bottom_d[t]),
so a query is done with the block as soon as its k-th best score is above it
(at equality an unseen row could tie, so the walk goes on), or when its lists
hold no unseen row any more.  The k best of one block are what the next block
of the task must beat; tasks return their k best rows for each query and those
are merged.

Where no dimension stands out (unit vectors in random directions), the
threshold stays above every score and the lists are walked until they have
shown every row; `Walk` tells which it was.

Queries are taken in blocks of `query_rows`, which are broadcast: their size
is that bound times the width, whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.scratch import new_path

SCALE = 256
BLOCK_ROWS = 8192
QUERY_ROWS = 16_384
#: Depth of a walk's first step; each further step doubles it.
FIRST_DEPTH = 32
LONG = (1 << 63) - 1
#: Sums of products up to which floats of 32 and 64 bits are exact.
EXACT32, EXACT64 = float(1 << 24), float(1 << 53)


def usable(vector: Column) -> Column:
    """The vector is there, and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).reshape(len(column), -1)


def _exact(q: np.ndarray, c: np.ndarray) -> type:
    """The fastest number type in which all inner products of the two are exact; Python integers beyond doubles."""
    most = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    return np.float32 if most < EXACT32 else np.float64 if most < EXACT64 else object


def _as(x: np.ndarray, kind: type) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) if kind is object else x.astype(kind)


@dataclass
class Walk:
    """A query's walk through blocks: its k best so far (largest score first, ties by id), and for each block how deep it went, how many rows it scored, and whether the threshold ended it."""

    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    scores: np.ndarray = field(default_factory=lambda: np.empty(0, object))
    ends: list[tuple[int, int, bool]] = field(default_factory=list)

    def meet(self, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
        if len(self.ids) == k:
            enough = np.flatnonzero(scores >= self.scores[-1])
        elif len(scores) > k and scores.dtype != object:
            enough = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        else:
            enough = np.arange(len(scores))
        if not len(enough):
            return
        every = [*zip(self.scores, self.ids), *((int(s), int(i)) for s, i in zip(scores[enough], ids[enough]))]
        best = sorted(every, key=lambda x: (-x[0], x[1]))[:k]
        self.ids, self.scores = np.array([i for _, i in best], np.int64), np.array([s for s, _ in best], object)


def threshold_topk(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, walks: list[Walk] | None = None) -> list[Walk]:
    """Each query's walk through one more block of candidates.

    Candidates with the query's own id take no part.
    """
    walks = walks or [Walk() for _ in q]
    n, width = c.shape
    kind = _exact(q, c)
    order = np.argsort(c, axis=0, kind="stable").T.astype(np.int32)  # row d lists the candidates by dimension d, ascending
    q, c = _as(q, kind), _as(c, kind)
    ranked = np.take_along_axis(c.T, order, axis=1)
    for own, weights, walk in zip(qid, q, walks):
        up, down = np.flatnonzero(weights > 0), np.flatnonzero(weights < 0)
        if not len(up) and not len(down):  # all rows tie: any list shows them
            up = np.arange(min(width, 1))
        unseen = cid != own
        done, depth, scored = 0, min(FIRST_DEPTH, n), 0
        while True:
            met = np.zeros(n, bool)
            met[order[up, n - depth : n - done].ravel()] = True
            met[order[down, done:depth].ravel()] = True
            rows = np.flatnonzero(met & unseen)
            unseen[rows] = False
            scored += len(rows)
            if len(rows):
                walk.meet(cid[rows], c[rows] @ weights, k)
            if depth == n or not unseen.any():
                walk.ends.append((depth, scored, False))
                break
            bound = sum(map(int, weights[up] * ranked[up, n - 1 - depth])) + sum(map(int, weights[down] * ranked[down, depth]))
            if len(walk.ids) == k and walk.scores[-1] > bound:
                walk.ends.append((depth, scored, True))
                break
            done, depth = depth, min(2 * depth, n)
    return walks


def _search(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_width = queries.value
        held: dict[int, tuple[list, list]] = {}
        walks: dict[int, list[Walk]] = {}

        def walk(width: int) -> None:
            ids, vectors = held.pop(width)
            walks[width] = threshold_topk(*by_width[width], np.concatenate(ids), np.concatenate(vectors), k, walks.get(width))

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for width in map(int, np.unique(sizes)):
                if width not in by_width:
                    continue
                rows = np.flatnonzero(sizes == width)
                mine = held.setdefault(width, ([], []))
                mine[0].append(ids[rows])
                mine[1].append(_matrix(b.column(1).take(pa.array(rows))))
                if sum(map(len, mine[0])) >= BLOCK_ROWS:
                    walk(width)
        for width in list(held):
            walk(width)
        for width, found in walks.items():
            own = [np.full(len(w.ids), i) for i, w in zip(by_width[width][0], found)]
            columns = (np.concatenate(own), np.concatenate([w.ids for w in found]), np.array([max(-LONG - 1, min(LONG, s)) for w in found for s in w.scores], object))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in columns], ["query_id", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products with the other vectors.

    Components become floor(256 * x).  Ties go to the smaller vec_id; fewer than
    k candidates give fewer rows.  Rows whose id or vector is null, or whose
    vector has a null or non-finite component, take no part; a query meets only
    vectors of its own width; rows that share the query's vec_id are its own and
    are left out, others that repeat each count; of query rows that share a
    vec_id the least vector asks.  Scores beyond a long end at its limits.
    Other columns are ignored.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ok = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    wanted = ok(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = ok(vectors)
    blocks = -(-wanted.count() // query_rows)
    schema = "query_id long, rank int, vec_id long, score long"
    if not blocks:
        return spark.createDataFrame([], schema)
    path = new_path(spark, "topk") if blocks > 1 else None
    for i in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)
        frame = part.toPandas().sort_values("vec_id")
        by_width = {}
        for width, g in frame.groupby(frame["v"].map(len)):
            if width:
                by_width[int(width)] = g["vec_id"].to_numpy(np.int64), np.floor(np.stack(g["v"].map(np.asarray)).astype(np.float64) * SCALE)
        sent = spark.sparkContext.broadcast(by_width)
        local = rows.mapInArrow(_search(sent, k), "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if path is None:
            return best
        best.write.mode("append").parquet(path)
        sent.unpersist()
    return spark.read.schema(schema).parquet(path)
