"""Density clusters of vectors: mutual reachability over a graph of nearest neighbours, its minimum spanning forest, a condensed tree and the clusters that last longest in it.

The forest is found by Borůvka rounds over the table of edges.  The tree is
condensed from its lightest edges up, in chunks of bounded size: a chunk's task
gets its edges with the state of the components at their ends (size, cluster,
sums), and returns which components merged, which points left which cluster at
which density, and which clusters ended.  Points are told by joins; no task
holds more than a chunk.

Density is 1 / distance.  Parts that the graph does not connect are apart at
any distance.  Distances below SHORTEST count as SHORTEST.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import ann
from sparkloom.sources import workspace
from sparkloom.sources.workspace import written

SHORTEST = 1e-12
#: Edges of a chunk of the tree, and edges left that one task finishes.
CHUNK, TAIL = 1_000_000, 200_000


def neighbours(rows: DataFrame, k: int, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """u, v, distance: each row's k nearest by euclidean distance: of all rows, or from the lists of an index that are nearest if probes is given."""
    spark = rows.sparkSession
    if probes is None:
        points = written(ann.usable(rows, id_col, vector_col, euclidean=True), "density-points")
        found = ann.all_pairs(points, points.withColumnRenamed("id", "query_id"), k, with_self=False, euclidean=True)
    else:
        index = ann.build(rows, workspace.new_path(spark, "density-index"), None, id_col, vector_col, euclidean=True)
        asked = index.rows(spark).select(F.col("id").alias("query_id"), F.col("v").alias("query_vector")) if index.lists else rows.limit(0).select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("query_vector"))
        found = ann.search(index, asked, k, probes, with_self=False)
    return found.select(F.col("query_id").cast("long").alias("u"), F.col("id").cast("long").alias("v"), "distance", "rank")


def reachability(near: DataFrame, min_samples: int = 1) -> DataFrame:
    """u, v (u < v), w: each edge's mutual reachability, the largest of its length and the two ends' distances to their min_samples-th neighbour."""
    core = near.groupBy("u").agg(F.max(F.when(F.col("rank") <= min_samples, F.col("distance"))).alias("core"))
    pairs = near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "distance").groupBy("a", "b").agg(F.min("distance").alias("d"))
    ends = pairs.join(core.select(F.col("u").alias("a"), F.col("core").alias("c_a")), "a").join(core.select(F.col("u").alias("b"), F.col("core").alias("c_b")), "b")
    return ends.select(F.col("a").alias("u"), F.col("b").alias("v"), F.greatest("d", "c_a", "c_b").alias("w"))


# --- minimum spanning forest


def _kruskal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of edges in order, between the components of their ends."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    for b in batches:
        keep = []
        for cu, cv in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
            a, c = root(cu), root(cv)
            keep.append(a != c)
            up[a] = c
        yield b.filter(pa.array(keep, pa.bool_())).select([0, 1, 2])


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (u, v, w) of the minimum spanning forest; equal weights go by u, then v.

    Borůvka rounds: the least edge that leaves each component is taken, and
    pointers along these edges, halved until they stay, name the new
    components.  Components at least halve in number each round.  When few
    edges between different components are left, one task ends it.
    """
    spark = edges.sparkSession
    left = written(edges.select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")), "forest-edges")
    forest = None
    add = lambda more: more if forest is None else forest.unionByName(more)
    while (n := left.count()) > TAIL:
        edge = F.struct("w", "u", "v")
        both = left.select(F.col("cu").alias("c"), edge.alias("e"), F.col("cv").alias("to")).unionByName(left.select(F.col("cv").alias("c"), edge.alias("e"), F.col("cu").alias("to")))
        least = written(both.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", F.col("m.e").alias("e"), F.col("m.to").alias("to")), "forest-least")
        forest = add(written(least.select("e.u", "e.v", "e.w").distinct(), "forest-part"))
        # of two components that chose each other the smaller is the root
        back = least.select(F.col("c").alias("to"), F.col("to").alias("its"))
        point = written(least.join(back, "to", "left").select("c", F.when((F.col("its") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p")), "forest-pointers")
        while True:
            ahead = point.select(F.col("c").alias("p"), F.col("p").alias("q"))
            moved = written(point.join(ahead, "p").select("c", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("new")), "forest-pointers")
            point = moved.drop("new")
            if not moved.where("new").limit(1).count():
                break
        name = lambda c: point.select(F.col("c").alias(c), F.col("p").alias(f"{c}_new"))
        again = left.join(name("cu"), "cu").join(name("cv"), "cv").select("u", "v", "w", F.col("cu_new").alias("cu"), F.col("cv_new").alias("cv")).where("cu <> cv")
        # of the edges between two components only the least can be taken
        kept = again.groupBy(F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv")).agg(F.min(F.struct("w", "u", "v")).alias("e"))
        left = written(kept.select("e.u", "e.v", "e.w", "cu", "cv"), "forest-edges")
    if n:
        order = left.coalesce(1).sortWithinPartitions("w", "u", "v")
        forest = add(written(order.mapInArrow(_kruskal, "u long, v long, w double"), "forest-part"))
    return forest if forest is not None else spark.createDataFrame([], "u long, v long, w double")


# --- condensed tree

_STATE = "c long, size long, cluster long, total double, kids double, top double"
_EVENT = "kind string, c long, to long, size long, cluster long, total double, kids double, top double, own boolean"


class _Components:
    """Components of a chunk. A small one lists those of the chunk's start that it is made of; a large one has a cluster, the sum of densities at which points left it, what its selected descendants are worth, and the highest of those densities."""

    def __init__(self, least: int, first_id: int):
        self.least, self.next = least, first_id
        self.up: dict[int, int] = {}
        self.at: dict[int, dict] = {}
        self.events: list[tuple] = []

    def enter(self, c: int, state: tuple) -> int:
        if c not in self.up:
            size, cluster, total, kids, top = state
            self.up[c] = c
            self.at[c] = {"size": size or 1, "cluster": cluster, "total": total or 0.0, "kids": kids or 0.0, "top": top or 0.0, "parts": [c] if cluster is None else []}
        return self.root(c)

    def root(self, c: int) -> int:
        while (p := self.up[c]) != c:
            self.up[c] = self.up[p]
            c = p
        return c

    def leave(self, x: dict, parts: list[int], size: int, density: float) -> None:
        self.events += [("fall", c, x["cluster"], 0, None, density, 0.0, 0.0, False) for c in parts]
        x["total"] += size * density
        x["top"] = max(x["top"], density)

    def found(self) -> int:
        self.next += 1
        return self.next

    def join(self, a: int, b: int, w: float) -> None:
        density = 1.0 / max(w, SHORTEST)
        if self.at[a]["size"] < self.at[b]["size"] or self.at[a]["size"] == self.at[b]["size"] and a > b:
            a, b = b, a
        x, y = self.at[a], self.at.pop(b)
        self.up[b] = a
        if x["cluster"] is not None and y["cluster"] is not None:
            new = self.found()
            worth = [self.end(z, new, density) for z in (x, y)]
            x |= {"cluster": new, "total": (x["size"] + y["size"]) * density, "kids": sum(worth), "top": density}
            x["size"] += y["size"]
        elif x["cluster"] is not None:
            self.leave(x, y["parts"], y["size"], density)
            x["size"] += y["size"]
        else:
            x["size"] += y["size"]
            x["parts"] += y["parts"]
            if x["size"] >= self.least:
                x["cluster"] = self.found()
                self.leave(x, x["parts"], x["size"], density)
                x["parts"] = []

    def end(self, x: dict, parent: int | None, density: float) -> float:
        worth, own = _worth(x["total"], x["size"], density, x["kids"])
        self.events.append(("cluster", None, parent, x["size"], x["cluster"], worth, 0.0, x["top"], own))
        return worth


def _worth(total: float, size: int, birth: float, kids: float) -> tuple[float, bool]:
    """The better of a cluster's own stability and that of its selected descendants, and whether it is its own."""
    own = total - size * birth
    return max(own, kids), own >= kids


def _condense(least: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Components(least, chunk << 40)
        for b in batches:
            for r in b.to_pylist():
                a = parts.enter(r["cu"], (r["size_u"], r["cluster_u"], r["total_u"], r["kids_u"], r["top_u"]))
                c = parts.enter(r["cv"], (r["size_v"], r["cluster_v"], r["total_v"], r["kids_v"], r["top_v"]))
                if a != c:
                    parts.join(a, c, r["w"])
        rows = parts.events
        rows += [("map", c, parts.root(c), 0, None, 0.0, 0.0, 0.0, False) for c in parts.up]
        rows += [("state", c, None, x["size"], x["cluster"], x["total"], x["kids"], x["top"], False) for c, x in parts.at.items()]
        names = [f.split()[0] for f in _EVENT.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
        for lo in range(0, len(rows), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[lo : lo + 65536]), kinds)], names)

    return run


def condensed(points: DataFrame, forest: DataFrame, min_cluster_size: int = 5) -> tuple[DataFrame, DataFrame]:
    """Which cluster each point (id) leaves at which density, and the clusters: cluster, parent (null at the top), size, worth, own (its own stability is the better), top, root.

    A cluster is a component of at least min_cluster_size points; it lasts while
    only smaller ones join it.  Points that never are in a cluster are absent.
    root marks the one cluster that holds everything, which is never selected.
    """
    spark = forest.sparkSession
    n = forest.count()
    chunks = max(1, -(-n // CHUNK))
    dealt = written(forest.repartitionByRange(chunks, "w", "u", "v").select("*", F.spark_partition_id().alias("chunk")), "condense-edges")
    of = written(points.select(F.col("id"), F.col("id").alias("c")), "condense-points")
    state = spark.createDataFrame([], _STATE)
    falls = clusters = None
    both = lambda old, new: new if old is None else old.unionByName(new)
    for chunk in range(chunks):
        edges = dealt.where(F.col("chunk") == chunk).select("u", "v", "w")
        if chunks > 1:
            for end in ("u", "v"):
                edges = edges.join(of.select(F.col("id").alias(end), F.col("c").alias(f"c{end}")), end)
        else:
            edges = edges.withColumns({"cu": F.col("u"), "cv": F.col("v")})
        for end in ("u", "v"):
            mine = state.select(F.col("c").alias(f"c{end}"), *(F.col(c).alias(f"{c}_{end}") for c in ("size", "cluster", "total", "kids", "top")))
            edges = edges.join(mine, f"c{end}", "left")
        events = written(edges.coalesce(1).sortWithinPartitions("w", "u", "v").mapInArrow(_condense(min_cluster_size, chunk + 1), _EVENT), "condense-events")
        left = events.where("kind = 'fall'").select("c", F.col("to").alias("cluster"), F.col("total").alias("density"))
        falls = both(falls, written(of.join(left, "c").select("id", "cluster", "density"), "condense-falls"))
        clusters = both(clusters, events.where("kind = 'cluster'").select("cluster", F.col("to").alias("parent"), "size", F.col("total").alias("worth"), "own", "top", F.lit(False).alias("root")))
        name = events.where("kind = 'map'").select("c", F.col("to").alias("now"))
        of = written(of.join(name, "c", "left").select("id", F.coalesce("now", "c").alias("c")), "condense-points")
        state = written(state.join(name, "c", "left_anti").unionByName(events.where("kind = 'state'").select(state.columns)), "condense-state")
    # what is left at density 0
    last = written(state.where("cluster IS NOT NULL"), "condense-last")
    alone = last.count() == 1
    ends = last.select("cluster", F.lit(None).cast("long").alias("parent"), "size", F.greatest("total", "kids").alias("worth"), (F.col("total") >= F.col("kids")).alias("own"), "top", F.lit(alone).alias("root"))
    return falls, written(clusters.unionByName(ends), "condense-clusters")


def selected(clusters: DataFrame) -> DataFrame:
    """cluster and chosen: of each cluster the highest above it, or itself, that is worth more than its descendants; null if there is none."""
    mine = F.when(F.col("own") & ~F.col("root"), F.col("cluster"))
    up = written(clusters.select("cluster", F.col("parent").alias("jump"), mine.alias("chosen")), "selected")
    while up.where("jump IS NOT NULL").limit(1).count():
        above = up.select(F.col("cluster").alias("jump"), F.col("jump").alias("next"), F.col("chosen").alias("higher"))
        up = written(up.join(above, "jump", "left").select("cluster", F.col("next").alias("jump"), F.coalesce("higher", "chosen").alias("chosen")), "selected")
    return up.select("cluster", "chosen")


def _numbered(firsts: DataFrame) -> DataFrame:
    """chosen and label, from 0 in the order of `first`, without a task that holds all rows."""
    parts = written(firsts.repartitionByRange("first").select("*", F.spark_partition_id().alias("part")), "labels")
    sizes = sorted((r.part, r.n) for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    nth = F.row_number().over(Window.partitionBy("part").orderBy("first"))
    known = parts.sparkSession.createDataFrame(starts, "part int, before long")
    return parts.withColumn("nth", nth).join(F.broadcast(known), "part").select("chosen", (F.col("before") + F.col("nth") - 1).alias("label"))


def density_clusters(rows: DataFrame, min_cluster_size: int = 5, min_samples: int = 1, k: int = 15, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, label and probability of each row with a usable vector: labels from 0 in the order of the clusters' smallest ids, -1 for noise.

    Ids are unique longs.  The graph has each row's max(k, min_samples) nearest
    neighbours; probes limits the lists of the index that are searched for
    them.  probability is the density at which a point leaves its cluster over
    the highest one of it, 0 for noise.  Rows without a vector, with a null or
    non-finite component or of another width than the first are left out; equal
    vectors are at distance SHORTEST.  An empty table gives no rows.
    """
    near = written(neighbours(rows, max(k, min_samples), probes, id_col, vector_col), "neighbours")
    found = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    points = written(ann._usable(found, "id", "v", True).select("id", F.size("v").alias("width")), "points")
    first = points.orderBy("id").first()
    points = points.where(F.col("width") == first.width) if first else points
    falls, clusters = condensed(points.select("id"), spanning_forest(written(reachability(near, min_samples), "reachability")), min_cluster_size)
    chosen = selected(clusters)
    tops = clusters.select(F.col("cluster").alias("chosen"), "top")
    member = written(falls.join(chosen.where("chosen IS NOT NULL"), "cluster").join(tops, "chosen").select("id", "chosen", F.least(F.lit(1.0), F.col("density") / F.col("top")).alias("probability")), "members")
    labels = _numbered(member.groupBy("chosen").agg(F.min("id").alias("first")))
    known = member.join(labels, "chosen").select("id", "label", "probability")
    out = points.select("id").join(known, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("label", F.lit(-1).cast("long")).alias("label"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
