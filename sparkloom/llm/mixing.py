"""Mix sources to target weights by packing words into blocks.

Each source's documents are laid end to end and cut into blocks of a fixed
number of words.  An output of as many words as the input is a row of slots,
one block each, cut into shards.  Every shard draws how many of its slots each
source gets from a multinomial whose weights are the targets; a source whose
budget of slots is used up leaves its surplus draws to those with a deficit,
so that the totals meet the targets: what these lack is dealt to the last
shards in a pseudorandom order, so that they are mixes as well.  The k-th slot of a source takes block
`permutation_pass(k mod n)` with pass = k div n: each pass uses every block of
the source once, in a pseudorandom order of its own (a keyed Feistel network),
so no block is used more often than the passes begun, three at most.  Slots
and blocks meet in an equi-join on (source, block index).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.scratch import fresh, materialize, row_hash

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK_WORDS = 128
#: Blocks that a source has at least, if it has as many words: small sources get shorter blocks.
MIN_BLOCKS = 256
SHARD_SLOTS = 1024
#: Sources up to which their table is broadcast, some 10 MB. The driver and the tasks that draw hold a hundred bytes for each source, however many there are.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Source:
    """One source of a mix. name is None for documents without a source."""

    index: int
    name: str | None
    size: int
    target: float
    block_words: int
    blocks: int
    slots: int


def targets(sizes: list[int], weights: list[int], max_repeat: int = MAX_REPEAT) -> list[float]:
    """Shares of the sum of sizes by weight; none above max_repeat times its size, what is cut off is shared again by weight."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(max_repeat * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        share = [float(max_repeat * s) if i in capped else left * w / weight for i, (s, w) in enumerate(zip(sizes, weights))]
        over = {i for i, s in enumerate(sizes) if i not in capped and share[i] > max_repeat * s}
        if not over:
            return share
        capped |= over


def plan_sources(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, block_words: int = BLOCK_WORDS) -> list[Source]:
    """The sources by code point, null last, with targets, blocks and slots."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    cycle = [weights[i % len(weights)] for i in range(len(ordered))]
    wanted = targets([n for _, n in ordered], cycle, max_repeat)
    out = []
    for i, ((name, n), t) in enumerate(zip(ordered, wanted)):
        words = max(1, min(block_words, n // MIN_BLOCKS))
        blocks = -(-n // words)
        out.append(Source(i, name, n, t, words, blocks, min(max_repeat * blocks, round(t * blocks / n)) if n else 0))
    return out


def permute(source: np.ndarray, turn: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Image of at under the pseudorandom permutation of 0..n-1 that belongs to (source, turn); all arrays of one length."""
    half = np.array([max(1, (int(x - 1).bit_length() + 1) // 2) for x in np.unique(n)], dtype=np.uint64)[np.searchsorted(np.unique(n), n)]
    mask = (np.uint64(1) << half) - np.uint64(1)
    key = source.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ turn.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    out, todo = at.astype(np.uint64), np.ones(len(at), bool)
    while todo.any():  # walk the cycle until the image is below n
        x, k, m, h = out[todo], key[todo], mask[todo], half[todo]
        left, right = x >> h, x & m
        for r in range(4):
            z = (right + k + np.uint64(r * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & m)
        out[todo] = left << h | right
        todo = out >= n.astype(np.uint64)
    return out.astype(np.int64)


def _offsets(rows: DataFrame, key: str, bucket: str, order: list[str], size: str) -> DataFrame:
    """Adds `start`: the sum of size over the earlier rows of the key, in two levels so that no task holds a whole key."""
    sums = rows.groupBy(key, bucket).agg(F.sum(size).alias("__n"))
    before = sums.select(key, bucket, (F.sum("__n").over(Window.partitionBy(key).orderBy(bucket)) - F.col("__n")).alias("__before"))
    within = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(before, [key, bucket]).withColumn("start", F.col("__before") + F.sum(size).over(within) - F.col(size)).drop("__before")


def _draws(plan: list[Source], shards: int, seed: int):
    p = np.array([s.slots for s in plan], dtype=float)
    p /= p.sum()
    total = sum(s.slots for s in plan)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard in f["id"]:
                n = min(SHARD_SLOTS, total - int(shard) * SHARD_SLOTS)
                drawn = np.random.Generator(np.random.Philox(key=[seed, int(shard)])).multinomial(n, p)
                at = np.flatnonzero(drawn)
                yield pd.DataFrame({"shard": np.full(len(at), shard, np.int64), "s": at.astype(np.int32), "n": drawn[at].astype(np.int64)})

    return run


def _place(plan: list[Source], shards: int, lacking: int, seed: int):
    """Blocks of slots, and shards of those that are dealt after all draws: the rank-th of them goes where a permutation takes it."""
    blocks = np.array([s.blocks for s in plan], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, k, rank, shard = (b.column(c).to_numpy() for c in ("s", "k", "rank", "shard"))
            n = blocks[s]
            block = permute(s, k // n, k % n, n) if len(s) else k
            late = np.flatnonzero(rank >= 0)
            if len(late):
                same = np.full(len(late), 1)
                shard = shard.copy()
                shard[late] = shards + permute(same * len(blocks), same * seed, rank[late], same * lacking) // SHARD_SLOTS
            yield pa.RecordBatch.from_arrays([pa.array(shard), b.column("s"), b.column("k"), pa.array(block)], ["shard", "s", "k", "block"])

    return run


def _slots(spark, plan: list[Source], seed: int) -> DataFrame:
    """(shard, s, k, block): slot k of source s is in the shard and takes the block."""
    total = sum(s.slots for s in plan)
    shards = -(-total // SHARD_SLOTS)
    limit = spark.createDataFrame([(s.index, s.slots) for s in plan], "s int, slots long")
    tasks = max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))
    drawn = materialize(spark.range(0, shards, 1, tasks).mapInPandas(_draws(plan, shards, seed), "shard long, s int, n long"), "mix-draws")
    placed = _offsets(drawn.withColumn("bucket", F.floor(F.col("shard") / 4096)), "s", "bucket", ["shard"], "n")
    # a source's draws beyond its slots lapse; what others lack is ranked over all of them, one source after the other
    used = placed.join(limit, "s").select("shard", "s", F.col("start").alias("lo"), F.least(F.col("start") + F.col("n"), "slots").alias("hi"), F.lit(None).cast("long").alias("ahead")).where("lo < hi")
    got = {r["s"]: r["got"] for r in drawn.groupBy("s").agg(F.sum("n").alias("got")).collect()}  # a row for each source
    more, lacking = [], 0
    for source in plan:
        lo = min(got.get(source.index, 0), source.slots)
        for at in range(lo, source.slots, SHARD_SLOTS):
            more.append((0, source.index, at, min(source.slots, at + SHARD_SLOTS), lacking + at - lo))
        lacking += source.slots - lo
    rows = used.unionByName(spark.createDataFrame(more, "shard long, s int, lo long, hi long, ahead long"))
    rank = F.coalesce(F.col("ahead") + F.col("k") - F.col("lo"), F.lit(-1))
    rows = rows.select("*", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("k")).select("shard", "s", "k", rank.alias("rank"))
    return rows.mapInArrow(_place(plan, shards, max(lacking, 1), seed), "shard long, s int, k long, block long")


@dataclass
class Mix:
    """docs: (doc_id, text_hash, copy, s, size, start); pieces: (doc_id, text_hash, copy, s, size, start, block, lo, hi); plan; slots."""

    docs: DataFrame
    pieces: DataFrame | None
    plan: list[Source]
    slots: DataFrame | None


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, block_words: int = BLOCK_WORDS, seed: int = 17) -> Mix:
    """Plan the mix of all documents; see `taken` and `mixed_text` for its results."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text, F.col(source_col)).alias("text_hash"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    # equal rows are numbered, so that each has a place of its own
    counted = rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("n"))
    base = materialize(counted.select("doc_id", "source", "text_hash", "size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")), "mix-sizes")
    totals = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row for each source
    plan = plan_sources([(r["source"], r["size"]) for r in totals], weights, max_repeat, block_words)
    table = spark.createDataFrame([(s.index, s.name, s.block_words) for s in plan], "s int, source string, block_words int")
    rows = sum(r["n"] for r in totals)
    buckets = max(1, rows // max(1000, math.isqrt(rows)))  # as many rows in a bucket as a source has buckets, at scale
    keyed = base.join(table, base.source.eqNullSafe(table.source)).select("doc_id", "text_hash", "copy", "s", "size", "block_words", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)).alias("bucket"))
    if not sum(s.slots for s in plan):
        return Mix(keyed.withColumn("start", F.lit(0).cast("long")), None, plan, None)
    placed = materialize(_offsets(keyed, "s", "bucket", ["doc_id", "text_hash", "copy"], "size"), "mix-places")
    first, last = F.floor(F.col("start") / F.col("block_words")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block_words"))
    cut = placed.where("size > 0").select("*", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("block") * F.col("block_words") - F.col("start"), F.lit(0))
    hi = F.least((F.col("block") + 1) * F.col("block_words") - F.col("start"), F.col("size"))
    return Mix(placed, cut.select("*", lo.alias("lo"), hi.alias("hi")), plan, _slots(spark, plan, seed))


def _uses(m: Mix) -> DataFrame:
    times = m.slots.groupBy("s", "block").agg(F.count("*").alias("uses"))
    return m.pieces.join(times, ["s", "block"]).select("doc_id", "text_hash", "copy", "s", "start", "size", "lo", "hi", "uses")


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    size counts words (null and empty texts: 0, nothing taken); a null source is
    a source of its own, the last; repeated rows each have their own row and
    place; a null doc_id stays null; an empty table gives no rows; other
    columns are ignored.  Reruns give the same rows.
    """
    m = mix(docs, **options)
    spark = docs.sparkSession
    about = spark.createDataFrame([(s.index, s.size, s.target) for s in m.plan], "s int, source_size long, target double")
    if m.slots is None:
        counted = m.docs.withColumn("taken", F.lit(0).cast("long"))
    else:
        got = _uses(m).groupBy("s", "start").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("uses")).cast("long").alias("taken"))
        some, none = m.docs.where("size > 0"), m.docs.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        counted = some.join(got, ["s", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0))).select("doc_id", "s", "size", "taken").unionByName(none.select("doc_id", "s", "size", "taken"))
    about = F.broadcast(about) if len(m.plan) <= BROADCAST_SOURCES else about
    return counted.join(about, "s").select("doc_id", "size", "source_size", "target", "taken")


def _spans(parts: list[dict], size: int) -> list[list[tuple[int, int]]]:
    """For each round of use the runs of words that it takes."""
    out = []
    for turn in range(1, max(p["uses"] for p in parts) + 1):
        runs: list[tuple[int, int]] = []
        for p in sorted((p for p in parts if p["uses"] >= turn), key=lambda p: p["lo"]):
            if runs and runs[-1][1] == p["lo"]:
                runs[-1] = (runs[-1][0], p["hi"])
            else:
                runs.append((p["lo"], p["hi"]))
        out.append(runs)
    return out


def _texts(columns: list[str], text_col: str):
    """Rows (the columns, then a document's size and parts) as the texts that its parts make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for b in batches:
            at, texts = [], []
            sizes, every = b.column(len(columns)), b.column(len(columns) + 1)
            for i, (text, parts) in enumerate(zip(b.column(columns.index(text_col)), every)):
                text, parts = text.as_py() or "", parts.as_py()
                starts = None
                for runs in _spans(parts, len(text)):
                    whole = len(runs) == 1 and runs[0][0] == 0
                    if whole and runs[0][1] == sizes[i].as_py():
                        texts.append(text)
                    else:
                        if starts is None:
                            starts = [m.start() for m in word.finditer(text)] + [len(text)]
                        texts.append(" ".join(text[starts[lo] if lo else 0 : starts[hi]].rstrip(" \t\n\x0b\x0c\r") if hi < len(starts) - 1 else text[starts[lo] if lo else 0 :] for lo, hi in runs))
                    at.append(i)
            rows = pa.Table.from_batches([b]).select(columns).take(pa.array(at, pa.int64()))
            rows = rows.set_column(columns.index(text_col), text_col, pa.array(texts, pa.string()))
            yield from rows.combine_chunks().to_batches()

    return run


def mixed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents, with all columns of docs, whatever their names.

    A document that the mix takes c times gives c rows; one of which some blocks
    are taken keeps the words of those, in order; one of which none is taken
    goes.  Null and empty texts and those without a word are never taken; null
    ids and sources are as any other; of rows that repeat each has a place of
    its own (told apart by their other columns, so reruns agree); an empty table
    gives no rows.  Texts are shuffled once.
    """
    m = mix(docs, id_col, text_col, source_col, **options)
    if m.slots is None:
        return docs.limit(0)
    key, nth, items = (fresh(docs, n) for n in ("key", "nth", "items"))
    same = lambda doc_id, text_hash: F.xxhash64(doc_id.isNull(), doc_id, text_hash)
    parts = _uses(m).groupBy("doc_id", "text_hash", "copy", "size").agg(F.collect_list(F.struct("lo", "hi", "uses")).alias("parts"))
    wanted = parts.groupBy(same(F.col("doc_id"), F.col("text_hash")).alias(key)).agg(F.collect_list(F.struct("copy", "size", "parts")).alias(items))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumn(key, same(F.col(id_col), F.xxhash64(text, F.col(source_col))))
    numbered = keyed.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(row_hash(docs))))
    met = numbered.join(wanted, key)
    own = F.get(F.filter(items, lambda x: x["copy"] == F.col(nth)), F.lit(0))
    taken_ = met.select(*(F.col(f"`{c}`") for c in docs.columns), own["size"].alias(key), own["parts"].alias(items)).where(F.col(items).isNotNull())
    return taken_.mapInArrow(_texts(docs.columns, text_col), docs.schema)
