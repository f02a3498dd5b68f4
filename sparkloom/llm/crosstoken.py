"""Alignment of two tokenizers' tokens, as a relational plan.

Tokens are exploded with their positions; a window sums their byte lengths to
byte ends; an equi-join on unit and end finds the cuts, where a token of both
sides ends; the running count of cuts numbers the groups, each from one cut to
the next.  The two tokens that meet at a cut are linked.

The unit is the longest stretch that neither tokenizer joins across: a word
with the space before it (`wordwise`).  Both have a token ending at its last
byte, so groups never cross words, and equal words are aligned once whatever
their number in the corpus.  A first pass turns documents into numbers of a
dictionary of words for each block of documents; words are counted, tokenized
and aligned; pairs are counted over all of the corpus; dictionaries get what
was found by an equi-join on the word, and each block's documents are put
together from its own dictionary.  A block is bounded by its words, so no task
holds more; a single longer document is a block of its own.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import wordwise
from sparkloom.llm.packing import default_tokenizer
from sparkloom.llm.scratch import drop, materialize, spread
from sparkloom.llm.sentencepiece_fst import default_model

#: Words of a block's texts, and different ones among them.
BLOCK_WORDS, BLOCK_DISTINCT = 4_000_000, 600_000
#: Pairs that are broadcast with their counts; more are joined by a shuffle.
BROADCAST_PAIRS = 200_000
_WORDS = "block long, no int, word string, n long"
_UNITS = "unit long, word string, n long, valid boolean, a array<int>, a_bytes array<int>, b array<int>, b_bytes array<int>"


# --- tokens as a relation


@contextmanager
def _settings(spark: SparkSession):
    """Rows dealt by unit serve joins on unit and end too; shuffle files go when the table that they served is written."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def token_ends(units: DataFrame, unit: str, ids: str, sizes: str) -> DataFrame:
    """unit, pos, id, end: the tokens of each unit's arrays, from position 0, with the byte at which they end."""
    each = units.select(unit, F.posexplode(F.arrays_zip(F.col(ids).alias("id"), F.col(sizes).alias("size"))).alias("pos", "t"))
    so_far = Window.partitionBy(unit).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return each.select(unit, "pos", F.col("t.id").alias("id"), F.sum("t.size").over(so_far).alias("end"))


def align(a: DataFrame, b: DataFrame, unit: str = "unit") -> DataFrame:
    """unit, grp, a_from, a_to, b_from, b_to, a, b: for each cut the positions of the tokens since the cut before (both included) and the two linked ids.

    a and b are tables of `token_ends`.  grp is the running count of cuts.
    Tokens after the last cut of a unit, which there are only if the bytes of
    the two sides differ, are in no group.
    """
    theirs = b.select(F.col(unit).alias("_unit"), F.col("end").alias("_end"), F.col("pos").alias("b_to"), F.col("id").alias("b"))
    cuts = a.join(theirs, (F.col(unit) == F.col("_unit")) & (F.col("end") == F.col("_end")))
    by_end = Window.partitionBy(unit).orderBy("end")
    grp = (F.count(F.lit(1)).over(by_end.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("grp")
    since = lambda c: F.coalesce(F.lag(c).over(by_end) + 1, F.lit(0))
    return cuts.select(unit, grp, since("pos").alias("a_from"), F.col("pos").alias("a_to"), since("b_to").alias("b_from"), "b_to", F.col("id").alias("a"), "b")


# --- documents as words


def _dictionaries(splits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = wordwise.split if splits else lambda text: [text]
        block = TaskContext.get().partitionId() << 32
        numbers: dict[str, int] = defaultdict(count().__next__)  # a new word gets the next number
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            counts = np.zeros(len(numbers), np.int64)
            for _, nos in held:
                counts += np.bincount(nos, minlength=len(numbers))
            w, d = len(numbers), len(held)
            nos = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for _, x in held])], pa.int32()), pa.array(np.concatenate([x for _, x in held]), pa.int32()))
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(w + d, block)), pa.array([*range(w)] + [None] * d, pa.int32()), pa.array([*numbers] + [None] * d, pa.string()), pa.array([*counts.tolist()] + [None] * d, pa.int64()),
                pa.array([None] * w + [i for i, _ in held], pa.int64()), pa.concat_arrays([pa.nulls(w, pa.list_(pa.int32())), nos.cast(pa.list_(pa.int32()))])], ["block", "no", "word", "n", "doc_id", "nos"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                words = cut(text) if text else []
                held.append((doc, np.array([*map(numbers.__getitem__, words)], np.int32)))
                size += len(words)
                if size >= BLOCK_WORDS or len(numbers) >= BLOCK_DISTINCT:
                    yield out()
                    numbers, held, size, block = defaultdict(count().__next__), [], 0, block + 1
        if held:
            yield out()

    return run


def byte_tokens(raw: bytes) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer's file."""
    vocab, of = wordwise.byte_tokenizer(raw).get_vocab(with_added_tokens=True), wordwise.alphabet()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return out


def piece_tokens(raw: bytes) -> list[bytes]:
    """The bytes of each id of a piece model: U+2581 is a space, <0xHH> a byte."""
    model = wordwise.piece_model(raw)
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(wordwise.MARK, " ").encode() for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]]


def _tokenize(raw_a, raw_b, ranks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = wordwise.kept(wordwise.byte_words, raw_a.value, " ", True, ranks), wordwise.kept(wordwise.piece_words, raw_b.value)
        bytes_a, bytes_b = byte_tokens(raw_a.value).__getitem__, piece_tokens(raw_b.value).__getitem__
        unit = TaskContext.get().partitionId() << 40
        for batch in batches:
            words = batch.column(0).to_pylist()
            for lo, hi in wordwise.stretches(words):
                some = words[lo:hi]
                rows: list[list] = [[], [], [], [], []]
                for w, a, b in zip(some, first.encode(some), second.encode(some)):
                    raw = f" {w}".encode()
                    x, y = [*map(bytes_a, a)], [*map(bytes_b, b)]
                    same = b"".join(x) == raw == b"".join(y)
                    for column, value in zip(rows, (same, a, [*map(len, x)], b, [*map(len, y)])):
                        column.append(value if same or value is same else [])
                lists = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(unit, unit + hi - lo), pa.int64()), batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(rows[0]), *(pa.array(r, lists) for r in rows[1:])],
                    ["unit", "word", "n", "valid", "a", "a_bytes", "b", "b_bytes"],
                )
                unit += hi - lo

    return run


# --- the corpus


def _assemble(keys, docs: pa.Table, words: pa.Table) -> pa.Table:
    """A block's documents from its dictionary."""
    order = np.argsort(words.column("no").to_numpy())
    groups = np.array(words.column("groups").to_pylist() + [None], object)[:-1][order]
    half = (1 << 32) - 1
    ab, lb = (words.column(c).to_numpy()[order] for c in ("a_b", "links_best"))
    numbers = np.stack([ab >> 32, ab & half, lb >> 32, lb & half, words.column("count_sum").to_numpy()[order]]) if len(order) else np.zeros((5, 0), np.int64)
    wrong = np.array([g is None for g in groups], bool)
    out: list[list] = [[] for _ in range(8)]
    for doc, nos in zip(docs.column("doc_id").to_pylist(), docs.column("nos")):
        nos = nos.values.to_numpy()
        n_a = n_b = links = best = total = 0
        text = ""
        if len(nos) and not wrong[nos].any():
            n_a, n_b, links, best, total = (int(row[nos].sum()) for row in numbers)
            text = hashlib.sha256(";".join(groups[nos]).encode()).hexdigest()
        for column, value in zip(out, (doc, n_a, n_b, links, links, best, total, text)):
            column.append(value)
    return pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in out[:7]), pa.array(out[7], pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(units: DataFrame) -> DataFrame:
    """a, b, count, best: how often links over the corpus hold a pair of ids, and whether that is the most of its b. From units with n and links."""
    pairs = units.select("n", F.explode("links").alias("l")).groupBy(F.col("l.a").alias("a"), F.col("l.b").alias("b")).agg(F.sum("n").alias("count"))
    return pairs.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def _aligned_units(units: DataFrame) -> DataFrame:
    """word, n, n_a, n_b, groups (as text) and links of units that are dealt by unit."""
    found = align(token_ends(units, "unit", "a", "a_bytes"), token_ends(units, "unit", "b", "b_bytes"))
    each = found.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("grp", "a_from", "a_to", "b_from", "b_to", "a", "b"))).alias("g"))
    ids = lambda side, g: F.array_join(F.slice(side, g[f"{side}_from"] + 1, g[f"{side}_to"] - g[f"{side}_from"] + 1).cast("array<string>"), ",")
    said = F.transform("g", lambda g: F.concat(ids("a", g), F.lit("|"), ids("b", g)))
    links = F.transform("g", lambda g: F.struct(g.a.alias("a"), g.b.alias("b")))
    both = units.select("unit", "word", "n", "a", "b").join(each, "unit")
    return both.select("unit", "word", "n", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), F.array_join(said, ";").alias("groups"), links.alias("links"))


_NUMBERS = ("a_b", "links_best", "count_sum")


def _scored(rows: DataFrame) -> DataFrame:
    """word, groups and numbers of aligned units: n_a and n_b in one long, links and best links in another, and the sum of the links' counts."""
    counts = materialize(pair_counts(rows), "pair-counts")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts
    linked = rows.select("unit", F.explode("links").alias("l")).select("unit", F.col("l.a").alias("a"), F.col("l.b").alias("b"))
    held = linked.join(counts, ["a", "b"]).groupBy("unit").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    pair = lambda x, y: F.shiftleft(F.col(x).cast("long"), 32) + F.col(y).cast("long")
    return rows.withColumn("n_links", F.size("links")).join(held, "unit").select("word", "groups", pair("n_a", "n_b").alias("a_b"), pair("n_links", "n_best").alias("links_best"), "count_sum")


def aligned(docs: DataFrame, tokenizer: str | None = None, pieces: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document under two tokenizers.

    Texts null, empty, or of which a word's token bytes are not its own (as
    where a text holds the space mark of the piece model) have zeros and an
    empty digest.  Rows that repeat count each; null ids stay; other columns
    are ignored.  A long text without spaces is one unit.  An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    raw = []
    for path in (tokenizer or default_tokenizer(), pieces or default_model()):
        with open(path, "rb") as f:
            raw.append(f.read())
    ranks = wordwise.by_ranks(raw[0])
    sent = [spark.sparkContext.broadcast(r) for r in raw]
    splits = wordwise.byte_words(raw[0]).splits and wordwise.piece_words(raw[1]).splits
    read = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    cut = materialize(read.mapInArrow(_dictionaries(splits), f"{_WORDS}, doc_id long, nos array<int>"), "dictionaries")
    words = cut.where("word IS NOT NULL")
    with _settings(spark):
        vocabulary = words.groupBy("word").agg(F.sum("n").alias("n"))
        units = materialize(vocabulary.mapInArrow(_tokenize(*sent, ranks), _UNITS), "units")
        rows = materialize(_aligned_units(units.where("valid").repartition("unit")), "aligned-units")
        drop(units)
        known = materialize(_scored(rows), "scored-units")
        drop(rows)
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
        filled = words.select("block", "no", "word").join(known, "word", "left").select("block", "no", "groups", *map(zero, _NUMBERS))
        dictionary = materialize(filled, "filled")
        drop(known)
    texts = cut.where("word IS NULL").select("block", "doc_id", "nos")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("block").cogroup(dictionary.groupBy("block")).applyInArrow(_assemble, schema)
