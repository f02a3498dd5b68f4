"""Packing of tokenized documents into sequences, by sums of squares.

A sequence that is not full has a gap.  Of all gaps into which a piece fits,
and a new sequence, it goes where afterwards the sum over gaps of the squared
number of open sequences with that gap is smallest (ties: the smaller gap, a
new sequence last).  That keeps gaps of all sizes in stock, so that nearly all
sequences fill up to the last token, whatever the order of the pieces.

Pieces are dealt over shards of about SHARD_PIECES, and each task packs one in
an order drawn by a hash.  Full sequences stay.  The pieces of the others, a
few hundredths, are dealt anew over fewer shards, until one shard holds them
all; that one is packed in order of falling length.  So what is left open does
not grow with the number of shards.  A shard's rows are a few numbers each;
token ids are not moved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import wordwise
from sparkloom.llm.scratch import materialize, spread

MAX_TOKENS = 2048
#: Pieces of a shard; the memory of a packing task is in proportion.
SHARD_PIECES = 50_000
_IDS = np.dtype("<u4")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokenize(raw, ranks: bool, max_tokens: int, end_id: int, with_ids: bool):
    end = np.array([end_id], _IDS).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = wordwise.kept(wordwise.byte_words, raw.value, "", False, ranks)
        words = wordwise.kept(wordwise.byte_words, raw.value, " ", False, ranks)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in wordwise.stretches(texts):
                cuts = [words.cut(t) for t in texts[lo:hi]]
                first = heads.learn({c[0] for c in cuts})
                later = words.learn({w for c in cuts for w in c[1:]}).__getitem__
                out: list[tuple] = []
                kept: list[np.ndarray] = []
                for doc, c in zip(b.column(0).slice(lo, hi - lo).to_pylist(), cuts):
                    ids = first[c[0]] + b"".join(map(later, c[1:])) + end
                    n = len(ids) // 4
                    at, piece = 0, 0
                    while at < n:
                        stop = at + ((n - at - 1) % max_tokens + 1 if not at else max_tokens)
                        part = ids[4 * at : 4 * stop]
                        out.append((row, doc, piece, at, stop - at, zlib.crc32(part)))
                        if with_ids:
                            kept.append(np.frombuffer(part, _IDS).astype(np.int64))
                        row, piece, at = row + 1, piece + 1, stop
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(x, k) for x, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.list_(pa.int64()))] if with_ids else []), _NAMES + ["ids"] * with_ids)

    return run


_NAMES = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
_SCHEMA = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32 and, if asked for, ids: documents as token ids, in pieces of at most max_tokens.

    Each document is followed by end_id.  Only one that is longer than
    max_tokens is cut; its first piece takes what the others leave.  A null text
    is an empty one, with end_id alone; rows with equal or null ids are
    documents of their own; other columns are ignored.  The table is written;
    `row` tells its rows apart.
    """
    spark = docs.sparkSession
    with open(tokenizer or default_tokenizer(), "rb") as f:
        model = f.read()
    raw = spark.sparkContext.broadcast(model)
    read = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return materialize(read.mapInArrow(_tokenize(raw, wordwise.by_ranks(model), max_tokens, end_id, with_ids), _SCHEMA + ", ids array<long>" * with_ids), "pieces")


class Packer:
    """Open sequences by their gaps; `place` puts one piece after another."""

    def __init__(self, max_tokens: int):
        self.size = max_tokens
        self.open: list[list[int]] = [[] for _ in range(max_tokens)]
        self.count = np.zeros(max_tokens + 1, np.int64)
        self.fill: list[int] = []

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset of the next piece, of 1 to max_tokens tokens."""
        size, count = self.size, self.count
        # what the sum of squares changes by: the gap g loses a sequence, g - length gains one
        change = 2 * count[: size - length + 1] - 2 * count[length:] + 2
        change[:-1][count[length:-1] == 0] = np.iinfo(np.int64).max
        change[-1] = 2 * count[size - length] + 1  # a new sequence
        change[0] -= 2 * count[0] + 1  # full sequences don't count
        gap = length + int(np.argmin(change))
        if gap == size:
            k = len(self.fill)
            self.fill.append(0)
        else:
            k = self.open[gap].pop()
            count[gap] -= 1
        at = self.fill[k]
        self.fill[k] += length
        if gap > length:
            self.open[gap - length].append(k)
            count[gap - length] += 1
        return k, at


def _shard(max_tokens: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (level << 58) + (TaskContext.get().partitionId() << 32)
        packer, held, placed = Packer(max_tokens), [], []
        for b in batches:
            held.append(b)
            placed += [packer.place(n) for n in b.column(4).to_pylist()]
        at = 0
        for b in held:
            mine = np.array(placed[at : at + b.num_rows], np.int64).reshape(-1, 2)
            full = np.array([packer.fill[k] == max_tokens for k in mine[:, 0]], bool)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mine[:, 0] + base), pa.array(mine[:, 1]), pa.array(full)], [*_NAMES, "sequence_id", "offset", "whole"])
            at += b.num_rows

    return run


def pack(cut: DataFrame, max_tokens: int = MAX_TOKENS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The table of `pieces` with sequence_id and offset: each piece's place in a sequence of at most max_tokens.

    The pieces of a sequence follow each other without a gap, from 0.  Those as
    long as a sequence have one of their own.  Ids of sequences are any
    numbers.  Reruns over the same table agree.
    """
    placed_schema = f"{_SCHEMA}, sequence_id long, offset long"
    cut = cut.select(*_NAMES)
    out = [cut.where(F.col("length") == max_tokens).select("*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, level = cut.where(F.col("length") < max_tokens), 0
    drawn = F.xxhash64("row", F.lit(7))
    n = left.count()
    while n:
        shards = -(-n // shard_pieces)
        dealt = left.repartition(shards, F.xxhash64("row", F.lit(level))).sortWithinPartitions(drawn, "row")
        tried = materialize(dealt.mapInArrow(_shard(max_tokens, level), f"{placed_schema}, whole boolean"), "packed")
        out.append(tried.where("whole").drop("whole"))
        left, level = tried.where("NOT whole").select(*_NAMES), level + 1
        rest = left.count()
        if shards == 1 or rest > 0.8 * n:  # one shard holds them, or few sequences can fill up at all
            last = left.repartition(-(-rest // shard_pieces) or 1, F.xxhash64("row", F.lit(level))) if rest > shard_pieces else left.coalesce(1)
            ended = last.sortWithinPartitions(F.desc("length"), "row").mapInArrow(_shard(max_tokens, level), f"{placed_schema}, whole boolean")
            out.append(materialize(ended.drop("whole"), "packed-last"))
            break
        n = rest
    done = out[0]
    for part in out[1:]:
        done = done.unionByName(part)
    return done


def sequences(cut: DataFrame, max_tokens: int = MAX_TOKENS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """sequence_id, ids and starts (offsets at which a document or piece begins): the packed sequences of a table of `pieces` with ids."""
    placed = pack(cut, max_tokens, shard_pieces).select("row", "sequence_id", "offset")
    parts = placed.join(cut.select("row", "ids"), "row").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.offset").alias("starts"))


def packed(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece: see `pieces` and `pack`. An empty table gives no rows."""
    return pack(pieces(docs, tokenizer, max_tokens, id_col=id_col, text_col=text_col), max_tokens).drop("row")
