"""Codes of vectors: each part of a vector becomes the number of its nearest codebook entry, found in an annulus of norms.

By the triangle inequality an entry nearer to x than d has a norm within d of
the norm of x.  Entries are sorted by norm; the one whose norm is nearest to
that of x gives the first d.  Then stretches of the sorted entries around it
are taken, twice as wide each time, but only as far as the interval of norms
that the best distance so far allows, both ends found by binary search and
included; what lies outside is never compared.  Distances are exact integers;
the norms' square roots are rounded outwards, so that rounding takes no entry
out of its annulus.

Tables are read once for the first entries, once a round and once for the
codes.  A task returns a row of sums for each entry, which are added up by a
shuffle; the driver holds the codebooks alone, whose size is the number of
entries times the width.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.scratch import materialize
from sparkloom.llm.topk import LONG, SCALE, usable

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components are held to this size, so that sums over a task fit a long.
LARGEST = 1 << 40
#: Sorted entries that the first stretch takes on both sides.
FIRST_STRETCH = 2
BLOCK_ROWS = 4096
#: Labels whose errors are broadcast; more are joined by a shuffle over salted keys.
BROADCAST_LABELS = 1_000_000
SALTS = 32


@dataclass
class Annuli:
    """Entries of one part, sorted by norm."""

    entries: np.ndarray

    def __post_init__(self) -> None:
        peak = int(np.abs(self.entries).max(initial=0))
        square = (self.entries.astype(object) ** 2).sum(axis=1)
        self.order = np.argsort(square.astype(float), kind="stable")
        self.sorted = self.entries[self.order]
        self.norms = np.sqrt(square[self.order].astype(float))
        self.peak = peak
        self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row its nearest entry (ties: the lower index) and the squared distance."""
        # sums of squares up to 2^62 are exact in int64; beyond that Python's integers are used
        small = x.shape[1] * (int(np.abs(x).max(initial=0)) + self.peak) ** 2 < 1 << 62
        kind = np.int64 if small else object
        x, entries = x.astype(kind), self.sorted.astype(kind)
        count = len(entries)
        norm = np.sqrt((x * x).sum(axis=1).astype(float))
        at = np.searchsorted(self.norms, norm)
        left = np.maximum(at - 1, 0)
        at = np.where((at == count) | (np.abs(self.norms[left] - norm) <= np.abs(self.norms[np.minimum(at, count - 1)] - norm)), left, np.minimum(at, count - 1))
        best, gap = self.order[at].copy(), ((x - entries[at]) ** 2).sum(axis=1)
        self.compared += len(x)
        lo, hi = at, at + 1  # sorted entries lo to hi - 1 have been compared
        rows, width = np.arange(len(x)), FIRST_STRETCH
        while len(rows):
            reach = np.sqrt(gap[rows].astype(float))
            slack = 1e-12 * (reach + norm[rows]) + 1e-9
            first = np.searchsorted(self.norms, norm[rows] - reach - slack, "left")
            last = np.searchsorted(self.norms, norm[rows] + reach + slack, "right")
            # the next stretch on each side, cut at the annulus
            new_lo = np.minimum(lo[rows], np.maximum(first, lo[rows] - width))
            new_hi = np.maximum(hi[rows], np.minimum(last, hi[rows] + width))
            for begin, end in ((new_lo, lo[rows]), (hi[rows], new_hi)):
                self._compare(x, entries, rows, begin, end, best, gap)
            lo[rows], hi[rows] = new_lo, new_hi
            rows = rows[(new_lo > first) | (new_hi < last)]
            width *= 2
        return best, gap

    def _compare(self, x: np.ndarray, entries: np.ndarray, rows: np.ndarray, begin: np.ndarray, end: np.ndarray, best: np.ndarray, gap: np.ndarray) -> None:
        """Compares rows with their sorted entries from begin to end - 1."""
        sizes = end - begin
        some = sizes > 0
        rows, begin, sizes = rows[some], begin[some], sizes[some]
        if not len(rows):
            return
        starts = np.cumsum(sizes) - sizes
        which = np.repeat(begin - starts, sizes) + np.arange(sizes.sum())
        far = ((np.repeat(x[rows], sizes, axis=0) - entries[which]) ** 2).sum(axis=1)
        self.compared += len(which)
        least = np.minimum.reduceat(far, starts)
        index = np.where(far == np.repeat(least, sizes), self.order[which], len(entries))
        index = np.minimum.reduceat(index, starts)
        better = (least < gap[rows]) | ((least == gap[rows]) & (index < best[rows]))
        best[rows[better]], gap[rows[better]] = index[better], least[better]


def components(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of one width as rows of integers floor(256 * x)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * SCALE), -float(LARGEST), float(LARGEST)).astype(np.int64).reshape(-1, width)


def _blocks(b: pa.RecordBatch, books: dict[int, np.ndarray], parts: int, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, row numbers and components of the batch's vectors, by width and in bounded blocks."""
    sizes = b.column(at).value_lengths().to_numpy(zero_copy_only=False)
    for width in map(int, np.unique(sizes)):
        if width not in books:
            continue
        rows = np.flatnonzero(sizes == width)
        for lo in range(0, len(rows), BLOCK_ROWS):
            some = rows[lo : lo + BLOCK_ROWS]
            yield width, some, components(b.column(at).take(pa.array(some)), width)


def _search(books: dict[int, np.ndarray]) -> dict[int, list[Annuli]]:
    """Of a width's entries (part, entry, position), the sorted entries of each part."""
    return {w: [Annuli(p) for p in book] for w, book in books.items()}


def _sums(sent, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        found = _search(books)
        total = {w: (np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64)) for w, book in books.items()}
        for b in batches:
            for width, _, x in _blocks(b, books, parts, 0):
                sums, counts = total[width]
                for p, (annuli, part) in enumerate(zip(found[width], np.split(x, parts, axis=1))):
                    index, _ = annuli.nearest(part)
                    np.add.at(sums[p], index, part)
                    counts[p] += np.bincount(index, minlength=len(annuli.entries))
        rows = [(w, p, e, int(counts[p, e]), sums[p, e].tolist()) for w, (sums, counts) in total.items() for p, e in zip(*np.nonzero(counts))]
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("width", "part", "entry", "n", "sums"), (int(w), int(p), int(e), n, s))) for w, p, e, n, s in rows], pa.schema([("width", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    return run


def _usable(vectors: DataFrame, vector_col: str, parts: int) -> Column:
    v = F.col(vector_col)
    return usable(v) & (F.size(v) > 0) & (F.size(v) % parts == 0)


def _rows(vectors: DataFrame, id_col: str, vector_col: str, parts: int, *more: Column) -> DataFrame:
    return vectors.where(_usable(vectors, vector_col, parts)).select(F.col(vector_col).cast("array<double>").alias("v"), F.col(id_col).cast("long").alias("vec_id"), *more)


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Codebooks by width: integers by part, entry and position within the part.

    Entries begin as the parts of the vectors with the smallest ids (nulls
    last, ties by vector; fewer vectors give fewer entries).  Each round
    assigns every part and puts the floor of the mean in the place of an entry
    that got any.  Vectors of a width that `parts` does not divide take no part.
    """
    spark = vectors.sparkSession
    rows = _rows(vectors, id_col, vector_col, parts)
    order = Window.partitionBy("width").orderBy(F.asc_nulls_last("vec_id"), "v")
    seeds = rows.withColumn("width", F.size("v")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= entries)
    books: dict[int, np.ndarray] = {}
    for r in seeds.groupBy("width").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("first")).collect():
        table = components(pa.array([s.v for s in r.first], pa.list_(pa.float64())), r.width)
        books[r.width] = table.reshape(len(table), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds if books else 0):
        sent = spark.sparkContext.broadcast(books)
        local = rows.select("v").mapInArrow(_sums(sent, parts), "width int, part int, entry int, n long, sums array<long>")
        at = local.select("width", "part", "entry", "n", F.posexplode("sums").alias("pos", "x"))
        means = at.groupBy("width", "part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        books = {w: b.copy() for w, b in books.items()}
        for r in means.collect():  # entries times width
            books[r.width][r.part, r.entry, r.pos] = int(r.x) // r.n
        sent.unpersist()
    return books


def digest_of(book: np.ndarray) -> str:
    """Lowercase hex SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def _codes(sent, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        found, names = _search(books), {w: digest_of(b) for w, b in books.items()}
        for b in batches:
            code = np.full(b.num_rows, None, object)
            error, book = np.zeros(b.num_rows, object), np.full(b.num_rows, None, object)
            for width, rows, x in _blocks(b, books, parts, 0):
                index = np.empty((len(rows), parts), np.int64)
                total = np.zeros(len(rows), object)
                for p, (annuli, part) in enumerate(zip(found[width], np.split(x, parts, axis=1))):
                    index[:, p], gap = annuli.nearest(part)
                    total = total + gap
                digits = 2 if len(found[width][0].entries) <= 256 else 4
                code[rows] = ["".join(f"{i:0{digits}x}" for i in row) for row in index.tolist()]
                error[rows], book[rows] = total, names[width]
            error = pa.array([min(LONG, int(e)) for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(code, pa.string()), error, pa.array(book, pa.string())], [*b.schema.names[1:], "code", "error", "codebooks_sha256"])

    return run


def encode(vectors: DataFrame, books: dict[int, np.ndarray], id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of every usable vector whose width has a codebook; errors beyond a long end at its limit."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    rows = _rows(vectors, id_col, vector_col, parts, F.col(label_col).alias("label")).where(F.size("v").isin(*books))
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(_codes(sent, parts), f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string")


def decode(codes: DataFrame, book: np.ndarray, code_col: str = "code") -> DataFrame:
    """The table with `vector`: the entries that its codes of one codebook stand for, divided by 256."""
    sent = codes.sparkSession.sparkContext.broadcast(book)

    @F.pandas_udf("array<double>")
    def vector(s):
        table, digits = sent.value, 2 if sent.value.shape[1] <= 256 else 4
        return s.map(lambda c: None if c is None else np.concatenate([table[p, int(c[digits * p : digits * (p + 1)], 16)] for p in range(len(table))]) / SCALE)

    return codes.withColumn("vector", vector(F.col(code_col)))


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: vectors as codes of codebooks fitted on all of them.

    Vectors null, empty, with a null or non-finite component, or of a width that
    the number of parts does not divide take no part; each other width has its
    own codebooks.  Rows that repeat count each; null ids come last among the
    first entries.  Components beyond 2^40 after scaling are held there.  Other
    columns are ignored.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    books = fit(vectors, id_col, vector_col)
    if not books:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codes = materialize(encode(vectors, books, id_col, vector_col, label_col), "codes")
    limit = F.lit(LONG).cast("decimal(38,0)")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), limit).cast("long")
    sums = materialize(codes.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    if sums.count() <= BROADCAST_LABELS:
        both = codes.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    else:
        salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        draw = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
        both = codes.join(salted, F.col("label").eqNullSafe(F.col("of")) & (draw == F.col("salt")))
    return both.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
