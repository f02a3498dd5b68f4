"""SimHash near-duplicate groups by a segment-popcount grid join.

Fingerprints within `max_bits` = 2 differing bits are linked; groups are the
connected components of the links.  A fingerprint is mapped to the popcounts
of its sixteen 4-bit segments.  Flipping one bit moves one count by one, so
the Manhattan distance of two count vectors is a lower bound of the Hamming
distance, and two vectors at Manhattan distance 2 or less share a lattice
point within distance 1 of both.  Each distinct fingerprint is therefore put
in its own grid cell and the 32 cells next to it; fingerprints that meet in a
cell are candidates and their Hamming distance is verified exactly.

Exact copies collapse before the join (one row per distinct fingerprint).
A cell with more than `dense` fingerprints is not paired up: its members are
linked through shared one-bit neighbours instead (two fingerprints differ in
at most 2 bits exactly if some value is within 1 bit of both), 65 rows for
each, which gives the same components.  No pair is lost and none is capped.

`deduplicate`, the pipeline's stage, keeps one of each group of similar texts.
It joins fingerprints in the same grid and compares the shingle sets of those
linked exactly.  Edited copies with a Jaccard similarity of 0.8 differ in more
bits than a grid can join; bands of minima add these as candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import connected_components
from sparkloom.llm.scratch import drop, fresh, materialize, row_hash

MASK64 = (1 << 64) - 1
CHUNK = 1 << 15
DENSE = 48
#: Bands of minima of near_copies: two sets of Jaccard similarity 0.8 share none of them with probability (1 - 0.8**ROWS)**BANDS, 5e-8.
BANDS, ROWS = 32, 4
#: Keys of rows wanted from a table that are broadcast; more are joined by a shuffle.
FEW = 1_000_000
_DRAWN = np.random.Generator(np.random.Philox(11)).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
_FACTORS, _SHIFTS, _MIX = _DRAWN[0] | np.uint64(1), _DRAWN[1], np.uint64(0x9E3779B97F4A7C15)


def simhash(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of UTF-8 text; 0 if it holds no word."""
    found = text.lower().split()
    if not found:
        return 0
    shingles = zip(*(found[i:] for i in range(words))) if len(found) >= words else [found]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return _majority(np.array([digest(join(s), seed) for s in shingles], dtype=np.uint64))


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fps = [_signed(simhash(t.as_py() or b"", words)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


def _cell(fp: Column) -> Column:
    """Sixteen 4-bit popcounts in one long, each one more than the count, so that steps down don't borrow."""

    def counts(half: Column) -> Column:  # of the eight nibbles of 32 bits; never overflows a long
        pairs = half.bitwiseAND(F.lit(0x55555555)) + F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))
        return pairs.bitwiseAND(F.lit(0x33333333)) + F.shiftright(pairs, 2).bitwiseAND(F.lit(0x33333333))

    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    return F.shiftleft(counts(high), 32).bitwiseOR(counts(low)) + F.lit(0x1111111111111111)


def _links_of(cell: np.ndarray, fp: np.ndarray, dense: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Verified links (a, b) inside runs of equal cells of at most `dense` rows; members of longer runs."""
    if not len(cell):
        return [], []
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    length = np.diff(np.r_[starts, len(cell)])
    small = np.repeat(length <= dense, length)
    crowded = fp[~small]
    cell, fp = cell[small], fp[small]
    links = []
    for k in range(1, min(dense, len(cell))):
        at = np.flatnonzero(cell[k:] == cell[:-k])
        if not len(at):
            break
        a, b = fp[at], fp[at + k]
        near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= 2
        links.append(np.stack([a[near], b[near]], axis=1))
    return links, [crowded] if len(crowded) else []


def _cell_links(dense: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def out(links: list[np.ndarray], crowded: list[np.ndarray]) -> pa.RecordBatch:
            ab = np.unique(np.concatenate(links), axis=0) if links else np.empty((0, 2), np.int64)
            alone = np.unique(np.concatenate(crowded)) if crowded else np.empty(0, np.int64)
            a = pa.array(np.r_[ab[:, 0], alone])
            b = pa.array(np.r_[ab[:, 1], alone], mask=np.r_[np.zeros(len(ab), bool), np.ones(len(alone), bool)])
            return pa.RecordBatch.from_arrays([a, b], schema=schema)

        held, held_fp, flushed = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False)
            crowded = []
            if flushed is not None:  # the cell that the last batch found crowded goes on
                same = cell == flushed
                crowded.append(fp[same])
                flushed = None if not same.all() else flushed
                cell, fp = cell[~same], fp[~same]
            cell, fp = np.r_[held, cell], np.r_[held_fp, fp]
            cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            held, held_fp = cell[cut:], fp[cut:]
            links, more = _links_of(cell[:cut], fp[:cut], dense)
            if len(held) > dense:
                crowded.append(held_fp)
                flushed, held, held_fp = held[0], held[:0], held_fp[:0]
            yield out(links, crowded + more)
        yield out(*_links_of(held, held_fp, dense))

    return run


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct `fp` at 2 or fewer differing bits."""
    cell = _cell(F.col("fp"))
    steps = F.array(*(F.lit(s << 4 * i) for i in range(16) for s in (1, -1)), F.lit(0))
    placed = distinct.select("fp", cell.alias("at")).select(F.explode(F.transform(steps, lambda d: F.col("at") + d)).alias("cell"), "fp")
    found = materialize(placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links(dense), "a long, b long"), "simhash-links")
    verified = found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    flips = F.array(*(F.lit(_signed(1 << i)) for i in range(64)), F.lit(0))
    crowded = found.where("b is null").select("a").distinct()
    shared = crowded.select(F.explode(F.transform(flips, lambda m: F.col("a").bitwiseXOR(m))).alias("mid"), "a")
    centre = shared.groupBy("mid").agg(F.min("a").alias("c"))
    stars = shared.join(centre, "mid").where("a <> c").select(F.col("c").alias("a"), F.col("a").alias("b"))
    return verified.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, dense: int = DENSE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach, its own included.
    Null and empty texts have fingerprint 0 and link like any other; rows that
    repeat stay; a null doc_id keeps its row and never names a component unless
    it is the only one there (component_id is then null); an empty table gives
    no rows; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected_components(links(distinct, dense))  # (node, root) for linked fingerprints
    grouped = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = materialize(grouped, "simhash-roots")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    drop(distinct)
    return prints.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingles(text: bytes, words: int) -> set[bytes]:
    found = text.lower().split()
    if len(found) < words:
        return {b" ".join(found)} if found else set()
    return set(map(b" ".join, zip(*(found[i:] for i in range(words)))))


def _hashes(text: bytes, words: int) -> np.ndarray:
    """The hashes of the set of shingles, in order."""
    found = _shingles(text, words)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in found), np.uint64, len(found)))


def _bands(hashes: np.ndarray) -> np.ndarray:
    """Keys of the bands of a set of shingle hashes: each mixes ROWS minima, every one under a hash order of its own."""
    low = np.full(BANDS * ROWS, MASK64, np.uint64)
    for i in range(0, len(hashes), 1024):
        low = np.minimum(low, (hashes[i : i + 1024, None] * _FACTORS + _SHIFTS).min(axis=0))
    low = (low ^ low >> np.uint64(29)) * _FACTORS[::-1]  # factors differ, so places and bands are told apart
    key = low.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) * _MIX
    return (key ^ key >> np.uint64(31)).view(np.int64)


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(doc_id, row, rest, print, n, fp, bands): row is a hash of the text, rest one of all columns, print one of the text's set of n shingles, fp the set's fingerprint; bands is empty where there is no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            prints, sizes, fps, bands = [], [], [], []
            for t in b.column(1).cast(pa.large_binary()):
                hashes = _hashes(t.as_py() or b"", words)
                prints.append(_signed(digest(hashes.tobytes())))
                sizes.append(len(hashes))
                fps.append(_signed(_majority(hashes)))
                bands.append(_bands(hashes) if len(hashes) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "row", "rest", "print", "n", "fp", "bands"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long"), text.alias("text"), F.xxhash64(text).alias("row"), row_hash(docs).alias("rest")).mapInArrow(run, "doc_id long, row long, rest long, print long, n long, fp long, bands array<long>")


def _overlap(own: str, other: str, n: str, m: str, similarity: float) -> Column:
    """Sets of n and m shingles that have no more in common than the lesser of two counts can have that Jaccard similarity."""
    share = Fraction(str(similarity))
    return F.least(own, other) * (share.numerator + share.denominator) >= (F.col(n) + F.col(m)) * share.numerator


def _fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of prints with whose components those of all fingerprints at 2 or fewer differing bits agree."""
    heads = materialize(distinct.where("n > 0").groupBy("fp").agg(F.min("print").alias("head")), "copies-heads")
    head = lambda fp, name: heads.select(F.col("fp").alias(fp), F.col("head").alias(name))
    near = links(heads.select("fp")).join(head("a", "x"), "a").join(head("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = distinct.where("n > 0").join(heads, "fp").where("print <> head").select(F.col("head").alias("a"), F.col("print").alias("b"))
    return near.unionByName(same)


def _rare_shingles(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(print, n, s, rare): s of a text's n shingles are in other texts too; rare are those of them that come first, by the number of texts, then by hash.

    Two sets of that similarity share more than what is left of either behind
    `rare`, so they share one of these.  Texts whose s is too small for any
    partner are left out.
    """
    share = Fraction(str(similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(prints: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(x) for x in found], np.int64)
            columns = np.repeat(np.array(prints, np.int64), sizes), np.repeat(sizes, sizes), np.concatenate(found).view(np.int64)
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["print", "n", "h"])

        for batch in batches:
            prints, found, held = [], [], 0
            for p, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                prints.append(p)
                found.append(_hashes(text.as_py(), words))
                held += len(found[-1])
                if held >= CHUNK:
                    yield out(prints, found)
                    prints, found, held = [], [], 0
            if found:
                yield out(prints, found)

    grams = materialize(texts.select("print", "text").mapInArrow(run, "print long, n long, h long").repartition("h"), "copies-grams")
    common = grams.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    met = grams.join(common, "h").groupBy("print").agg(F.max("n").alias("n"), F.count("*").alias("s"), F.sort_array(F.collect_list(F.struct("c", "h"))).alias("rare"))
    least = F.ceil(F.col("n") * share.numerator / share.denominator).cast("int")
    out = materialize(met.where(F.col("s") >= least).select("print", "n", "s", F.slice("rare", F.lit(1), F.col("s").cast("int") + 1 - least).alias("rare")), "copies-rare")
    drop(grams)
    return out


def _similar(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of prints whose sets of shingles have at least that Jaccard similarity, counted exactly."""
    share = Fraction(str(similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, last, y = [], None, set()
            for b, x, text in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), batch.column(3).cast(pa.large_binary())):
                if b != last:  # rows come sorted by b, mostly
                    last, y = b, _shingles(text.as_py(), words)
                x = _shingles(x.as_py(), words)
                both = len(x & y)
                near.append(both * share.denominator >= share.numerator * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.select(["a", "b"]).filter(pa.array(near, pa.bool_())).columns, ["a", "b"])

    side = lambda n: texts.select(F.col("print").alias(n), F.col("text").alias(f"text_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, row (a hash of the text), rest (one of all columns), root; documents of one component have the same root.

    Components are those of the pairs of sets of `words`-word shingles of at
    least that Jaccard similarity.  Equal sets collapse to one print.  Candidates
    are prints whose fingerprints meet in the grid at 2 bits, and each print of a
    band with the one that shares most of its shingles with other texts; their
    sets are compared exactly.  Then prints of different components are candidates
    if they share a shingle before either has too few left for that similarity,
    the rarest first: sets that differ in what no other text holds never meet.
    No band or shingle is capped.  Null and empty texts
    are one group; rows that repeat stay; an empty table gives no rows.
    """
    sets = materialize(shingle_sets(docs, id_col, text_col, words), "copies-sets")
    distinct = materialize(sets.groupBy("print").agg(F.min("row").alias("row"), F.max("n").alias("n"), F.max("fp").alias("fp"), F.max("bands").alias("bands")), "copies-distinct")
    prints = materialize(_fingerprint_pairs(distinct), "copies-prints")
    placed = distinct.select(F.explode("bands").alias("band"), "print").repartition("band")  # dealt out once, for the sum and for the join
    shared = placed.groupBy("band").agg(F.min("print").alias("a"), F.max("print").alias("z")).where("a <> z").select("band")
    crowd = materialize(placed.join(shared, "band"), "copies-bands")  # bands of two prints or more
    met = crowd.select("print").unionByName(prints.select(F.col("a").alias("print"))).unionByName(prints.select(F.col("b").alias("print"))).distinct()
    wanted = materialize(met.join(distinct, "print").select("print", "row"), "copies-wanted")
    text = F.col(text_col).cast("string")
    read = docs.select(F.xxhash64(text).alias("row"), text.alias("text"))
    texts = read.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, "row").dropDuplicates(["print"])
    texts = materialize(texts.select("print", "text"), "copies-texts")
    rare = _rare_shingles(texts, words, similarity)
    open_ = materialize(crowd.join(rare.select("print", "n", "s"), "print"), "copies-open")
    centre = open_.groupBy("band").agg(F.max(F.struct((F.col("s") / F.col("n")).alias("share"), "print", "n", "s")).alias("c")).select("band", F.col("c.print").alias("a"), F.col("c.n").alias("n_a"), F.col("c.s").alias("s_a"))
    stars = open_.join(centre, "band").where("a <> print").where(_overlap("s", "s_a", "n", "n_a", similarity)).select("a", F.col("print").alias("b"))
    tried = materialize(stars.unionByName(prints).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "copies-stars")
    linked = materialize(_similar(tried, texts, words, similarity), "copies-links")
    by_root = lambda roots: F.coalesce(roots["root"], F.col("print"))
    roots = connected_components(linked)
    first = rare.join(roots, rare["print"] == roots["node"], "left").select("print", "n", "s", by_root(roots).alias("root"), F.posexplode("rare").alias("at", "x"))
    member = materialize(first.select("x.h", "print", "n", (F.col("s") - F.col("at")).alias("left"), "root"), "copies-members")
    mixed = member.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("h")
    mine = member.join(mixed, "h", "left_semi")
    other = mine.select("h", F.col("print").alias("b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"), F.col("root").alias("root_b"))
    pairs = mine.join(other, "h").where("root < root_b").where(_overlap("left", "left_b", "n", "n_b", similarity)).select(F.least("print", "b").alias("a"), F.greatest("print", "b").alias("b")).distinct()
    rest = materialize(_similar(pairs.join(tried, ["a", "b"], "left_anti"), texts, words, similarity), "copies-links")
    known = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
    roots = materialize(connected_components(known.unionByName(rest)), "copies-roots")
    for done in (distinct, prints, crowd, wanted, texts, rare, open_, tried, member):
        drop(done)
    return sets.join(roots, sets["print"] == roots["node"], "left").select("doc_id", "row", "rest", by_root(roots).alias("root"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without near copies, with all their columns, whatever their names.

    Of each component of `near_copies` the row with the smallest doc_id stays;
    ties go by hashes of the text and of all columns, so reruns agree, and of
    rows that are equal in every column one stays.  Rows that share a doc_id but
    are no near copies all stay.  Null and empty texts are one component; a
    component whose doc_ids are all null keeps one row; an empty table stays
    empty.
    """
    own, kept = fresh(docs, "own"), fresh(docs, "kept")
    key = lambda doc_id, row, rest: F.xxhash64(doc_id.isNull(), doc_id, row, rest)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row", "rest")
    keep = near_copies(docs, id_col, text_col, words, similarity).groupBy("root").agg(F.min(order).alias("m")).select(key(F.col("m.doc_id"), F.col("m.row"), F.col("m.rest")).alias(kept))
    mine = key(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")), row_hash(docs))
    return docs.withColumn(own, mine).join(keep, F.col(own) == F.col(kept), "left_semi").dropDuplicates([own]).drop(own)
