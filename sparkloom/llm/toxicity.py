"""Toxicity by class-conditional Kneser-Ney models of words, symbol by symbol.

A text's words (parts between white space, lower case, without marks at their
ends) are spelled between boundaries.  An event is a symbol, or the word's end,
after the ORDER - 1 symbols before it.  A shared interpolated Kneser-Ney model
is estimated over both classes, its lower orders from continuation counts.
Each class discounts its own counts of events and gives the discounted mass to
the shared model:

    p_c(s | h) = max(n_c(hs) - D, 0) / n_c(h) + (sum over t of min(n_c(ht), D)) / n_c(h) * p(s | h)

so an expression that a class has hardly seen is scored by the shared backoff
counts and weighs neither way.  P_c(w) is the product over a word's symbols.
An ordinary text draws its words from P_0, a toxic one a share SHARE of them
from P_1 and the others from P_0 too; the text's evidence is the log-likelihood
ratio of the two, divided by its number of words:

    mean over words of log(1 - SHARE + SHARE * P_1(w) / P_0(w)).

A logistic curve over its logarithm, fitted on labelled rows that the models
have not seen, turns the evidence into a score.

Counts are gathered over all labelled training rows and kept as a table that
grows with them; events that neither class has seen more often than D have the
ratio of anything unseen after their context and need no row.  Nothing of the
models comes to the driver but sums for the discounts, and the events' ratios
while they are few: then (BROADCAST_EVENTS) they are broadcast and each text is
scored where it is read.  Beyond, texts are packed in blocks as counts of
words; the words of all blocks meet the events in joins, and each block gets
back a ratio for each of its words.  Both ways give the same evidence.  Only
the curve is fitted on a bounded sample (about `calibration_rows` rows, chosen
by a hash of their id).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.scratch import materialize, sampled

ORDER = 8
#: Absolute discount of a class's own counts: what a class has seen this often or less is left to the shared counts.
CLASS_DISCOUNT = 3.0
#: Share of its words that a toxic text is taken to draw from the toxic model.
SHARE = 1 / 300
#: Code points of a word; longer ones are cut into pieces of that length, all of which count.
MAX_WORD = 64
#: Characters and documents of a block, whose words are looked up together; a longer text is a block of its own.
BLOCK_CHARS, BLOCK_DOCS = 1 << 24, 1 << 14
#: Events up to which the models are broadcast: 30 MB sent, some 200 MB in a Python worker.
BROADCAST_EVENTS = 2_000_000
#: Words whose gain a worker remembers.
CACHED_WORDS = 400_000
#: Label rows up to which the labels are broadcast instead of joined by a shuffle: about 16 MB.
BROADCAST_LABELS = 1_000_000
CALIBRATION_ROWS = 20_000
#: Ratios are kept in whole millionths, so that sums don't depend on the order of rows.
UNIT = 1e6
EDGE = "\n"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’‚…–—·•、。！？"


def words(text: str) -> list[str]:
    """The words of a text, in order."""
    out = []
    for part in text.lower().split():
        w = part.strip(_MARKS)
        if len(w) <= MAX_WORD:
            if w:
                out.append(w)
        else:
            out += (w[i : i + MAX_WORD] for i in range(0, len(w), MAX_WORD))
    return out


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts in each class, summed up over many texts."""
    held = Counter(), Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        for toxic, counts in enumerate(held):
            names, n = list(counts), list(counts.values())
            zero = [0] * len(n)
            for i in range(0, len(n), 50_000):
                part = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(names[part], pa.string()), pa.array((zero, n)[1 - toxic][part], pa.int64()), pa.array((zero, n)[toxic][part], pa.int64())], ["word", "n0", "n1"])
            counts.clear()

    for b in batches:
        for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist()):
            held[toxic].update(words(text.as_py() or ""))
            if len(held[0]) + len(held[1]) > 500_000:
                yield from flush()
    yield from flush()


def _spelled(word: Column) -> Column:
    return F.concat(F.lit(EDGE * (ORDER - 1)), word, F.lit(EDGE))


def _events(word: Column) -> Column:
    """An array of the word's events, each the symbol with those before it."""
    return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(_spelled(word), i, F.lit(ORDER)))


def _shared(grams: DataFrame) -> DataFrame:
    """gram and p, the shared model's probability of its last symbol; grams has each full event with its count n."""
    levels = {ORDER: grams.select("gram", "n")}
    for order in range(ORDER - 1, 0, -1):
        longer = levels[order + 1]
        levels[order] = materialize(longer.groupBy(F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("n")), "toxicity-level")
    p = None
    for order in range(1, ORDER + 1):
        level = levels[order]
        once, twice, total, kinds = level.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.sum("n"), F.count("*")).first()
        d = once / (once + 2 * twice) if once else 0.5
        if p is None:
            p = level.select("gram", (F.greatest(F.col("n") - d, F.lit(0.0)) / float(total or 1) + d * kinds / float(total or 1) / (kinds + 1)).alias("p"))
            continue
        after = level.groupBy(F.substring("gram", 1, order - 1).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        lower = p.select(F.col("gram").alias("lower"), F.col("p").alias("below"))
        met = level.join(after, F.substring("gram", 1, order - 1) == F.col("context")).join(lower, F.substring("gram", 2, order - 1) == F.col("lower"))
        p = met.select("gram", ((F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("kinds") * F.col("below")) / F.col("total")).alias("p"))
    return p


def ratios(counts: DataFrame) -> DataFrame:
    """(key, value): log p_1 - log p_0, in millionths, of events seen more often than the discount, and for contexts (one symbol shorter) of anything else after them, if not 0.

    counts has word, n0 and n1.
    """
    grams = counts.select(F.explode(_events(F.col("word"))).alias("gram"), "n0", "n1").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    grams = materialize(grams.withColumn("n", F.col("n0") + F.col("n1")), "toxicity-grams")
    d = F.lit(CLASS_DISCOUNT)
    context = F.substring("gram", 1, ORDER - 1)
    sums = [f(c).cast("double").alias(f"{k}{c[1]}") for c in ("n0", "n1") for k, f in (("t", F.sum), ("f", lambda c: F.sum(F.least(F.col(c), d))))]
    contexts = materialize(grams.groupBy(context.alias("context")).agg(*sums).where("t0 > f0 OR t1 > f1"), "toxicity-contexts")
    rest = lambda c: F.when(F.col(f"t{c}") > 0, F.col(f"f{c}") / F.col(f"t{c}")).otherwise(1.0)
    own = lambda c: F.greatest(F.col(f"n{c}") - d, F.lit(0.0)) / F.greatest(F.col(f"t{c}"), F.lit(1.0))
    often = grams.where((F.col("n0") > d) | (F.col("n1") > d)).join(_shared(grams), "gram").join(contexts, context == F.col("context"))
    log = lambda c: F.log(own(c) + rest(c) * F.col("p"))
    whole = lambda x: F.round(x * UNIT).cast("long").alias("value")
    seen = often.select(F.col("gram").alias("key"), whole(log(1) - log(0)))
    unseen = contexts.select(F.col("context").alias("key"), whole(F.log(rest(1)) - F.log(rest(0)))).where("value <> 0")
    return materialize(seen.unionByName(unseen), "toxicity-ratios")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as packed counts of their block's words, and the words of each block with their places."""
    base, block = TaskContext.get().partitionId() << 32, 0
    place: dict[str, int] = {}
    rows: list[tuple] = []
    chars = 0
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.string()]
    names = ["block", "doc_id", "held_out", "n_words", "kinds", "packed", "place", "word"]

    def flush() -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        every = list(place)
        for i in range(0, len(every), 50_000):
            part = every[i : i + 50_000]
            none = [None] * len(part)
            yield pa.RecordBatch.from_arrays([pa.array([base + block] * len(part)), *(pa.array(none, t) for t in types[1:6]), pa.array(range(i, i + len(part)), pa.int32()), pa.array(part)], names)
        place.clear()
        rows.clear()

    for b in batches:
        for doc_id, held_out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            counts = Counter(words(text.as_py() or ""))
            at = np.array([[place.setdefault(w, len(place)), n] for w, n in counts.items()], np.int32).reshape(-1, 2)
            at = at[np.argsort(at[:, 0])]
            raw = np.r_[np.diff(at[:, 0], prepend=0), at[:, 1]].astype(np.int32).tobytes()
            rows.append((base + block, doc_id, held_out, sum(counts.values()), len(at), pa.compress(raw, "zstd", asbytes=True) if raw else b"", None, None))
            chars += len(text.as_py() or "")
            if chars >= BLOCK_CHARS or len(rows) >= BLOCK_DOCS:
                yield from flush()
                block, chars = block + 1, 0
    yield from flush()


def word_ratios(vocabulary: DataFrame, model: DataFrame) -> DataFrame:
    """(word, ratio): log P_1 - log P_0, in millionths, of each word of the vocabulary, where it is not 0."""
    event = F.explode(_events(F.col("word")))
    path = vocabulary.select("word").distinct().select("word", event.alias("event"))
    seen, after = (model.select(F.col("key").alias(k), F.col("value").alias(f"{k}_value")) for k in ("event", "context"))
    known = path.join(seen, "event", "left").join(after, F.substring("event", 1, ORDER - 1) == F.col("context"), "left")
    value = F.coalesce("event_value", "context_value", F.lit(0))
    return known.groupBy("word").agg(F.sum(value).alias("ratio")).where("ratio <> 0")


def _weigh(docs: pa.Table, ratio: pa.Table) -> pa.Table:
    """Evidence of one block's documents."""
    place = ratio.column("place").to_numpy()
    gain = np.full(int(place.max()) + 1 if len(place) else 0, 0.0)
    gain[place] = ratio.column("ratio").to_numpy() / UNIT
    gain = np.log1p(SHARE * np.expm1(np.minimum(gain, 500.0)))
    nothing = math.log1p(SHARE * math.expm1(0.0))
    evidence = []
    for n, kinds, packed in zip(docs.column("n_words").to_pylist(), docs.column("kinds").to_pylist(), docs.column("packed")):
        if not n:
            evidence.append(0.0)
            continue
        raw = np.frombuffer(pa.decompress(packed.as_py(), decompressed_size=8 * kinds, codec="zstd", asbytes=True), np.int32)
        at, counts = np.cumsum(raw[:kinds]), raw[kinds:]
        known = at < len(gain)
        evidence.append(float((gain[at[known]] * counts[known]).sum() + nothing * counts[~known].sum()) / n)
    return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "evidence": pa.array(evidence, pa.float64())})


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def _gain(ratio: float) -> float:
    return math.log1p(SHARE * math.expm1(min(ratio / UNIT, 500.0)))


def _direct(sent):
    """Evidence of texts where they are read; sent is a broadcast of the events' ratios."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = sent.value.get
        known: dict[str, float] = {}

        def gain(word: str) -> float:
            s, total = f"{EDGE * (ORDER - 1)}{word}{EDGE}", 0
            for j in range(len(word) + 1):
                v = value(s[j : j + ORDER])
                total += value(s[j : j + ORDER - 1], 0) if v is None else v
            if len(known) >= CACHED_WORDS:
                known.clear()
            known[word] = _gain(total)
            return known[word]

        for b in batches:
            out = []
            for text in b.column("text"):
                counts = Counter(words(text.as_py() or ""))
                out.append(sum(n * (known[w] if w in known else gain(w)) for w, n in counts.items()) / max(1, sum(counts.values())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(out, pa.float64())], ["doc_id", "held_out", "evidence"])

    return run


def evidence(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, evidence) for each row; 0 for texts without a word."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    if model.limit(BROADCAST_EVENTS + 1).count() <= BROADCAST_EVENTS:
        sent = docs.sparkSession.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in model.select("key", "value").toArrow().columns))))
        return rows.mapInArrow(_direct(sent), "doc_id long, held_out boolean, evidence double")
    schema = "block long, doc_id long, held_out boolean, n_words long, kinds int, packed binary, place int, word string"
    packed = materialize(rows.mapInArrow(_pack, schema), "toxicity-blocks")
    vocabulary = packed.where("word is not null").select("block", "place", "word")
    found = vocabulary.join(word_ratios(vocabulary, model), "word").select(F.col("block").alias("of_block"), "place", "ratio")
    texts = packed.where("word is null").select("block", "doc_id", "held_out", "n_words", "kinds", "packed")
    return texts.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(_weigh, "doc_id long, held_out boolean, evidence double")


@dataclass(frozen=True)
class Curve:
    """score = 1 / (1 + exp(-(slope * (x - middle)))), where x = log(evidence + FLOOR)."""

    slope: float
    middle: float


#: Added to the evidence before its logarithm is taken: that of a text in which nothing points either way.
FLOOR = 1e-4


def _place(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 0) + FLOOR)


def fit_curve(x: np.ndarray, toxic: np.ndarray) -> Curve:
    """The middle lies where most rows fall on their own side (between two rows; of equally good places the middle one); the slope there is the most likely one."""
    if not 0 < toxic.sum() < len(toxic):  # nothing to calibrate on
        return Curve(1.0, math.log(SHARE))
    z = _place(x)
    order = np.argsort(z, kind="stable")
    z, y = z[order], toxic[order].astype(float)
    right = np.r_[0, np.cumsum(1 - y)] + np.r_[np.cumsum(y[::-1])[::-1], 0]  # rows on their side if the cut lies before row i
    cuts = np.flatnonzero((np.r_[True, z[1:] > z[:-1], True]) & (np.arange(len(z) + 1) > 0) & (np.arange(len(z) + 1) < len(z)))
    if not len(cuts):
        return Curve(1.0, float(z[0]) + 1.0)
    best = cuts[right[cuts] == right[cuts].max()]
    at = best[len(best) // 2]
    middle, slope = float(z[at - 1] + z[at]) / 2, 1.0
    for _ in range(100):  # Newton steps with a weak prior that keeps separable samples finite
        p = 1 / (1 + np.exp(-np.clip(slope * (z - middle), -30, 30)))
        gradient = ((y - p) * (z - middle)).sum() - 0.1 * slope
        step = gradient / ((p * (1 - p) * (z - middle) ** 2).sum() + 0.1)
        slope = min(50.0, max(0.1, slope + max(-1.0, min(1.0, step))))
        if abs(step) < 1e-9:
            break
    return Curve(slope, middle)


def _marked(labels: DataFrame, label_col: str) -> DataFrame:
    """One row for each labelled id that may be learned from."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id") != 0))
    return usable.groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The models' ratios, from all labelled rows of remainders 1 to 3."""
    marked = _marked(labels, label_col).where(remainder("id") != 4)
    small = labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(marked) if small else marked, "id").select("text", "toxic")
    counted = rows.mapInArrow(_class_counts, "word string, n0 long, n1 long")
    return ratios(counted.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def calibrate(found: DataFrame, labels: DataFrame, label_col: str = "toxic", calibration_rows: int = CALIBRATION_ROWS) -> Curve:
    """The curve, from a sample of the labelled rows of remainder 4; found is `evidence` of them (and maybe of others)."""
    marked = _marked(labels, label_col).where(remainder("id") == 4)
    chosen = sampled(marked, F.xxhash64("id"), calibration_rows)
    rows = found.join(chosen, F.col("doc_id") == F.col("id")).select("evidence", "toxic").toPandas()
    return fit_curve(rows["evidence"].to_numpy(float), rows["toxic"].to_numpy(int))


def score(found: DataFrame, curve: Curve) -> DataFrame:
    """doc_id, held_out, score, predicted of rows of `evidence`."""
    x = F.log(F.greatest(F.col("evidence"), F.lit(0.0)) + FLOOR)
    p = 1 / (1 + F.exp(-F.lit(curve.slope) * (x - F.lit(curve.middle))))
    return found.select("doc_id", "held_out", p.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """Train on the labelled rows and score every document: doc_id, held_out, score, predicted.

    Null and empty texts have no evidence and get the score of no evidence.  A
    null doc_id is not held out.  Repeated rows each have their row; a label
    given more than once is toxic if one of them is; other columns are ignored;
    an empty table gives no rows; without labels every text gets the score of
    no evidence.
    """
    found = materialize(evidence(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col), "toxicity-evidence")
    return score(found, calibrate(found, labels, label_col, calibration_rows))
