"""Language identification by character n-grams: profiles counted over a labelled corpus, log-likelihoods, probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAMS = (1, 2, 3)
PROFILE = 3000  # n-grams kept of each language and length
MAX_LANGUAGES = 300  # with PROFILE, what the table of profiles holds at most
MIN_CHARS = 20  # shorter texts are taken for DEFAULT
DEFAULT = "en"
_REST = r"[^\p{L}\p{M}]+"
_MEMO, _MEMO_CELLS = 200_000, 1 << 21  # words whose scores a task remembers, and scores in all


def _words(text: Column) -> Column:
    """Lower-case words, a blank between two."""
    return F.trim(F.regexp_replace(F.lower(text), _REST, " "))


def _grams(n: int) -> Column:
    """N-grams of a word with a blank on either side."""
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substr(padded, i, F.lit(n)))


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, n, gram, count, total): the most frequent n-grams of each language and length, ties by code point.

    Words are counted before they are cut into n-grams, so what is cut is a
    vocabulary.  total is the count of all n-grams of that length, kept or not.
    Null labels and null texts teach nothing.
    """
    words = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.explode(F.split(_words(F.col(text_col).cast("string")), " ")).alias("word"))
    counted = words.where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("count"))
    cut = None
    for n in GRAMS:
        one = counted.select("lang", F.lit(n).alias("n"), F.explode(_grams(n)).alias("gram"), "count")
        cut = one if cut is None else cut.unionByName(one)
    found = cut.where("gram <> ' '").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    best = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("count"), "gram"))
    kept = found.withColumn("place", best).where(F.col("place") <= size).drop("place")
    return kept.join(found.groupBy("lang", "n").agg(F.sum("count").alias("total")), ["lang", "n"])


@dataclass(frozen=True)
class Model:
    """Log-probabilities of n-grams by language."""

    languages: list[str]
    grams: dict[str, int]
    weights: np.ndarray


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, smoothing: float = 0.5) -> Model:
    """A model of profiles. At most MAX_LANGUAGES languages of `size` n-grams a length come to the driver, more is an error; the counts are over all of docs."""
    table = profiles(docs, text_col, lang_col, size)
    limit = MAX_LANGUAGES * len(GRAMS) * size
    rows = table.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs, lengths, texts = (rows[c].to_pylist() for c in ("lang", "n", "gram"))
    languages, grams = sorted(set(langs)), {g: i for i, g in enumerate(sorted(set(texts)))}
    place = {name: i for i, name in enumerate(languages)}
    counts, totals = np.zeros((len(grams), len(languages))), np.zeros((len(GRAMS) + 1, len(languages)))
    for lang, n, gram, count, total in zip(langs, lengths, texts, rows["count"].to_pylist(), rows["total"].to_pylist()):
        counts[grams[gram], place[lang]] = count
        totals[n, place[lang]] = total
    of = np.array([len(g) for g in grams], dtype=int)
    kinds = np.bincount(of, minlength=len(totals)) if len(grams) else np.zeros(len(totals))
    weights = np.log(counts + smoothing) - np.log(totals[of] + smoothing * (kinds[of][:, None] + 1)) if len(grams) else counts
    return Model(languages, grams, weights)


def identify(docs: DataFrame, model: Model, text_col: str = "text", chars: int | None = None) -> DataFrame:
    """docs with `language` and its `probability`, in one pass without a shuffle.

    A language's log-likelihood is the sum over a text's n-grams that any
    profile has; probabilities are these, exponentiated and normalised.  Texts
    under 20 characters (stripped), null texts and texts without a known n-gram
    are DEFAULT with a null probability; ties go to the language that comes
    first.  Whole texts are read unless `chars` bounds them.  Columns of these
    names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(word: str, m: Model) -> np.ndarray:
        padded = f" {word} "
        rows = [m.grams[g] for n in GRAMS for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in m.grams]
        return np.append(m.weights[rows].sum(axis=0), len(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = shared.value, {}
        scores = np.zeros((max(1, min(_MEMO, _MEMO_CELLS // (len(m.languages) + 1))), len(m.languages) + 1))  # one table: smaller than an array a word
        for batch in batches:
            names, shares = [], []
            for words in batch.column("__words").cast(pa.large_string()):
                total, places = np.zeros(len(m.languages) + 1), []
                for word in (words.as_py() or "").split():
                    place = memo.get(word)
                    if place is None:
                        if len(memo) >= len(scores):
                            total += scores[places].sum(axis=0)
                            memo.clear()
                            places = []
                        place = memo[word] = len(memo)
                        scores[place] = score(word, m)
                    places.append(place)
                total += scores[places].sum(axis=0)
                if not total[-1]:
                    names.append(DEFAULT)
                    shares.append(None)
                    continue
                best = int(total[:-1].argmax())
                names.append(m.languages[best])
                shares.append(float(1 / np.exp(total[:-1] - total[best]).sum()))
            out = batch.drop_columns(["__words"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(names, pa.string()), pa.array(shares, pa.float64())], [*out.schema.names, "language", "probability"])

    kept = docs.drop("language", "probability")
    text = F.col(text_col).cast("string")
    text = F.trim(F.substring(text, 1, chars) if chars else text)
    read = kept.withColumn("__words", F.when(F.length(text) >= MIN_CHARS, _words(text)))
    schema = kept.withColumns({"language": F.lit(None).cast("string"), "probability": F.lit(None).cast("double")}).schema
    return read.mapInArrow(run, schema)


def accuracy(found: DataFrame, lang_col: str = "lang", guess_col: str = "language") -> DataFrame:
    """(lang, n, right_n): labelled rows of each language and how many were told."""
    return found.where(F.col(lang_col).isNotNull()).groupBy(lang_col).agg(F.count("*").alias("n"), F.count_if(F.col(lang_col) == F.col(guess_col)).alias("right_n"))
