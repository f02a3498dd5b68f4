"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Base rules reject very short texts and texts that mostly repeat themselves.
Of the others each has a vector of transformed statistics.  Per language and
source the minimum covariance determinant is sought: from three starts
(quartiles; correlations of squashed values; of spatial signs) two
concentration steps each, that is mean and covariance of the share `SUPPORT`
of rows nearest to the last estimate; the start with the least determinant
goes on until its determinant stays.  A last step weighs in all rows that are
not far from that.  Covariances of truncated sets are enlarged by the factor
that makes them right for normal data.  Rows beyond a Mahalanobis cutoff are
rejected.  Statistics are rounded to integers, so the sums are exact and
reruns agree whatever the order of rows.

Statistics that hardly vary would make the covariance singular; each has a
floor that is added to its variance (as in regularised versions of the
estimator).  A language-source pair of fewer than `MIN_GROUP` rows is judged by
the estimate of its whole language, and where that is as small, of all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.scratch import drop, fresh, materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
#: Statistics are counted in steps of this.
STEP = 0.001
#: Smallest standard deviation of each statistic, in its own unit.  FAR must be in reach of each one alone: in a pool that
#: has none, symbols of 0.18 a word, and shares of 0.36 of duplicate lines or repeated words, are outliers.  A paragraph that a
#: short text says twice is not: of 3,243 documents labelled good on sf0.1, floors of 0.1 for the last two reject 55, these 9.
FLOORS = {"word_length": 0.05, "symbols": 0.1, "dup_lines": 0.14, "repeats": 0.14}
#: Share of a group's rows that the estimate must fit, and rows that a group needs to be judged by itself.
SUPPORT, MIN_GROUP = 0.75, 50
#: Steps of every start, and of the best one at most (the determinant falls with each; some ten do).
FIRST_STEPS, LAST_STEPS = 2, 40
#: Change of the logarithm of the root of a determinant below which it stays: a tenth of a percent of a standard deviation in each statistic.
SAME = 4e-3
#: Squared distances: the reweighting step's (0.975 quantile of chi-squared, 4 degrees), and the verdict's (0.999 quantile).
NEAR, NEAR_SHARE = 11.143, 0.975
FAR = 18.467
#: 0.75 quantile of the same distribution.
SUPPORT_QUANTILE = 5.385
#: Distances are ordered in steps of half a percent, which makes them keys of a small histogram.
BINS = 200


def _consistency(share: float, quantile: float) -> float:
    """Ratio of the variance of normal data in four dimensions to that of their share within a squared distance."""
    x = quantile / 2
    return share / (1 - math.exp(-x) * (1 + x + x * x / 2))


def base_counts(text: Column) -> dict[str, Column]:
    """Native columns of the base statistics of a text column without nulls.

    Needs `base_stats` around it, which splits the work in steps.
    """
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return {
        "__words": words,
        "__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOL, ""))).cast("long"),
    }


def base_stats(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The given columns with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (all long)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(*keep, F.struct(text.alias("t")).alias("__t"))
    split = base.select("*", *(c.alias(k) for k, c in base_counts(F.col("__t.t")).items())).drop("__t")
    # places of 3-word windows, ordered by the window's hash: equal windows are neighbours
    n = F.size("__words")
    window = lambda i: F.struct(F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)).alias("h"), i.alias("i"))
    hashed = split.select(
        "*",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))).alias("__at"),
    ).drop("__words", "__lines")
    same = lambda i, j: F.get("__at", i)["h"] == F.get("__at", j)["h"]
    twice = F.filter("__at", lambda x, j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
    marked = hashed.withColumn("__twice", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__at")
    # each repeated window covers its three words, less those that the next one covers too
    cover = F.transform("__twice", lambda p, j: F.least(F.coalesce(F.get("__twice", j + 1) - p, F.lit(3)), F.lit(3)))
    repeats = F.coalesce(F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return marked.withColumn("n_repeat_words", repeats).drop("__twice")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def _vector() -> dict[str, Column]:
    """Transformed statistics in whole steps."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(b, F.lit(1)))
    raw = {
        "word_length": F.log(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
        "symbols": F.least(share("n_symbols", F.col("n_words")), F.lit(4.0)),
        "dup_lines": share("n_dup_lines", F.col("n_lines")),
        "repeats": share("n_repeat_words", F.col("n_words")),
    }
    return {k: F.round(v / STEP).cast("long") for k, v in raw.items()}


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor (columns c_i, l_ij)."""
    solved: list[Column] = []
    for i, name in enumerate(names):
        left = F.col(name) - F.col(f"c{i}")
        for j in range(i):
            left = left - F.col(f"l{i}{j}") * solved[j]
        solved.append(left / F.col(f"l{i}{i}"))
    return sum((x * x for x in solved[1:]), solved[0] * solved[0])


_PAIRS = [(i, j) for i in range(len(FLOORS)) for j in range(i + 1)]


def _factor(model: DataFrame, names: list[str]) -> DataFrame:
    """Adds the Cholesky factor l_ij of the covariance s_ij, whose variances have the floors added, and its size, the logarithm of the determinant's root; `was` is the size before."""
    for i, j in _PAIRS:
        rest = F.col(f"s{i}{j}")
        if i == j:
            rest = rest + F.lit((FLOORS[names[i]] / STEP) ** 2)
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        model = model.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    size = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, len(names))), F.log("l00"))
    return model.select("pool", "start", "was", *(f"c{i}" for i in range(len(names))), *(f"l{i}{j}" for i, j in _PAIRS), F.round(size, 9).alias("size"))


def _sums(names: list[str]) -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(a).alias(f"t{i}") for i, a in enumerate(names)), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}{j}") for i, j in _PAIRS)]


def _moments(sums: DataFrame, names: list[str], enlarge: float) -> DataFrame:
    """Estimates from exact integer sums for each pool and start."""
    centred = sums.select("pool", "start", "was", "n", *((F.col(f"t{i}") / F.col("n")).alias(f"c{i}") for i in range(len(names))), *(f"q{i}{j}" for i, j in _PAIRS))
    spread = [((F.col(f"q{i}{j}") / F.col("n") - F.col(f"c{i}") * F.col(f"c{j}")) * enlarge).alias(f"s{i}{j}") for i, j in _PAIRS]
    return _factor(centred.select("*", *spread), names)


def _starts(rows: DataFrame, names: list[str]) -> DataFrame:
    """Three first estimates for each pool: medians, with quartile widths and no correlations, or those of squashed values or of spatial signs.

    The counts that percentile() holds are bounded by the statistics' ranges.
    """
    quart = rows.groupBy("pool").agg(*(F.percentile(F.col(a), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(a) for a in names))
    width = lambda a: F.greatest((F.get(a, F.lit(2)) - F.get(a, F.lit(0))) / 1.349, F.lit(FLOORS[a] / STEP))
    place = materialize(quart.select("pool", *(F.get(a, F.lit(1)).alias(f"c{i}") for i, a in enumerate(names)), *(width(a).alias(f"w{i}") for i, a in enumerate(names))), "quality-start")
    z = [(F.col(a) - F.col(f"c{i}")) / F.col(f"w{i}") for i, a in enumerate(names)]
    length = F.greatest(F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0])), F.lit(1e-9))
    whole = lambda x: F.round(x * 1000).cast("long")
    mapped = rows.join(place, "pool").select("pool", *(whole(F.tanh(x)).alias(f"a{i}") for i, x in enumerate(z)), *(whole(x / length).alias(f"b{i}") for i, x in enumerate(z)))
    sums = mapped.groupBy("pool").agg(*(F.sum(F.col(f"{k}{i}") * F.col(f"{k}{j}")).alias(f"{k}{i}{j}") for k in "ab" for i, j in _PAIRS))
    near = place.join(sums, "pool")
    out = None
    for start, k in enumerate(["", "a", "b"]):
        # shrunk a little, so that the factor exists whatever the correlations
        r = lambda i, j: F.coalesce(0.99 * F.col(f"{k}{i}{j}") / F.sqrt(F.nullif(F.col(f"{k}{i}{i}").cast("double") * F.col(f"{k}{j}{j}"), F.lit(0.0))), F.lit(0.0)) if k else F.lit(0.0)  # noqa: E731, B023
        own = near.select("pool", F.lit(start).alias("start"), F.lit(None).cast("double").alias("was"), *(f"c{i}" for i in range(len(names))), *((F.col(f"w{i}") * F.col(f"w{j}") * (F.lit(1.0) if i == j else r(i, j))).alias(f"s{i}{j}") for i, j in _PAIRS))
        out = own if out is None else out.unionByName(own)
    return _factor(out, names)


def _concentrated(rows: DataFrame, model: DataFrame, names: list[str]) -> DataFrame:
    """The next estimate for each pool and start: sums per pool and distance bin, of which the nearest bins that hold the support are added up."""
    bin_ = F.floor(F.log1p(_distance(names)) * BINS)
    hist = rows.join(model, "pool").select("pool", "start", F.col("size").alias("was"), *names, bin_.alias("bin")).groupBy("pool", "start", "was", "bin").agg(*_sums(names))
    upto = Window.partitionBy("pool", "start").orderBy("bin")
    every = Window.partitionBy("pool", "start")
    near = hist.withColumns({"before": F.sum("n").over(upto) - F.col("n"), "total": F.sum("n").over(every)}).where(F.col("before") < F.ceil(SUPPORT * F.col("total")))
    sums = near.groupBy("pool", "start", "was").agg(*(F.sum(c).alias(c) for c in ["n", *(f"t{i}" for i in range(len(names))), *(f"q{i}{j}" for i, j in _PAIRS)]))
    return _moments(sums, names, _consistency(SUPPORT, SUPPORT_QUANTILE))


def _least(rows: DataFrame, names: list[str]) -> DataFrame:
    """The estimate of least determinant that concentration reaches, for each pool; it stays when no determinant falls by more than `SAME`."""
    model = materialize(_starts(rows, names), "quality-model")
    for step in range(FIRST_STEPS + LAST_STEPS):
        if step == FIRST_STEPS:
            least = model.groupBy("pool").agg(F.min(F.struct("size", "start")).alias("m")).select("pool", F.col("m.start").alias("start"))
            model = model.join(least, ["pool", "start"])
        better = materialize(_concentrated(rows, model, names), "quality-model")
        model = better
        if step >= FIRST_STEPS and not better.where(F.abs(F.col("size") - F.col("was")) > SAME).limit(1).count():
            break
    return model


def _estimate(rows: DataFrame, names: list[str]) -> DataFrame:
    """Centre and factor for each pool, over all rows that are not far from the least determinant's."""
    near = rows.join(_least(rows, names), "pool").where(_distance(names) <= NEAR).groupBy("pool", "start", "was").agg(*_sums(names))
    return materialize(_moments(near, names, _consistency(NEAR_SHARE, NEAR)).drop("start", "size", "was"), "quality-model")


def _judged(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The columns of `quality`, and lang, source and text_key, which tell what the verdict rests on."""
    keep = [F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(text_col)).alias("text_key")]
    stats = base_stats(docs, keep, text_col)
    stats = stats.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    names = list(FLOORS)
    stats = materialize(stats.select("*", *(c.alias(k) for k, c in _vector().items())), "quality-stats")
    passed = stats.where(~F.col("base_failed"))
    # the pool that judges a pair, and the pools that its rows are counted in
    pair = materialize(passed.groupBy("lang", "source").agg(F.count("*").alias("n")), "quality-pairs")
    language = pair.groupBy(F.col("lang").alias("__l")).agg(F.sum("n").alias("m"), F.min("n").alias("least"))
    pools = {"pair": F.concat(F.lit("pair "), F.to_json(F.struct("lang", "source"))), "lang": F.concat(F.lit("lang "), F.to_json(F.struct("lang"))), "all": F.lit("all")}
    judge = F.when(F.col("n") >= MIN_GROUP, pools["pair"]).when(F.col("m") >= MIN_GROUP, pools["lang"]).otherwise(pools["all"])
    small = F.lit((language.agg(F.min("m")).first()[0] or 0) < MIN_GROUP)
    counted = F.array_compact(F.array(F.when(F.col("n") >= MIN_GROUP, pools["pair"]), F.when((F.col("m") >= MIN_GROUP) & (F.col("least") < MIN_GROUP), pools["lang"]), F.when(small, pools["all"])))
    pool = pair.join(language, F.col("lang").eqNullSafe(F.col("__l")), "left").select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), judge.alias("pool"), counted.alias("counted"))
    pool = materialize(pool, "quality-pools")
    own_pool = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    placed = materialize(passed.join(pool, own_pool).select(F.explode("counted").alias("pool"), *names), "quality-rows")
    model = _estimate(placed, names)
    drop(placed)
    out = stats.join(pool.select("__lang", "__source", "pool").join(model, "pool", "left"), own_pool, "left")
    distance = F.when(~F.col("base_failed"), F.round(_distance(names), 6))
    kept = ~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= FAR)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), distance.alias("distance"), "lang", "source", "text_key")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    Null and empty texts have no words and fail the base rules; null languages
    and sources are groups of their own; null ids and repeated rows keep their
    rows; other columns are ignored; an empty table gives no rows.  distance is
    null where the base rules fail.
    """
    return _judged(docs, id_col, text_col, lang_col, source_col).drop("lang", "source", "text_key")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that the rules keep, with all their columns, whatever their names.

    Rows that repeat stay or go together; null and empty texts go; rows with
    null ids, languages or sources are judged like others; an empty table stays
    empty.
    """
    key, own = fresh(docs, "key"), fresh(docs, "own")
    verdict = F.xxhash64(F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text_key"))
    good = _judged(docs, id_col, text_col, lang_col, source_col).where("kept").select(verdict.alias(key)).distinct()
    mine = F.xxhash64(F.col(id_col).cast("long"), F.col(lang_col).cast("string"), F.col(source_col).cast("string"), F.xxhash64(F.col(text_col)))
    return docs.withColumn(own, mine).join(good, F.col(own) == F.col(key), "left_semi").drop(own)
