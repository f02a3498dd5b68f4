from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts_match_brute_force(docs):
    got = Q.quality(docs).toPandas().set_index("doc_id")
    for r in docs.collect():
        assert tuple(got.loc[r.doc_id][COUNTS]) == brute(r.text)
    failed = (got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
    assert (got["base_failed"] == failed).all() and not got[got["base_failed"]]["kept"].any()


FLOOR = np.diag([(Q.FLOORS[k] / Q.STEP) ** 2 for k in Q.FLOORS])


def squared(x, centre, cov):
    return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)


def least_determinant(x, starts=150, seed=0):
    """Minimum covariance determinant by random starts, each concentrated until it stays."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(starts):
        own = x[rng.choice(len(x), 6, replace=False)]
        size = np.inf
        while True:
            centre, cov = own.mean(axis=0), np.cov(own.T, bias=True) * 1.4866 + FLOOR
            if len(own) > 6:  # the determinant of the few first rows is no rival
                now = np.linalg.slogdet(cov)[1]
                if now > size - 1e-9:
                    break
                size = now
            d = squared(x, centre, cov)
            own = x[np.log1p(d) // (1 / Q.BINS) <= np.sort(np.log1p(d) // (1 / Q.BINS))[int(np.ceil(0.75 * len(x))) - 1]]
        if best is None or size < best[0] - 1e-9:
            best = size, centre, cov
    return best


def reweighted(x, starts=150):
    _, centre, cov = least_determinant(x, starts)
    near = x[squared(x, centre, cov) <= 11.143]
    return squared(x, near.mean(axis=0), np.cov(near.T, bias=True) * 1.0645 + FLOOR)


def as_rows(spark, x, pool="p"):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"pool": pool, **dict(zip(Q.FLOORS, x.T.astype("int64")))}))


def model_of(row):
    factor = np.zeros((4, 4))
    for i in range(4):
        for j in range(i + 1):
            factor[i, j] = row[f"l{i}{j}"]
    return np.array([row[f"c{i}"] for i in range(4)]), factor @ factor.T


def test_normal_data_loses_what_the_cutoff_promises(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(0, 1, (4, 4))
    x = np.round(rng.normal(0, 1, (60_000, 4)) @ mix * 4000)
    centre, cov = model_of(Q._estimate(as_rows(spark, x), list(Q.FLOORS)).first())
    assert 0.0007 < (squared(x, centre, cov) > Q.FAR).mean() < 0.0013  # one in a thousand


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_determinant_is_as_small_as_that_of_many_random_starts(spark, share):
    rng = np.random.default_rng(int(share * 10))
    x = rng.normal(0, 1, (400, 4)) @ rng.normal(0, 1, (4, 4)) * 900
    x[: int(share * 400)] = rng.normal(0, 200, (int(share * 400), 4)) + [4000, 0, -9000, 3000]
    x = np.round(x)
    centre, cov = model_of(Q._least(as_rows(spark, x), list(Q.FLOORS)).first())
    size, _, _ = least_determinant(x)
    assert np.linalg.slogdet(cov)[1] <= size + 0.02
    d = squared(x, *model_of(Q._estimate(as_rows(spark, x), list(Q.FLOORS)).first()))
    assert (d[: int(share * 400)] > Q.FAR).all() and (d[int(share * 400) :] > Q.FAR).mean() < 0.02


def vectors(own):
    x = np.c_[np.log(own["word_chars"] / own["n_words"]), np.sqrt(own["n_symbols"] / own["n_words"]), np.sqrt(own["n_dup_lines"] / 1), np.sqrt(own["n_repeat_words"] / own["n_words"])]
    return np.floor(x / Q.STEP + 0.5)


def test_distances_match_a_slow_estimate(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(270):
        words = ["w" * int(k) for k in rng.integers(2, 9, 80)]
        if i % 40 == 0:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(f"{w}{j}" for j, w in enumerate(words)), "en", "small" if i >= 240 else "s" if i % 2 else "t"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = Q.quality(frame).toPandas().set_index("doc_id").sort_index()
    pools = {"s": (got.index < 240) & (got.index % 2 == 1), "t": (got.index < 240) & (got.index % 2 == 0), "small": got.index >= 240}
    for name, own in pools.items():
        counted = got if name == "small" else got[own]  # a small pair is judged by its language
        d = reweighted(vectors(counted))
        assert np.allclose(got[own]["distance"], d[own[: len(got)]] if name == "small" else d, rtol=1e-3, atol=1e-3), name
    assert set(got[~got["kept"]].index) == set(range(0, 270, 40))


def test_each_statistic_rejects_on_its_own(spark):
    """Documents of a clean pool, but for one statistic."""
    rng = np.random.default_rng(5)
    rows = [["w" * int(rng.integers(2, 9)) + str(i) for i in range(120)] for _ in range(100)]
    lines = list(rows[0])
    lines[1::2] = ["wwwww000"] * 60  # half of the lines are the same, no window is repeated
    texts = ["\n".join(r) for r in rows] + ["\n".join(lines)]
    texts.append(" ".join(w + "*" * (i % 3 == 0) for i, w in enumerate(rows[2])))  # a symbol at a third of the words
    texts.append(" ".join(rows[3][:60] + rows[3][:24] + rows[3][60:96]))  # 40% of the words are in repeats
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = Q.quality(frame).toPandas().set_index("doc_id")
    assert not got["base_failed"].any()
    assert set(got[~got["kept"]].index) == {100, 101, 102}


def test_odd_rows(odd_docs, no_docs):
    got = Q.quality(odd_docs).toPandas()
    assert len(got) == 9
    for text, row in ((None, 2), ("", 3)):
        assert tuple(got[got["doc_id"] == row][COUNTS].iloc[0]) == brute(text)
    kept = Q.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == int(got["kept"].sum())
    clash = odd_docs.selectExpr("*", "1 AS key", "2 AS own", "3 AS __key", "4 AS pool", "5 AS n")
    assert Q.keep_good(clash).columns == clash.columns and Q.keep_good(clash).count() == kept.count()
    assert Q.quality(no_docs).count() == 0 and Q.keep_good(no_docs).count() == 0


def test_keep_good_agrees_with_the_verdicts(docs):
    good = {r.doc_id for r in Q.quality(docs).where("kept").collect()}
    assert {r.doc_id for r in Q.keep_good(docs).collect()} == good


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a b", "", "x y z\nx y z\n\nx y z", "a b c d a b c e a b c"])
def test_repeats(spark, text):
    frame = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    assert tuple(Q.quality(frame).select(*COUNTS).first()) == brute(text)
