from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import scratch
from sparkloom.llm import toxicity as X


def slow_ratio(texts):
    """log P_1 - log P_0 of a word by the plain formulas, from (text, class) pairs."""
    order, d_class = X.ORDER, X.CLASS_DISCOUNT
    events = defaultdict(lambda: [0, 0])
    for text, toxic in texts:
        for w in X.words(text):
            s = "\n" * (order - 1) + w + "\n"
            for j in range(order, len(s) + 1):
                events[s[j - order : j]][toxic] += 1
    levels = {order: {g: sum(n) for g, n in events.items()}}
    for o in range(order - 1, 0, -1):
        levels[o] = Counter(g[1:] for g in levels[o + 1])
    shared = None
    for o in range(1, order + 1):
        level, total, kinds = levels[o], Counter(), Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        once, twice = (sum(n == k for n in level.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once else 0.5
        below = (lambda g: 1 / (len(level) + 1)) if o == 1 else (lambda g, p=shared: p[g[1:]])
        shared = {g: (max(n - d, 0) + d * kinds[g[:-1]] * below(g)) / total[g[:-1]] for g, n in level.items()}

    def sums(context, c):
        after = [n[c] for g, n in events.items() if g[:-1] == context]
        return sum(after), sum(min(n, d_class) for n in after)

    memo = {}

    def log_p(g, c):
        if (g[:-1], c) not in memo:
            memo[g[:-1], c] = sums(g[:-1], c)
        t, f = memo[g[:-1], c]
        p = shared.get(g, 1.0)  # anything unseen has the same shared probability in both classes
        return math.log((max(events[g][c] - d_class, 0) + f * p) / t if t else p) if g in shared else math.log(f / t if t else 1.0)

    def ratio(word):
        s = "\n" * (order - 1) + word + "\n"
        return sum(log_p(s[j - order : j], 1) - log_p(s[j - order : j], 0) for j in range(order, len(s) + 1))

    return ratio


def slow_evidence(text, ratio):
    found = X.words(text)
    return sum(math.log(1 - X.SHARE + X.SHARE * math.exp(ratio(w))) for w in found) / len(found) if found else 0.0


def corpus(n=900, seed=6):
    random.seed(seed)
    syllables = "ba ko ri tu na me lo shi fa de".split()
    word = lambda: "".join(random.choice(syllables) for _ in range(random.randint(2, 3)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(random.randint(30, 150))]
        if i % 6 == 0:
            for _ in range(max(2, len(words) // 30)):
                words[random.randrange(len(words))] = random.choice(["zorgish", "zorgful", "zorgen,", "quixxed"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    return rows, labels


def test_words():
    assert X.words("Ab, (1d1ot) x.y ... É\n 中文。") == ["ab", "1d1ot", "x.y", "é", "中文"]
    assert X.words("") == [] and X.words(" \n") == []
    assert X.words("a" * 150) == ["a" * 64, "a" * 64, "a" * 22]


@pytest.mark.parametrize("events", [10**6, 0])
def test_evidence_matches_the_plain_formulas(spark, monkeypatch, events):
    monkeypatch.setattr(X, "BROADCAST_EVENTS", events)  # broadcast, or joined
    monkeypatch.setattr(X, "BLOCK_DOCS", 64)
    rows, labels = corpus(300)
    rows += [(1000, ""), (1001, "???"), (1002, "zorgxyz 1d1ot 中文 " + "q" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.evidence for r in X.evidence(docs, X.train(docs, marked)).collect()}
    rest = lambda i: zlib.crc32(str(i).encode()) % 5
    texts = dict(rows)
    ratio = slow_ratio([(texts[i], c) for i, c in labels if rest(i) in (1, 2, 3)])
    known: dict[str, float] = {}
    cached = lambda w: known.setdefault(w, ratio(w)) if w not in known else known[w]
    assert len(got) == len(rows)
    for i, text in rows:
        assert got[i] == pytest.approx(slow_evidence(text, cached), abs=1e-6), i


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = X.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas().set_index("doc_id")
    assert all(got["held_out"][i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(900))
    held = got[got["held_out"]]
    truth = held.index.to_numpy() % 6 == 0
    assert (held["predicted"].to_numpy() == truth).mean() > 0.95
    assert ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()


def test_curve():
    rng = np.random.default_rng(2)
    toxic = rng.random(2000) < 0.1
    x = np.where(toxic, rng.exponential(0.1, 2000) + 0.004, rng.exponential(0.0002, 2000))
    curve = X.fit_curve(x, toxic.astype(int))
    z = np.log(x + X.FLOOR)
    assert (((z >= curve.middle) == toxic).mean()) > 0.995 and curve.slope > 0
    assert X.fit_curve(np.zeros(4), np.zeros(4, int)) == X.Curve(1.0, math.log(X.SHARE))
    assert 0 < X.fit_curve(np.zeros(4), np.array([0, 1, 0, 1])).slope


def test_samples_of_any_share(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000)
    assert scratch.sampled(rows, F.xxhash64("id"), 20_000).count() == 20_000
    assert 800 < scratch.sampled(rows, F.xxhash64("id"), 1000).count() < 1200

    class Huge:  # a table of 10**12 rows, of which a thousand are wanted: a share of 1e-9
        def count(self):
            return 10**12

        def where(self, condition):
            return condition

    kept = scratch.sampled(Huge(), F.col("h"), 1000)
    low = -(1 << 63)
    step = (1 << 64) // 10**9
    hashes = spark.createDataFrame([(low,), (low + step - 2,), (low + step + 2,), (0,), ((1 << 63) - 1,)], "h long")
    assert [r.h for r in hashes.where(kept).collect()] == [low, low + step - 2]


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, 1), (5, 1), (6, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = X.toxicity(odd_docs, labels).toPandas()
    assert len(got) == 9 and got["score"].between(0, 1).all()
    assert not got[got["doc_id"].isna()]["held_out"].any()
    assert X.toxicity(no_docs, labels).count() == 0
    none = X.toxicity(odd_docs, labels.limit(0)).toPandas()
    assert len(none) == 9 and not none["predicted"].any()
