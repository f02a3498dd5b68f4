from __future__ import annotations

import numpy as np
import pytest

from sparkloom.llm import mixing as M


def test_targets_share_what_is_cut_off():
    assert M.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert M.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert M.targets([0, 0], [5, 2]) == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 100, 1000])
def test_permutations_are_permutations(n):
    at = np.arange(n)
    full = np.full(n, n)
    seen = [tuple(M.permute(np.full(n, s), np.full(n, t), at, full)) for s in (0, 5) for t in (0, 1)]
    for p in seen:
        assert sorted(p) == list(range(n))
    if n > 10:
        assert len(set(seen)) == 4


def test_mix_meets_targets_and_limits(docs):
    got = M.taken(docs).toPandas()
    again = M.taken(docs).toPandas()
    order = ["doc_id"]
    assert got.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    assert (got["taken"] <= 3 * got["size"]).all()
    import re

    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(n == len(re.findall(r"[^\x20\x09-\x0D]+", texts[i])) for i, n in zip(got["doc_id"], got["size"]))
    by_source = got.merge(docs.select("doc_id", "source").toPandas()).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), own=("size", "sum"))
    assert (by_source["size"] == by_source["own"]).all()
    assert by_source["target"].sum() == pytest.approx(got["size"].sum())
    assert ((by_source["taken"] - by_source["target"]).abs() <= 0.02 * by_source["target"] + 2).all()
    ordered = by_source.sort_index()
    weights = np.resize([5, 2, 1], len(ordered))
    assert np.allclose(ordered["target"], M.targets(list(ordered["size"]), list(weights)))


def test_taken_matches_brute_force(spark, docs):
    """Slots and places brought together by plain loops."""
    more = docs.unionByName(docs.limit(30))
    m = M.mix(more)
    slots, places = m.slots.collect(), m.docs.collect()
    by_source = {}
    for r in slots:
        by_source.setdefault(r.s, []).append(r)
    assert sorted(by_source) == [p.index for p in m.plan if p.slots]
    taken = {}
    for p in m.plan:
        own = by_source[p.index]
        assert sorted(r.k for r in own) == list(range(p.slots))
        uses = np.bincount([r.block for r in own], minlength=p.blocks)
        assert len(uses) == p.blocks and set(uses) <= {p.slots // p.blocks, -(-p.slots // p.blocks)}
        words = np.repeat(uses, p.block_words)[: p.size]  # how often each word of the source is taken
        at = 0
        for r in sorted((r for r in places if r.s == p.index), key=lambda r: (r.start, r["size"])):
            assert r.start == at  # end to end, in some order
            at += r["size"]
            taken.setdefault((r.doc_id, r["size"]), []).append(int(words[r.start : at].sum()))
        assert at == p.size
    got = {}
    for r in M.taken(more).collect():
        got.setdefault((r.doc_id, r["size"]), []).append(r.taken)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in taken.items()}


def test_every_shard_is_a_mix(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_SLOTS", 64)
    rows = [(i, "w " * 400, f"s{i % 5}") for i in range(1500)]
    m = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    shards = {}
    for r in m.slots.collect():
        shards.setdefault(r.shard, []).append(r.s)
    drawn = -(-sum(p.slots for p in m.plan) // 64)
    assert set(shards) >= set(range(drawn))
    assert all(len(set(x)) >= 3 for k, x in shards.items() if k < drawn * 0.95)
    late = [x for k, x in sorted(shards.items()) if k >= drawn]
    assert late and all(len(x) <= 64 for x in late)
    every = [s for x in late for s in x]
    common = {s for s in every if every.count(s) >= 0.15 * len(every)}
    assert all(common <= set(x) for x in late if len(x) == 64)


def test_clashing_names_and_repeated_rows(spark):
    rows = [(1, "a b c d e f g h", "s", 1), (1, "a b c d e f g h", "s", 2), (None, "i j k l", None, 3), (None, "i j k l", None, 4), (2, None, "s", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, key int").selectExpr("*", "key AS `__h`", "1 AS `__parts`", "2 AS nth", "3 AS items", "4 AS `__c`", "5 AS size", "6 AS copy", "7 AS s")
    want = {}
    for r in M.taken(frame).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    mixed = M.mixed_text(frame)
    assert mixed.columns == frame.columns
    got, runs = {}, [sorted(map(repr, M.mixed_text(frame).collect())) for _ in range(2)]
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert runs[0] == runs[1] and got == {k: n for k, n in want.items() if n}


def test_mixed_text_holds_the_words_taken(docs):
    got = M.taken(docs).toPandas().set_index("doc_id")["taken"]
    words = M.mixed_text(docs).rdd.map(lambda r: (r.doc_id, len((r.text or "").encode().split()))).collect()
    sums: dict[int, int] = {}
    for i, n in words:
        sums[i] = sums.get(i, 0) + n
    assert sums == {i: n for i, n in got.items() if n}


def test_odd_rows(odd_docs, no_docs):
    got = M.taken(odd_docs).toPandas()
    assert len(got) == 9 and (got["taken"] <= 3 * got["size"]).all()
    assert (got[got["size"] == 0]["taken"] == 0).all()
    mixed = M.mixed_text(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() > 0
    assert M.taken(no_docs).count() == 0 and M.mixed_text(no_docs).count() == 0


def test_only_empty_texts(spark):
    frame = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = M.taken(frame).toPandas()
    assert list(got["taken"]) == [0, 0] and list(got["target"]) == [0, 0]
    assert M.mixed_text(frame).count() == 0


def test_mixed_text_carries_maps(spark):
    """Repeated rows that differ in a map alone have places of their own."""
    rows = [(1, "a b c d e f", "web", {"k": i}) for i in range(2)] + [(2, "g h i j", "books", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string, int>")
    got = M.mixed_text(docs).collect()
    assert got and {r.m["k"] if r.m else None for r in got if r.doc_id == 1} <= {0, 1}
    assert all(r.m is None for r in got if r.doc_id == 2)
    assert sum(len(r.text.split()) for r in got) == sum(r.taken for r in M.taken(docs).collect())
