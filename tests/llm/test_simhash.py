from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import simhash as S
from sparkloom.llm.components import connected_components


def brute_components(fps: list[int], limit: int = 2) -> dict[int, int]:
    parent = {f: f for f in fps}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= limit:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def slow_simhash(text: str) -> int:
    words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_matches_a_slow_one():
    for text in ["", "one", "One two", "a b c", "a b c a b c a b c", "É é Straße  x\x0by z w", "the end of the line " * 50]:
        assert S.simhash(text.encode()) == slow_simhash(text)


def test_groups_match_brute_force(spark, docs):
    got = S.near_duplicates(docs).toPandas()
    assert len(got) == docs.count()
    fps = sorted({int(x, 16) for x in got["fingerprint"]})
    root = brute_components(fps)
    expected = got.groupby(got["fingerprint"].map(lambda x: root[int(x, 16)]))["doc_id"].transform("min")
    assert (expected == got["component_id"]).all()


def _links(spark, fps, dense):
    frame = spark.createDataFrame([(S._signed(int(f)),) for f in fps], "fp long")
    edges = S.links(frame, dense)
    found = {r.node: r.root for r in connected_components(edges).collect()}
    return {int(f): found.get(S._signed(int(f)), S._signed(int(f))) for f in fps}


def test_crowded_cells_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centres = [0, (1 << 64) - 1, 1 << 63, 0x0123456789ABCDEF]
    fps = set()
    for c in centres:
        for _ in range(150):
            fps.add(c ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 3)))))
    fps |= {int(x) for x in rng.integers(0, 2**64, 200, dtype=np.uint64)}
    expected = brute_components(sorted(fps))
    for dense in (2, 16, 1000):
        got = _links(spark, sorted(fps), dense)
        groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
        assert groups(got) == groups(expected), dense


def test_odd_rows(odd_docs, no_docs):
    got = S.near_duplicates(odd_docs).toPandas()
    assert len(got) == 9
    assert set(got[got["doc_id"] == 1]["component_id"]) == {1}
    empty = got[got["fingerprint"] == "0" * 16]
    assert len(empty) == 4 and set(empty["component_id"]) == {2}
    assert S.near_duplicates(no_docs).count() == 0


def test_deduplicate_keeps_one_of_each(odd_docs, no_docs):
    kept = S.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 6] and ids.count(None) == 1
    assert S.deduplicate(no_docs).count() == 0


def test_deduplicate_loses_no_other_document(spark):
    """Different texts under one id all stay; copies that differ in another column keep the same row in each run."""
    rows = [(1, f"quite another text number {i} with words of its own {i * 7} and more {i * 11}", "a", i) for i in range(7)]
    rows += [(2, "one and the same text in two rows", "a", 0), (2, "one and the same text in two rows", "b", 1), (3, "one and the same text in two rows", "a", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, own int").selectExpr("*", "1 AS kept", "2 AS `__own`", "3 AS root", "4 AS band", "5 AS print", "6 AS row", "7 AS rest")
    runs = [sorted(map(repr, S.deduplicate(frame.repartition(n)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 8
    assert S.deduplicate(frame).columns == frame.columns


def test_deduplicate_finds_edited_copies(spark):
    """Against exact Jaccard similarities of five-word shingle sets, near the threshold on either side."""
    rng = np.random.default_rng(12)
    rows = []
    for g in range(40):
        words = [f"w{int(x)}" for x in rng.integers(0, 500, 60 + 6 * g)]
        rows.append(words)
        for edits in (1, 2, 1 + g // 4):
            copy = list(words)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = f"edit{int(rng.integers(0, 10**6))}"
            rows.append(copy)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    links = 0
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                low, high = sorted((find(i), find(j)))
                group[high], links = low, links + 1
    assert links > 60 and len({find(i) for i in group}) > 45  # some copies are near, some are not
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    assert sorted(r.doc_id for r in S.deduplicate(docs).collect()) == sorted({find(i) for i in range(len(rows))})


def test_near_copies_agree_beyond_the_broadcast_limit(spark, docs, monkeypatch):
    """Texts fetched by a shuffle join give the same groups as by a broadcast of their keys."""
    few = sorted(r.doc_id for r in S.deduplicate(docs).collect())
    monkeypatch.setattr(S, "FEW", 0)
    assert sorted(r.doc_id for r in S.deduplicate(docs).collect()) == few
    assert len(few) < docs.count()


def test_chain_of_links(spark):
    chain = [(i, i + 1) for i in range(60)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 61


def test_deduplicate_carries_maps(spark):
    """Maps, also inside structs and arrays, are carried along; rows that differ in a map alone are near copies, equal ones too."""
    rows = [(1, "one text of some words here", {"a": 1}, ({"b": None},)), (2, "one text of some words here", {"a": 2}, ({"b": 1},)), (3, "another text of other words", None, None), (3, "another text of other words", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string, int>, s struct<x: map<string, int>>").withColumn("l", F.array("m"))
    got = sorted(S.deduplicate(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.m, r.s and r.s.x, r.l) for r in got] == [(1, {"a": 1}, {"b": None}, [{"a": 1}]), (3, None, None, [None])]


def test_copies_are_linked_by_fingerprints(spark):
    """The pairs that the stage takes from the grid: components of all fingerprints at 2 or fewer bits."""
    words = [f"w{i}" for i in range(400)]
    rows = [" ".join(words[:at] + [f"edit{at}"] + words[at + 1 :]) for at in range(0, 400, 8)] + [" ".join(words), "", "quite another text of a few words"]
    distinct = S.shingle_sets(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).select("print", "n", "fp").collect()
    brute = brute_components([r.fp & S.MASK64 for r in distinct if r.n])
    found = {r.node: r.root for r in connected_components(S._fingerprint_pairs(spark.createDataFrame(distinct))).collect()}
    groups = {}
    for r in distinct:
        if r.n:
            groups.setdefault(brute[r.fp & S.MASK64], set()).add(found.get(r.print, r.print))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups) < len(distinct) - 2


def test_half_alike_family_is_not_paired_up(spark, monkeypatch):
    """120 texts that are one text with four words replaced each: no two are near copies, few are compared."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for g in range(120):
        words = list(base)
        for at in rng.choice(30, 4, replace=False):
            words[5 * int(at)] = f"edit{g}x{int(at)}"
        rows.append((g, " ".join(words)))
    rows += [(200, " ".join(base)), (201, " ".join(base[:-1] + ["end"]))]
    compared, similar = [], S._similar

    def counted(pairs, *more):
        compared.append(pairs.count())
        return similar(pairs, *more)

    monkeypatch.setattr(S, "_similar", counted)
    kept = sorted(r.doc_id for r in S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    sets = [S._shingles(t.encode(), 5) for _, t in rows]
    group = brute_groups(sets)
    assert kept == sorted(rows[i][0] for i in group)
    assert sum(compared) <= 8 * len(rows)


def brute_groups(sets):
    """The first of each group of sets of Jaccard similarity 0.8 or more."""
    group = list(range(len(sets)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                low, high = sorted((find(i), find(j)))
                group[high] = low
    return {find(i) for i in group}
