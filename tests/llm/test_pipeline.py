from __future__ import annotations

import re

import corpus_pipeline
from pyspark.sql import functions as F
from sparkloom.llm import mixing, pii, quality, sentencepiece_fst

STAGES = dict(corpus_pipeline.STAGES)


def written(spark, frame, schema):
    """A stage's result as the next one reads it."""
    return spark.createDataFrame(frame.collect(), schema)


def good_by_brute_force(rows):
    """Base rules by plain counts, then outliers of each language and source by random starts."""
    import numpy as np
    from test_quality import brute, reweighted

    counts = {r.doc_id: brute(r.text) for r in rows}
    passed = [r for r in rows if counts[r.doc_id][0] >= 50 and 100 * counts[r.doc_id][4] <= 50 * counts[r.doc_id][0]]
    lines = {r.doc_id: sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in r.text.split("\n")) for r in passed}
    vector = {}
    for r in passed:
        words, chars, symbols, dup, repeat = counts[r.doc_id]
        raw = np.array([np.log(chars / words), min((symbols / words) ** 0.5, 4.0), (dup / lines[r.doc_id]) ** 0.5, (repeat / words) ** 0.5]) / 0.001
        vector[r.doc_id] = np.floor(np.abs(raw) + 0.5) * np.sign(raw)
    pools: dict[object, list] = {}
    for r in passed:
        for pool in ((r.lang, r.source), r.lang, None):
            pools.setdefault(pool, []).append(r.doc_id)
    distance: dict[object, dict] = {}
    for pool, ids in pools.items():
        if len(ids) >= 50 or pool is None:
            distance[pool] = dict(zip(ids, reweighted(np.array([vector[i] for i in ids]), 120)))
    judge = lambda r: next(distance[p] for p in ((r.lang, r.source), r.lang, None) if p in distance)[r.doc_id]
    return {r.doc_id: judge(r) for r in passed}


def kept_by_brute_force(rows):
    """Smallest id of each group of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = {}
    for r in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower())
        sets[r.doc_id] = frozenset(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else frozenset([tuple(words)] if words else [])
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                group[high] = low
    return {find(i) for i in ids}


def test_each_stage_matches_brute_force(spark, sf, docs):
    assert list(STAGES) == ["quality rules", "near duplicates", "personal data", "source mixing", "sentencepiece"]
    good = STAGES["quality rules"](spark, docs, sf)
    assert good.dtypes == docs.dtypes
    far = good_by_brute_force(docs.collect())
    rows = good.collect()
    kept = {r.doc_id for r in rows}
    clear = {i for i, d in far.items() if not 0.9 * quality.FAR < d < 1.1 * quality.FAR}  # near the cutoff another start may decide
    assert len(rows) == len(kept) and kept <= set(far) and len(clear) > 0.9 * len(far)
    assert kept & clear == {i for i in clear if far[i] <= quality.FAR}

    good = written(spark, good, docs.schema)
    single = STAGES["near duplicates"](spark, good, sf)
    assert single.dtypes == docs.dtypes
    texts = {r.doc_id: r.text for r in rows}
    left = single.collect()
    assert sorted(r.doc_id for r in left) == sorted(kept_by_brute_force(rows)) and all(r.text == texts[r.doc_id] for r in left)

    single = written(spark, single, docs.schema)
    clean = STAGES["personal data"](spark, single, sf)
    assert clean.dtypes == docs.dtypes
    weights = pii.train(single)
    for r in clean.collect():
        text = texts[r.doc_id]
        spans = sorted({(lo, hi, k) for k, lo, hi in (*pii.base_spans(text), *pii.decode(text, pii.base_spans(text), weights))}, key=lambda s: (s[0], pii.KINDS.index(s[2])))
        out, end = "", 0
        for lo, hi, kind in spans:
            if lo >= end:
                out += f"{text[end:lo]}[{kind.upper()}]"
            end = max(end, hi)
        assert r.text == out + text[end:] and r.n_chars == len(r.text)

    clean = written(spark, clean, docs.schema)
    mix = STAGES["source mixing"](spark, clean, sf)
    assert mix.dtypes == docs.dtypes
    own = {r.doc_id: r.text for r in clean.collect()}
    m = mixing.mix(clean)  # words taken, by plain loops over slots and places
    times: dict[tuple, int] = {}
    for r in m.slots.collect():
        times[r.s, r.block] = times.get((r.s, r.block), 0) + 1
    length = {p.index: p.block_words for p in m.plan}
    taken = {r.doc_id: sum(times.get((r.s, at // length[r.s]), 0) for at in range(r.start, r.start + r["size"])) for r in m.docs.collect()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    got: dict[int, int] = {}
    for r in mix.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
        here = iter(words(own[r.doc_id]))
        assert all(w in here for w in words(r.text)) and r.n_chars == len(r.text)  # words of the document, in order
    assert got == {i: n for i, n in taken.items() if n}

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_model())
    mix = written(spark, mix, docs.schema)
    texts_in = sorted((r.doc_id, r.text) for r in mix.collect())
    tokens = STAGES["sentencepiece"](spark, mix, sf).collect()
    assert sorted((r.doc_id, r.decoded) for r in tokens) == texts_in
    assert all(r.ids == lib.encode(r.decoded) and r.n_tokens == len(r.ids) for r in tokens)


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(r.n_tokens == len(r.ids) and r.n_chars == len(r.decoded) for r in rows)


def test_empty_and_odd_tables(spark, sf, odd_docs, no_docs):
    """With columns of names that operators use inside as well."""
    more = {n: F.lit(1) for n in ("__key", "__h", "__parts", "__own", "key", "own", "kept", "nth", "items", "print", "row", "rest", "root", "pool", "n")}
    for frame in (odd_docs, odd_docs.withColumns(more), no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf)
            rows = out.collect()
            assert name == "sentencepiece" or out.columns == frame.columns
            assert (len(rows) == frame.count()) if name in ("personal data", "sentencepiece") else len(rows) <= 3 * frame.count()
