from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import packing, wordwise

END = np.array([0], "<u4").tobytes()


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def raw():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


def expected(model, docs, size):
    """Pieces of each document, one tokenizer call a text."""
    out = Counter()
    for doc, text in docs:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        at, piece = 0, 0
        while at < len(ids):
            n = size if at else len(ids) % size or size
            out[doc, piece, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at, piece = at + n, piece + 1
    return out


def check(model, docs, rows, size):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected(model, docs, size)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return len(by)


def brute(lengths, size):
    """Sequences by the rule itself: every open gap and a new sequence are tried, sums of squares formed anew."""
    gaps: list[int] = []
    out = []
    for n in lengths:
        tries = []
        for g in sorted({*(g for g in gaps if g >= n)} | {size}):
            after = Counter(gaps)
            if g < size or size in after:
                after[g] -= g < size
            after[g - n] += 1
            tries.append((sum(c * c for h, c in after.items() if 0 < h < size), g == size, g))
        g = min(tries)[2]
        if g < size:
            gaps.remove(g)
        gaps.append(g - n)
        out.append(g)
    return out, gaps


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(4, 40), st.integers(1, 60))
def test_placements_follow_the_rule(seed, size, n):
    r = random.Random(seed)
    lengths = [r.randint(1, size - 1) for _ in range(n)]
    packer = packing.Packer(size)
    gaps = []
    for length in lengths:
        before = list(packer.fill)
        k, at = packer.place(length)
        gaps.append(size - at)
        assert at == (before[k] if k < len(before) else 0)
    want, left = brute(lengths, size)
    assert gaps == want
    assert sorted(size - f for f in packer.fill) == sorted(left)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "a", "it's", "Über", "日本", " ", "　", "<|endoftext|>", "12", "...", "\t", "é", "\x1c", "x "]), max_size=12))
def test_words_give_the_ids_of_the_text(model, raw, parts):
    text = "".join(parts)
    assert wordwise.split(text) == wordwise.GAP.split(text)
    for ranks in (False, True):
        heads, words = (wordwise.kept(wordwise.byte_words, raw, before, False, ranks) for before in ("", " "))
        first, *rest = words.cut(text)
        ids = heads.learn([first])[first] + b"".join(map(words.learn(rest).__getitem__, rest))
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aeinrst-= .\n'1é日", max_size=40))
def test_ranks_give_the_ids_of_the_merges(model, raw, text):
    words = wordwise.kept(wordwise.byte_words, raw, "", False, True)
    assert [*words.encode([text])][0] == model.encode(text, add_special_tokens=False).ids


def test_ranks_are_only_used_where_they_follow_the_merges(raw):
    import json

    assert wordwise.by_ranks(raw)
    said = json.loads(raw)
    merges = said["model"]["merges"]
    merges[0], merges[1] = merges[1], merges[0]
    assert not wordwise.by_ranks(json.dumps(said).encode())
    # "abc" is named as a + bc, yet its characters merge to ab + c first
    chars = {c: i for i, c in enumerate(wordwise.alphabet())}
    small = {"pre_tokenizer": {"type": "ByteLevel"}, "model": {"type": "BPE", "vocab": chars | {"ab": 256, "bc": 257, "abc": 258}, "merges": [["a", "b"], ["b", "c"], ["a", "bc"]]}}
    assert not wordwise.by_ranks(json.dumps(small).encode())
    small["model"]["merges"][2] = ["ab", "c"]
    assert wordwise.by_ranks(json.dumps(small).encode())


def test_the_cache_forgets_and_stays_right(model, raw, monkeypatch):
    monkeypatch.setattr(wordwise, "CACHE_WORDS", 3)
    words = wordwise.byte_words(raw)
    for k in range(30):
        asked = [f"w{(k * 7 + j) % 11}" for j in range(3)] + ["y" * 100]
        table = words.learn(asked)
        assert all(np.frombuffer(table[w], "<u4").tolist() == model.encode(f" {w}", add_special_tokens=False).ids for w in asked)
    assert len(words.recent) < 12


def test_documents_are_packed_whole(spark, docs, model):
    rows = packing.packed(docs).collect()
    mine = [(r.doc_id, r.text) for r in docs.collect()]
    used = check(model, mine, rows, packing.MAX_TOKENS)
    bound = -(-sum(r.length for r in rows) // packing.MAX_TOKENS)
    assert used <= 1.06 * bound + 1


def test_odd_rows(spark, odd_docs, model):
    rows = packing.packed(odd_docs, max_tokens=64).collect()
    check(model, [(r.doc_id, r.text) for r in odd_docs.collect()], rows, 64)


def test_no_rows(no_docs):
    out = packing.packed(no_docs)
    assert out.count() == 0
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_many_shards_leave_little_open(spark):
    """Levels of shards end with few more sequences than the tokens need; the same table packs the same way again."""
    length = "CAST(least(127, 1 + floor(exp(3 + randn(5)))) AS LONG) AS length"
    rows = spark.range(0, 20_000, 1, 1).selectExpr("id AS row", "id AS doc_id", "0 AS piece", "0L AS start", length, "0L AS ids_crc32")
    out = packing.pack(rows, 128, shard_pieces=1500)
    got = {r.row: (r.sequence_id, r.offset) for r in out.collect()}
    assert len(got) == 20_000
    bound = -(-sum(r.length for r in rows.collect()) // 128)
    assert len({s for s, _ in got.values()}) <= 1.01 * bound
    assert got == {r.row: (r.sequence_id, r.offset) for r in packing.pack(rows.repartition(5), 128, shard_pieces=1500).collect()}


def test_pieces_that_cannot_fill_a_sequence(spark):
    rows = spark.range(5000).selectExpr("id AS row", "id AS doc_id", "0 AS piece", "0L AS start", "if(id % 2 = 0, 60L, 70L) AS length", "0L AS ids_crc32")
    out = packing.pack(rows, 100, shard_pieces=700).collect()
    assert len({r.sequence_id for r in out}) == 5000 and {r.offset for r in out} == {0}


def test_sequences_hold_the_ids(spark, docs):
    some = docs.orderBy("doc_id").limit(40)
    cut = packing.pieces(some, max_tokens=256, with_ids=True)
    seqs = {r.sequence_id: r for r in packing.sequences(cut, 256).collect()}
    for r in packing.pack(cut, 256).collect():
        ids = seqs[r.sequence_id].ids[r.offset : r.offset + r.length]
        assert r.offset in seqs[r.sequence_id].starts and len(seqs[r.sequence_id].ids) <= 256
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
