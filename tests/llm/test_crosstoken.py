from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import crosstoken as C
from sparkloom.llm import wordwise


@pytest.fixture(scope="module")
def models():
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    byte.encode_special_tokens = True
    return byte, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(models, text):
    """A's and B's (id, end), over the whole text, or None."""
    byte, piece = models
    raw = b" " + text.encode()
    of = wordwise.alphabet()
    a = [(i, bytes(of[c] for c in byte.id_to_token(i))) for i in byte.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in piece.encode(text):
        p = piece.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if piece.is_byte(i) else p.replace("▁", " ").encode()))
    if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return None
    ends = []
    for side in (a, b):
        at, out = 0, []
        for i, x in side:
            at += len(x)
            out.append((i, at))
        ends.append(out)
    return ends


def brute(models, docs):
    found = [(doc, tokens(models, text or "")) for doc, text in docs]
    links = [[(i, j) for i, e in t[0] for j, f in t[1] if e == f] if t and len(t[0]) < 400 else _fast(t) if t else [] for _, t in found]
    counts = Counter(x for own in links for x in own)
    most: dict[int, int] = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for (doc, t), own in zip(found, links):
        if not t:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for _, e in t[0]} & {e for _, e in t[1]})
        parts, lo = [], 0
        for c in cuts:
            parts.append("|".join(",".join(str(i) for i, e in side if lo < e <= c) for side in t) if len(cuts) < 400 else (lo, c))
            lo = c
        if len(cuts) >= 400:
            parts = _parts(t, cuts)
        out.append((doc, len(t[0]), len(t[1]), len(cuts), len(own), sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), hashlib.sha256(";".join(parts).encode()).hexdigest()))
    return sorted(map(repr, out))


def _fast(t):
    at = {f: j for j, f in t[1]}
    return [(i, at[e]) for i, e in t[0] if e in at]


def _parts(t, cuts):
    import bisect

    rows = [([], []) for _ in cuts]
    for k, side in enumerate(t):
        for i, e in side:
            rows[bisect.bisect_left(cuts, e)][k].append(str(i))
    return ["|".join(",".join(x) for x in r) for r in rows]


def shown(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted(repr(tuple(r[c] for c in names)) for r in df.collect())


def test_query_equals_brute_force(spark, docs, models):
    some = docs.where("length(text) < 20000")
    assert shown(C.aligned(some)) == brute(models, [(r.doc_id, r.text) for r in some.collect()])


def test_odd_rows(spark, odd_docs, models):
    strange = [(20, "a▁b c"), (21, "x▁ y"), (22, "tab\tand  two spaces "), (23, " begins"), (24, "日本語 のテキスト"), (25, "<|endoftext|> </s> <0x41> <unk>"), (26, "🙂 \u0000 ​"), (27, "Ünïcode é"), (28, "▁"), (29, "same same same"), (30, "\n"), (31, " "), (32, "x" * 3000)]
    extra = spark.createDataFrame(strange, "doc_id long, text string").withColumns({"word": F.lit("w"), "block": F.lit(1), "nos": F.create_map(F.lit("a"), F.lit(1))})
    frame = odd_docs.select("doc_id", "text", F.lit("w").alias("word"), F.lit(1).alias("block"), F.create_map(F.lit("a"), F.lit(1)).alias("nos")).unionByName(extra)
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    assert shown(C.aligned(frame)) == brute(models, rows)


def test_no_rows(no_docs):
    assert C.aligned(no_docs).count() == 0


def test_small_blocks_and_joined_counts_agree(spark, docs, models, monkeypatch):
    some = docs.where("doc_id < 60")
    whole = shown(C.aligned(some))
    monkeypatch.setattr(C, "BROADCAST_PAIRS", 1)
    assert shown(C.aligned(some)) == whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "ab", "it's", "Über", "日本", " ", "<s>", "▁", "12", "...", "é"]), max_size=10))
def test_pieces_of_words_are_those_of_the_text(models, parts):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        words = wordwise.kept(wordwise.piece_words, f.read())
    text = "".join(parts)
    cut = words.cut(text)
    assert words.splits
    if text and "▁" not in text:
        assert [i for w in words.encode(cut) for i in w] == models[1].encode(text)


def test_tokens_bytes(models):
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        table = C.byte_tokens(f.read())
    assert len(set(wordwise.alphabet().values())) == 256
    for text in ("héllo wörld", " 日本 12"):
        ids = models[0].encode(text, add_special_tokens=False).ids
        assert b"".join(table[i] for i in ids) == text.encode()


def test_align_on_any_units(spark):
    """The relational part alone, on tables of tokens: ends, cuts, groups."""
    rows = [("x", [1, 2, 3], [2, 1, 3], [7, 8, 9], [3, 1, 2]), ("y", [4], [5], [5], [5]), ("z", [1, 1], [1, 1], [6], [3])]
    units = spark.createDataFrame(rows, "doc string, a array<int>, al array<int>, b array<int>, bl array<int>")
    got = C.align(C.token_ends(units, "doc", "a", "al"), C.token_ends(units, "doc", "b", "bl"), "doc").collect()
    assert sorted((r.doc, r.grp, r.a_from, r.a_to, r.b_from, r.b_to, r.a, r.b) for r in got) == [("x", 0, 0, 1, 0, 0, 2, 7), ("x", 1, 2, 2, 1, 2, 3, 9), ("y", 0, 0, 0, 0, 0, 4, 5)]
