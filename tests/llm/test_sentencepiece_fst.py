from __future__ import annotations

import random
import struct

import pytest

from sparkloom.llm import sentencepiece_fst as P


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    with open(P.default_model(), "rb") as f:
        return P.Transducer(f.read()), sentencepiece.SentencePieceProcessor(model_file=P.default_model())


TEXTS = ["", " ", "  a  b ", "Hello, world!", "日本語 😀\n\ttabs", "a" * 300, "ab" * 500, "\x00\x01", "3.14159 + 1e9", "é" * 70, "   indent\n  more", "ﬁ ½ İ", "x▁y ▁ z"]


def test_ids_equal_the_library(both, docs):
    ours, lib = both
    random.seed(1)
    texts = TEXTS + [r.text for r in docs.collect()] + ["".join(random.choices("abcdefgh ▁\néß漢<>/", k=random.randint(1, 200))) for _ in range(300)]
    for t in texts:
        assert ours.encode(t) == lib.encode(t)
        assert ours.decode(ours.encode(t)) == lib.decode(lib.encode(t))


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(number, value):
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def model(pieces, kind, charsmap=b"", prefix=1, squeeze=1):
    """A model file's bytes; pieces are (text, score, type)."""
    out = b"".join(message(1, message(1, p.encode()) + message(2, float(s)) + message(3, k)) for p, s, k in pieces)
    out += message(2, message(3, kind) + (message(35, 1) if any(k == P.BYTE for _, _, k in pieces) else b""))
    return out + message(3, (message(2, charsmap) if charsmap else b"") + message(3, prefix) + message(4, squeeze) + message(5, 1))


SPECIAL = [("<unk>", 0.0, P.UNKNOWN), ("<s>", 0.0, P.CONTROL), ("</s>", 0.0, P.CONTROL)]


def same_as_library(raw, texts):
    import sentencepiece

    ours, lib = P.Transducer(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for t in texts:
        assert ours.encode(t) == lib.encode(t), (t, lib.encode(t, out_type=str))


def texts(alphabet, n=200, seed=3):
    rng = random.Random(seed)
    return ["", " ", "  a  b "] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(n)]


def test_shortest_paths_of_unigram_models():
    rng = random.Random(2)
    parts = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "▁", "▁a", "▁ab", "é", "cé", "a▁b"]
    for trial in range(8):
        pieces = SPECIAL + [(p, rng.uniform(-5, -1), P.NORMAL) for p in parts if p != "b" or trial % 2]
        same_as_library(model(pieces, P.UNIGRAM), texts("abc éz"))


def test_bytes_instead_of_the_unknown_piece():
    pieces = SPECIAL + [(f"<0x{b:02X}>", 0.0, P.BYTE) for b in range(256)] + [(p, -i - 1.0, P.NORMAL) for i, p in enumerate(["ab", "bc", "▁a", "a", "b", "▁"])]
    same_as_library(model(pieces, P.BPE), texts("abc é漢😀"))


def test_user_defined_pieces_come_first():
    merges = ["ab", "abc", "▁a", "cd", "a", "b", "c", "d", "▁"]
    pieces = SPECIAL + [("<user>", 0.0, P.USER), ("bcd", 0.0, P.USER)] + [(p, -i - 1.0, P.NORMAL) for i, p in enumerate(merges)]
    same_as_library(model(pieces, P.BPE), [*texts("abcd "), "a<user>b", "<user>", "x abcd<user><user> bcd", "abcdbcd"])


def test_character_maps(both, docs):
    """The map that the library makes of a public normalisation, put into the public model."""
    import sentencepiece

    if not hasattr(sentencepiece, "SentencePieceNormalizer"):
        pytest.skip("this version of the library has no normaliser")
    for rule in ("nmt_nfkc", "nfkc_cf"):
        made = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        spec = dict(P._fields(dict(P._fields(made.serialized_model_proto()))[3]))
        ours, _ = both
        raw = model([(p, s, k) for p, s, k in ours.pieces], P.BPE, charsmap=spec[2], squeeze=0)
        tricky = ["ﬁ ½ İ ℡ ①", "e\u0301 A\u030a が\u3099 ｶﾞ", "ＡＢＣ　ｄ", "\u200b\ufeffx\u00a0y\tz\n", "한글 각", "Straße GROSS", "a\u0300b"]
        same_as_library(raw, tricky + [r.text for r in docs.limit(60).collect()] + texts("aé\u0301ﬁ １漢\u3099か ", 100))


def test_trie_states():
    t = P.Trie({"ab": 7, "abc": 8, "b": 9})
    state = t.next[t.next[0]["a"]]["b"]
    assert t.final[state] == 7 and t.final[t.next[state]["c"]] == 8 and t.final[t.next[0]["a"]] == -1


def test_round_trip_of_the_table(docs):
    got = P.encode_digest(docs).toPandas()
    assert len(got) == docs.count() and got["round_trip"].all()


def test_odd_rows(odd_docs, no_docs):
    got = P.encode_digest(odd_docs).toPandas()
    assert len(got) == 9 and (got[got["doc_id"].isin([2, 3])]["n_tokens"] == 0).all()
    tokens = P.decode(P.encode(odd_docs))
    assert set(tokens.columns) == {*odd_docs.columns, "decoded"}
    for r in tokens.collect():
        assert r.decoded == r.text and (r.ids is None) == (r.text is None)
    assert P.encode(odd_docs, decoded_col="decoded").select(*tokens.columns).collect() == tokens.collect()
    assert P.encode_digest(no_docs).count() == 0 and P.encode(no_docs).count() == 0
