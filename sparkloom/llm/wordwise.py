"""Public tokenizers, word by word.

A single space between two characters that are no white space begins a new
word.  Byte-level BPE with the usual pattern never joins characters across
that place, nor does a piece model without a piece that holds a space after
another character.  A text's tokens are then those of its words in order, and
each word needs encoding once.  Tokenizers of other kinds get the whole text
as their one word.

Models are handed to tasks as the bytes of their files, by a broadcast of a
few MB.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator

MARK = "▁"
GAP = re.compile(r"(?<=\S) (?=\S)")
#: A space that has white space or an end of the text beside it.
_ODD = re.compile(r" (?!\S)|(?<!\S) ")
#: Words in a generation of the cache; two generations are held.
CACHE_WORDS = 400_000
#: Longer words are forgotten at once.
CACHE_CHARS = 64
#: Characters of text that are tokenized together.
STRETCH = 1 << 21


def split(text: str) -> list[str]:
    """The text's words in order, without the single spaces between them."""
    return GAP.split(text) if _ODD.search(text) else text.split(" ")


class Words:
    """Ids of words as little-endian unsigned 32-bit numbers."""

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]], splits: bool):
        self.encode, self.splits = encode, splits
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.long: list[str] = []

    def cut(self, text: str) -> list[str]:
        return split(text) if self.splits else [text]

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """A table with the ids of all these words; good until the next call."""
        for w in self.long:
            del self.recent[w]
        if len(self.recent) > CACHE_WORDS:
            self.older, self.recent = self.recent, {}
        new = set(words).difference(self.recent)
        for w in new & self.older.keys():
            self.recent[w] = self.older[w]
            new.discard(w)
        asked = sorted(new)
        for w, ids in zip(asked, self.encode(asked)):
            self.recent[w] = struct.pack(f"<{len(ids)}I", *ids)
        self.long = [w for w in asked if len(w) > CACHE_CHARS]
        return self.recent


def stretches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about STRETCH characters; a longer text is a range of its own."""
    lo = size = 0
    for hi, t in enumerate(texts):
        if size and size + len(t) > STRETCH:
            yield lo, hi
            lo, size = hi, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _byte_level(raw: bytes) -> bool:
    """The tokenizer's file describes byte-level BPE that words can be cut for."""
    said = json.loads(raw)
    pre = said.get("pre_tokenizer") or {}
    model = said.get("model") or {}
    plain = said.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"])) for t in said.get("added_tokens") or [])
    return bool(plain and added and model.get("type") == "BPE" and not model.get("dropout"))


def alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the rest follows from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(shown)]
    return {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(rest)}


def by_ranks(raw: bytes) -> bool:
    """Merging by the ranks of joined tokens, as `tiktoken` does, gives the ids of the file's merges.

    It does if ids follow the order of the merges and each token's own
    characters merge to the two parts that its merge names: in a text, nothing
    crosses the ends of two neighbours before they are joined, so what is
    between them merged as it does alone.
    """
    said = json.loads(raw)
    vocab, merges = said["model"].get("vocab", {}), said["model"].get("merges", [])
    if not _byte_level(raw) or said["model"].get("ignore_merges") or set(alphabet()) - set(vocab):
        return False
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    rank = {p: i for i, p in enumerate(pairs)}
    first = len(vocab) - len(pairs)
    if len(rank) != len(pairs) or any(vocab.get(a + b) != first + i for i, (a, b) in enumerate(pairs)):
        return False
    for pair in pairs:
        parts = list("".join(pair))
        while len(parts) > 2:
            least, at = min((rank.get(p, len(pairs)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if least == len(pairs):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if tuple(parts) != pair:
            return False
    return True


def byte_tokenizer(raw: bytes, plain_specials: bool = False):
    """The tokenizer of a file's bytes, for one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(raw.decode())
    out.encode_special_tokens = plain_specials
    return out


def byte_words(raw: bytes, before: str = " ", plain_specials: bool = False, ranks: bool = False) -> Words:
    """Words of a byte-level tokenizer, encoded with what stands before them.

    plain_specials: strings of special tokens are ordinary text.  ranks: the
    file has passed `by_ranks`, and the faster library may encode.
    """
    if ranks:
        import public_tokenizers
        import tiktoken

        said, of = json.loads(raw), alphabet()
        table = {bytes(map(of.__getitem__, t)): i for t, i in said["model"]["vocab"].items()}
        added = {t["content"]: t["id"] for t in said.get("added_tokens") or []}
        coder = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)
        encode = coder.encode_ordinary if plain_specials or not added else lambda text: coder.encode(text, allowed_special="all")
        return Words(lambda words: (encode(before + w) for w in words), True)
    model = byte_tokenizer(raw, plain_specials)
    return Words(lambda words: (e.ids for e in model.encode_batch_fast([before + w for w in words], add_special_tokens=False)), _byte_level(raw))


def piece_model(raw: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=raw)


def piece_words(raw: bytes) -> Words:
    """Words of a piece model, each with the space before it that the model adds."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = piece_model(raw)
    spec = pb.ModelProto.FromString(raw).normalizer_spec
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    splits = not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
    splits = splits and not any(MARK in p.lstrip(MARK) for p in pieces)
    return Words(lambda words: model.encode(words, num_threads=1) if words else [], splits)


_kept: dict[tuple, Words] = {}


def kept(make: Callable[..., Words], raw: bytes, *args) -> Words:
    """The worker's own table for a model: later tasks of the worker find its words."""
    key = (make.__name__, hashlib.sha256(raw).digest(), *args)
    if key not in _kept:
        _kept[key] = make(raw, *args)
    return _kept[key]
