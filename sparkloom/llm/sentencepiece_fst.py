"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled to transducers, tables of states with arcs by symbol:
the normaliser (the model's character map, a state of its trie for each byte
read; white space states for the dummy prefix, repeated spaces and the space
mark), the pieces (a trie whose accepting states put out a piece and go back to
the start) and byte fallback (an arc for every character that no piece covers,
putting out its bytes).  An input is composed with them lazily: the normaliser
is deterministic, so its composition with an input is one string; states of the
composition with the pieces are pairs of a position and a state of the piece
trie, with the piece that led to the position, and the tropical-semiring
shortest path from the first position to the last is the encoding.

Arc weights follow the model's type.  In a unigram model a piece weighs minus
its score.  A byte-pair model's encoding is not the path of largest score; but
a sequence of pieces is what merging yields exactly if every pair of neighbours
is (merging the two's joined text gives the two back).  So the pieces are
composed with one more machine, whose states are the pieces and whose arcs
weigh 0 if a piece may follow another and infinity if not: one path of finite
weight is left, and it is the model's encoding.  User-defined pieces are read
before anything else, whatever stands around them.

Where no piece has the space mark behind another character, the composition
passes its first state anew at each run of marks that follows a word; the paths
of such chunks are joined, and those of chunks met before are remembered.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Penalty of an unknown character in a unigram model, below the lowest score.
UNKNOWN_PENALTY = 10.0
#: Chunks remembered by a worker, twice: about 250 bytes each.
CACHE_CHUNKS = 300_000


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = raw[at]
            at += 1
            n |= (byte & 127) << shift
            if byte < 128:
                return n
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            at += size
            yield key >> 3, raw[at - size : at]
        else:
            size = 4 if kind == 5 else 8
            at += size
            yield key >> 3, struct.unpack("<f" if kind == 5 else "<d", raw[at - size : at])[0]


class Trie:
    """A transducer of strings: next[state] gives the state after a symbol, final[state] what is put out there (-1: nothing)."""

    def __init__(self, strings: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        for string, out in strings.items():
            state = 0
            for symbol in string:
                to = self.next[state].get(symbol)
                if to is None:
                    to = self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.final.append(-1)
                state = to
            self.final[state] = out


class CharacterMap:
    """A model's map of character sequences, as it stands in the file: a double-array trie over bytes and the strings that its states put out."""

    def __init__(self, raw: bytes):
        size = struct.unpack_from("<I", raw)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", raw, 4)
        self.strings = raw[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Output and length of the longest sequence of the map that stands at a place."""
        units, found = self.units, None
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        state = step(units[0])
        for i in range(at, len(text)):
            state ^= text[i]
            unit = units[state] if state < len(units) else 0
            if unit & 0x800000FF != text[i]:
                break
            state ^= step(unit)
            if unit >> 8 & 1:
                lo = units[state] & 0x7FFFFFFF
                found = self.strings[lo : self.strings.index(b"\0", lo)], i + 1 - at
        return found

    def apply(self, text: str) -> str:
        """The text with each longest sequence replaced; characters outside the map stay."""
        raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
        while at < len(raw):
            found = self.longest(raw, at)
            if found:
                out.append(found[0])
                at += found[1]
            else:
                end = at + 1
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end += 1
                out.append(raw[at:end])
                at = end
        return b"".join(out).decode("utf-8", "surrogatepass")


#: Stretches that a character map may change: anything beyond letters, digits and marks of ASCII, and a character before it, which it may combine with.
_MAPPED = re.compile(r"[!-~]?[^!-~]+")


class Transducer:
    """Encoder and decoder compiled from the bytes of a model file."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for number, value in _fields(raw):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.map = CharacterMap(normalizer[2]) if normalizer.get(2) else None
        plain = self.map is None or all(self.map.apply(chr(c)) == chr(c) for c in range(33, 127))
        self.mapped = _MAPPED if plain else re.compile(r"[\s\S]+")  # a map that folds case changes letters too
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("word and character models aren't supported")
        self.add_prefix, self.squeeze, self.escape = (bool(normalizer.get(k, 1)) for k in (3, 4, 5))
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.user = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == USER}
        self.split = re.compile("|".join(map(re.escape, sorted(self.user, key=len, reverse=True)))) if self.user else None
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)
        self.score = [s for _, s, _ in self.pieces]
        self.chunked = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.lowest = min((s for p, s, k in self.pieces if k == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.trie = Trie(self.ids)
        self.pairs: dict[int, bool] = {}
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.raw = [bytes([self.byte_of[i]]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" if k == CONTROL else p.encode() for i, (p, _, k) in enumerate(self.pieces)]

    def _mapped(self, text: str) -> str:
        if self.map is None:
            return text
        if not self.split:
            return self.mapped.sub(lambda m: self.map.apply(m[0]), text)
        out, at = [], 0  # user-defined pieces are not normalised
        for m in self.split.finditer(text):
            out += [self.mapped.sub(lambda m: self.map.apply(m[0]), text[at : m.start()]), m[0]]
            at = m.end()
        return "".join([*out, self.mapped.sub(lambda m: self.map.apply(m[0]), text[at:])])

    def normalise(self, text: str) -> str:
        """What the normaliser's transducers put out for a text."""
        if not text:
            return ""
        text = self._mapped(text)
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if self.add_prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    def _merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging the neighbours whose joined piece scores most, leftmost first."""
        part = list(text)
        while True:
            best = None
            for i in range(len(part) - 1):
                at = self.ids.get(part[i] + part[i + 1])
                if at is not None and (best is None or self.score[at] > best[0]):
                    best = self.score[at], i
            if best is None:
                return part
            part[best[1] : best[1] + 2] = [part[best[1]] + part[best[1] + 1]]

    def _follows(self, left: int, right: int) -> bool:
        """Merging keeps the two pieces apart as they are; a left of -1 is the beginning."""
        key = (left + 1) * len(self.pieces) + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            parts = [self.pieces[right][0]] if left < 0 else [self.pieces[left][0], self.pieces[right][0]]
            known = self.pairs[key] = self._merge("".join(parts)) == parts
        return known

    def _bpe_path(self, chunk: str) -> list[int]:
        """Ids along the only path of finite weight. A character without a piece is an arc of its own, -1 minus its code point."""
        n, pairs, width = len(chunk), self.pairs, len(self.pieces)
        after, final = self.trie.next, self.trie.final
        begin = [-1] * (n + 1)
        last = [-1] * (n + 1)
        begin[0] = 0
        for lo in range(n):
            if begin[lo] < 0:
                continue
            left = last[lo] if last[lo] >= 0 else -1  # nothing merges across a character without a piece
            state, hi = 0, lo
            while hi < n:
                state = after[state].get(chunk[hi])
                if state is None:
                    break
                hi += 1
                at = final[state]
                if at >= 0 and begin[hi] < 0:
                    fits = pairs.get((left + 1) * width + at)
                    if fits if fits is not None else self._follows(left, at):
                        begin[hi], last[hi] = lo, at
            if begin[lo + 1] < 0 and chunk[lo] not in self.ids:  # a character that only begins longer pieces
                begin[lo + 1], last[lo + 1] = lo, -1 - ord(chunk[lo])
        return self._back(begin, last)

    def _unigram_path(self, chunk: str) -> list[int]:
        """Ids along the path of least weight."""
        n, after, final = len(chunk), self.trie.next, self.trie.final
        weight = [0.0] + [float("inf")] * n
        begin, last = [0] * (n + 1), [-1] * (n + 1)
        for lo in range(n):
            state, hi, single = 0, lo, False
            while hi < n and (state := after[state].get(chunk[hi])) is not None:
                hi += 1
                at = final[state]
                if at >= 0:
                    single |= hi == lo + 1
                    total = weight[lo] - self.score[at]
                    if total < weight[hi]:
                        weight[hi], begin[hi], last[hi] = total, lo, at
            if not single and weight[lo] - self.lowest < weight[lo + 1]:
                weight[lo + 1], begin[lo + 1], last[lo + 1] = weight[lo] - self.lowest, lo, -1 - ord(chunk[lo])
        return self._back(begin, last)

    @staticmethod
    def _back(begin: list[int], last: list[int]) -> list[int]:
        out, n = [], len(begin) - 1
        while n:
            out.append(last[n])
            n = begin[n]
        return out[::-1]

    def _covered(self, path: list[int]) -> Iterator[int]:
        """The path with byte fallback; without bytes, a run of unknown characters is one unknown piece."""
        before = 0
        for p in path:
            if p >= 0:
                yield p
            elif self.bytes or before >= 0:
                yield from self._fallback(-1 - p)
            before = p

    def _fallback(self, code: int) -> list[int]:
        """Ids for a character without a piece."""
        if self.bytes:
            return [self.bytes[b] for b in chr(code).encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        out = self.older.get(chunk)
        if out is None:
            path = self._bpe_path(chunk) if self.kind == BPE else self._unigram_path(chunk)
            out = tuple(path) if min(path) >= 0 else tuple(self._covered(path))
        if len(chunk) <= 64:
            if len(self.recent) >= CACHE_CHUNKS:
                self.older, self.recent = self.recent, {}
            self.recent[chunk] = out
        return out

    def encode(self, text: str) -> list[int]:
        """Piece ids of the text."""
        text = self.normalise(text)
        if not self.split:
            return self._stretch(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [*self._stretch(text[at : m.start()]), self.user[m[0]]]
            at = m.end()
        return out + self._stretch(text[at:])

    def _stretch(self, text: str) -> list[int]:
        """Ids of a normalised text without user-defined pieces."""
        if not text:
            return []
        if not self.chunked:
            return list(self._chunk(text))
        out: list[int] = []
        extend = out.extend
        words = text.split(MARK)
        marks = 0
        if words[0]:
            extend(self.recent.get(words[0]) or self._chunk(words[0]))
        for w in words[1:]:
            marks += 1
            if w:
                chunk = MARK * marks + w if marks > 1 else MARK + w
                extend(self.recent.get(chunk) or self._chunk(chunk))
                marks = 0
        if marks:
            extend(self.recent.get(MARK * marks) or self._chunk(MARK * marks))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; runs of byte pieces are UTF-8, invalid ones become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        if self.escape:
            text = text.replace(MARK, " ")
        return text[1:] if self.add_prefix and text.startswith(" ") else text


def default_model() -> str:
    """The public byte-pair model with byte fallback that is installed with the tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_LOADED: dict[str, Transducer] = {}


def _transducer(key: str, raw: bytes) -> Transducer:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Transducer(raw)
    return _LOADED[key]


def _model(spark, path: str | None):
    """The model file's bytes, half a megabyte, broadcast: executors need not see the driver's path."""
    with open(path or default_model(), "rb") as f:
        raw = f.read()
    return hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)


#: Rows whose lists of ids are held at a time.
SLICE_ROWS = 256


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(i, SLICE_ROWS)


def encode(docs: DataFrame, model: str | None = None, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """docs with the piece ids of the text and, if asked for, the text that they decode to.

    A null text has null ids, an empty one none.  All rows and columns stay; a
    column of a new one's name is replaced.
    """
    key, raw = _model(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(key, raw.value)
        for b in _slices(batches):
            ids = [None if (x := v.as_py()) is None else t.encode(x) for v in b.column(text_col)]
            rest = b.select([c for c in b.schema.names if c not in new])
            rest = rest.append_column(out_col, pa.array(ids, pa.list_(pa.int32())))
            if decoded_col:
                rest = rest.append_column(decoded_col, pa.array([None if x is None else t.decode(x) for x in ids], pa.string()))
            yield rest

    new = {out_col, decoded_col}
    fields = [f for f in docs.schema.fields if f.name not in new] + [StructField(out_col, ArrayType(IntegerType()))]
    if decoded_col:
        fields.append(StructField(decoded_col, StringType()))
    return docs.mapInArrow(run, StructType(fields))


def decode(tokens: DataFrame, model: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """tokens with the text of the ids; null ids have a null text. All rows and columns stay; a column of the new one's name is replaced."""
    key, raw = _model(tokens.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(key, raw.value)
        for b in _slices(batches):
            texts = [None if (x := v.as_py()) is None else t.decode(x) for v in b.column(ids_col)]
            yield b.append_column(out_col, pa.array(texts, pa.string()))

    rest = tokens.drop(out_col)
    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(out_col, StringType())]))


def encode_digest(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (hex, of the ids joined by commas), round_trip.

    round_trip says that decoding gives the text back.  Null and empty texts
    have no tokens; null ids and repeated rows keep their rows; other columns
    are ignored; an empty table gives no rows.
    """
    key, raw = _model(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(key, raw.value)
        written = [str(i) for i in range(len(t.pieces))]
        for b in batches:
            n, digests, same = [], [], []
            for v in b.column(1):
                text = v.as_py() or ""
                ids = t.encode(text)
                n.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(written.__getitem__, ids)).encode()).hexdigest())
                same.append(t.decode(ids) == text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")
