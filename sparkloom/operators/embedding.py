"""Embedding as a pluggable Arrow operator: any function of a list of texts can be the model."""

from __future__ import annotations

import hashlib
import re
import time
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from sparkloom.functions import lexicon as L

Embedder = Callable[[list[str]], np.ndarray]


def hashed_words(texts: list[str], width: int = 64) -> np.ndarray:
    """A deterministic stand-in for a model: signed counts of hashed words."""
    words = [t.lower().split() for t in texts]
    digest = {w: hashlib.blake2b(w.encode(), digest_size=8).digest() for w in set().union(*words)}
    h = np.frombuffer(b"".join([digest[w] for some in words for w in some]), "<u8")
    row = np.repeat(np.arange(len(texts)), [len(some) for some in words])
    cell = row * width + (h % np.uint64(width)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    return np.bincount(cell, sign, len(texts) * width).reshape(len(texts), width).astype(np.float32)


def embed(rows: DataFrame, embedder: Embedder = hashed_words, text_col: str = "text", out_col: str = "embedding", batch: int = 32) -> DataFrame:
    """rows with unit vectors of their texts, in batches; blank texts are embedded as a full stop, zero vectors stay.

    The vectors are a column of their own: who doesn't read it doesn't call the
    model.  It is marked as not deterministic so that filters on it don't call
    the model a second time.
    """

    @F.arrow_udf(ArrayType(FloatType()))
    def vectors(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts = [t if t and t.strip() else "." for t in column.to_pylist()]
            parts = [embedder(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            v = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            v = (v / np.where(size > 0, size, 1)).astype(np.float32)
            yield pa.array(list(v), pa.list_(pa.float32()))

    return rows.drop(out_col).withColumn(out_col, vectors.asNondeterministic()(text_col))


def embed_queries(queries: DataFrame, embedder: Embedder = hashed_words, text_col: str = "query", out_col: str = "query_vector") -> DataFrame:
    """Vectors of questions; a blank question fails the job."""
    checked = queries.where(F.when(F.coalesce(F.trim(text_col), F.lit("")) == "", F.raise_error(F.lit("a question is blank"))).otherwise(F.lit(True)).cast("boolean"))
    return embed(checked, embedder, text_col, out_col)


class Retrying:
    """An embedder that calls a remote model in batches, tries again after transient errors and keeps below a rolling cap of items a minute.

    delays are the seconds before each further try (none: fail at once, as for
    questions of waiting users).  now and sleep can be replaced in tests.  Each
    Python worker paces itself: give it its share of the cap.
    """

    def __init__(self, embedder: Embedder, batch: int = 16, delays: tuple[float, ...] = L.DOCUMENT_RETRY_SECONDS, per_minute: int | None = None, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.embedder, self.batch, self.delays, self.per_minute, self.now, self.sleep = embedder, batch, delays, per_minute, now, sleep
        self.sent: deque[tuple[float, int]] = deque()

    def _pace(self, items: int) -> None:
        while self.per_minute:
            at = self.now()
            while self.sent and at - self.sent[0][0] >= 60:
                self.sent.popleft()
            if not self.sent or sum(n for _, n in self.sent) + items <= self.per_minute:
                return
            self.sleep(max(0.25, 60.25 - (at - self.sent[0][0])))

    def _call(self, texts: list[str]) -> np.ndarray:
        for delay in (*self.delays, None):
            self._pace(len(texts))
            try:
                found = self.embedder(texts)
            except Exception as e:
                if delay is None or not any(mark in str(e).lower() for mark in L.RETRY_MARKS):
                    raise
                self.sleep(retry_seconds(str(e), delay))
                continue
            self.sent.append((self.now(), len(texts)))
            if len(found) != len(texts):
                raise RuntimeError(f"{len(found)} vectors for {len(texts)} texts")
            return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([self._call(texts[i : i + self.batch]) for i in range(0, len(texts), self.batch)]) if texts else np.zeros((0, 1), np.float32)


def retry_seconds(message: str, otherwise: float) -> float:
    """The longest delay that an error message asks for and a second more, but no less than `otherwise`."""
    said = [float(x) for pattern in L.RETRY_HINTS for x in re.findall(pattern, message, re.IGNORECASE)]
    return max(otherwise, max(said) + 1.0 if said else 0.0)


def try_embed(rows: DataFrame, embedder: Embedder = hashed_words, text_col: str = "query", out_col: str = "query_vector", error_col: str = "embedding_error", batch: int = 32) -> DataFrame:
    """rows with unit vectors of their texts and, where the embedder fails, a null vector and the name of its error.

    A batch that fails is tried text by text, so that only the texts at fault
    go without.  Blank texts are not embedded (error `blank`).
    """

    def one_by_one(texts: list[str]) -> Iterator[tuple[np.ndarray | None, str | None]]:
        try:
            found = embedder(texts)
            if len(found) != len(texts):
                raise RuntimeError(f"{len(found)} vectors for {len(texts)} texts")
            yield from ((v, None) for v in found)
        except Exception as e:  # whatever a model's client raises is a value here
            if len(texts) == 1:
                yield None, type(e).__name__
            else:
                for t in texts:
                    yield from one_by_one([t])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            there = [i for i, t in enumerate(texts) if t and t.strip()]
            out: list[list[float] | None] = [None] * len(texts)
            why: list[str | None] = ["blank"] * len(texts)
            for lo in range(0, len(there), batch):
                some = there[lo : lo + batch]
                for i, (v, error) in zip(some, one_by_one([texts[i].strip() for i in some])):
                    size = 0.0 if v is None else float(np.linalg.norm(v))
                    out[i], why[i] = None if v is None else (np.asarray(v, float) / (size or 1.0)).tolist(), error
            yield b.append_column(out_col, pa.array(out, pa.list_(pa.float32()))).append_column(error_col, pa.array(why, pa.string()))

    rest = rows.drop(out_col, error_col)
    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(out_col, ArrayType(FloatType())), StructField(error_col, StringType())]))
