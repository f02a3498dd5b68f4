"""Corpus fingerprints, manifests and their checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined_digests(rows: DataFrame, name_col: str, order_col: str, text_col: str) -> DataFrame:
    """(name, digest): SHA-256 of each name's texts in order, joined by newlines. A digest reads its texts one after the other, in one task. Null texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["name", "digest"])

        name, digest = None, None
        for b in batches:
            for this, text in zip(b.column(0), b.column(1).cast(pa.large_binary())):
                if digest is None or this.as_py() != name:
                    if digest is not None:
                        yield out()
                    name, digest = this.as_py(), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(text.as_py())
        if digest is not None:
            yield out()

    said = rows.where(F.col(text_col).isNotNull()).select(F.col(name_col).cast("string").alias("name"), F.col(order_col).alias("at"), F.col(text_col).cast("string").alias("text"))
    return said.repartition("name").sortWithinPartitions("name", "at", "text").select("name", "text").mapInArrow(run, "name string, digest string")


def corpus_hash(files: DataFrame) -> DataFrame:
    """One row: SHA-256 over name, NUL and digest of every file, by lower-cased name. One short line for each file meets in one place."""
    line = F.concat("name", F.lit("\x00"), "digest")
    lines = files.agg(F.sort_array(F.collect_list(F.struct(F.lower("name").alias("k"), line.alias("line")))).alias("x"))
    return lines.select(F.sha2(F.concat(F.array_join(F.transform("x", lambda s: s["line"]), "\n"), F.lit("\n")), 256).alias("corpus_hash"))


def catalog_hash(catalog: DataFrame) -> DataFrame:
    """One row: SHA-256 over the sorted checksums of a catalog."""
    return catalog.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("checksum")), ""), 256).alias("corpus_hash"))


def index_manifest(chunks: DataFrame, chars_col: str) -> DataFrame:
    """Chunks and characters of each document."""
    return chunks.groupBy("document_name").agg(F.count("*").alias("n_chunks"), F.sum(chars_col).cast("long").alias("chars"))


def verify_checksums(listed: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Listed rows (expected) whose stored checksum is missing or differs, with the issue."""
    met = listed.join(stored.select(key, "checksum"), key, "left")
    issue = F.when(F.col("checksum").isNull(), "missing").when(F.col("checksum") != F.col("expected"), "checksum_mismatch")
    return met.withColumn("issue", issue).where("issue is not null")


def manifest_matches(manifest: DataFrame, runtime: DataFrame) -> DataFrame:
    """Keys (name, value) on which a manifest and the running configuration disagree."""
    m, r = manifest.withColumnRenamed("value", "m"), runtime.withColumnRenamed("value", "r")
    return m.join(r, "name", "full").where(~F.col("m").eqNullSafe(F.col("r")))
