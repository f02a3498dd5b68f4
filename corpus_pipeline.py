"""A corpus pipeline of five stages over `documents`.

Each stage's result is written to the shared folder and read again as the next
one's input.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import mixing, pii, quality, sentencepiece_fst, simhash
from sparkloom.llm.scratch import materialize, spread

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go; so do null and empty texts. See `quality.keep_good`."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity 0.8 or more. Nulls, ties, repeated rows: see `simhash.deduplicate`."""
    return simhash.deduplicate(docs, words=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets; n_chars follows the text (null for a null text); all rows stay."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents repeat, shrink to the blocks taken or go; n_chars follows the text. Texts without a word go; see `mixing.mixed_text`."""
    return mixing.mixed_text(docs).withColumn("n_chars", F.length("text").cast("long"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the text that they decode to; a null text has null ids (n_tokens null), an empty one none; all rows stay, other columns go."""
    tokens = sentencepiece_fst.encode(spread(docs), decoded_col="decoded")
    n_tokens = F.when(F.col("ids").isNotNull(), F.size("ids").cast("long"))
    return tokens.select("doc_id", "lang", "source", "n_chars", n_tokens.alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express the outlier estimate, the fingerprints, the span model, the draws or the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
    return docs
