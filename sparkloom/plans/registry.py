"""Named queries over the tables, each with DuckDB SQL where that can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable]:
    """Register a function of the tables under its name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


class Tables:
    """Tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def sql_hits(text: str, words: list[str]) -> str:
    """SQL for how many of the words a lower-cased text contains."""
    return "(" + " + ".join(f"contains(lower({text}), {quoted(w)})::INT" for w in words) + ")"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"
