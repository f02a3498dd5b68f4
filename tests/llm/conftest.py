from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a very long text."""
    long = "Lorem ipsum dolor sit amet. " * 20_000
    rows = [
        (1, "plain words here", "en", "a", 16),
        (1, "plain words here", "en", "a", 16),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \t\n", "en", None, 3),
        (None, "no id at all", None, "b", 12),
        (None, None, None, None, None),
        (5, long, "en", "b", len(long)),
        (6, "x", "de", "a", 1),
    ]
    # a column with a name that operators use inside
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, DOCS)
    return frame.withColumns({"fp": F.lit("clash"), "size": F.lit(1), "path": F.lit("p"), "spans": F.lit("s"), "ids": F.lit("i"), "copy": F.lit("c"), "__t": F.lit(0), "toxic": F.lit(5)})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
