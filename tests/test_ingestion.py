"""Ingestion broken off at each of its steps leaves no half-written document and goes on where it stopped."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import ingestion

DOCS = [("a", "one two three"), ("b", "four"), ("c", ""), ("d", "bad word"), ("e", "x")]


def steps(broken: str | None = None, ran: list | None = None):
    def wrap(name, f):
        def step(rows):
            if ran is not None:
                ran.append(name)
            out = f(rows)
            return out.withColumn("document_name", F.when(F.col("document_name") == "b", F.raise_error(F.lit("broken"))).otherwise(F.col("document_name")).cast("string")) if name == broken else out

        return name, step

    return [
        wrap("extract", lambda r: r.withColumn("error", F.when(F.col("text") == "", "no text"))),
        wrap("split", lambda r: r.select("document_name", F.explode(F.split("text", " ")).alias("text"))),
        wrap("filter", lambda r: r.where("length(text) > 1").withColumn("error", F.when(F.col("text") == "bad", "bad word"))),
    ]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "document_name string, text string")


def stored(spark, store):
    rows = ingestion.committed(spark, store)
    return sorted((r.document_name, r.text) for r in rows.collect()) if rows is not None else []


def told(spark, store):
    return {r.document_name: (r.status, r.step, r.error, r.n) for r in ingestion.states(spark, store).collect()}


GOOD = [("a", "one"), ("a", "three"), ("a", "two"), ("b", "four")]
STATES = {"a": ("completed", None, None, 3), "b": ("completed", None, None, 1), "c": ("failed", "extract", "no text", 0), "d": ("failed", "filter", "bad word", 0), "e": ("failed", "filter", "nothing left", 0)}


def test_states_and_skips(spark, tmp_path):
    store = f"file://{tmp_path}/s"
    assert ingestion.committed(spark, store) is None and told(spark, store) == {}
    assert ingestion.ingest(docs(spark), steps(), store) == 1
    assert stored(spark, store) == GOOD and told(spark, store) == STATES
    assert ingestion.ingest(docs(spark, [("a", "changed text")]), steps(), store) is None
    assert ingestion.ingest(docs(spark, [("a", "changed text"), ("c", "now there")]), steps(), store) == 2
    assert stored(spark, store) == GOOD + [("c", "now"), ("c", "there")]


@pytest.mark.parametrize("broken", ["extract", "split", "filter", "commit"])
def test_a_broken_step_shows_nothing_and_is_resumed(spark, tmp_path, broken, monkeypatch):
    store = f"file://{tmp_path}/s"
    ingestion.ingest(docs(spark, [("b", "old words")]), steps(), store)
    with monkeypatch.context() as m:
        if broken == "commit":
            m.setattr(ingestion, "reduce", lambda *_: (_ for _ in ()).throw(RuntimeError("broken")))
        with pytest.raises(Exception, match="broken"):
            ingestion.ingest(docs(spark), steps(broken), store, force=True)
    assert stored(spark, store) == [("b", "old"), ("b", "words")]
    assert {s[0] for s in told(spark, store).values()} == {"processing"}
    ran = []
    assert ingestion.ingest(docs(spark, []), steps(ran=ran), store) is None
    names = ["extract", "split", "filter", "commit"]
    assert ran == [n for n in names[names.index(broken) :] if n != "commit"]
    assert stored(spark, store) == GOOD and told(spark, store) == STATES


def test_undo_and_vacuum(spark, tmp_path):
    store = f"file://{tmp_path}/s"
    ingestion.ingest(docs(spark), steps(), store)
    ingestion.ingest(docs(spark, [("b", "new text"), ("a", "")]), steps(), store, force=True)
    assert stored(spark, store) == GOOD[:3] + [("b", "new"), ("b", "text")]  # a failed its new run and keeps its rows
    assert told(spark, store)["a"] == ("failed", "extract", "no text", 0)
    ingestion.undo(spark, store, 2)
    assert stored(spark, store) == GOOD and told(spark, store) == STATES
    ingestion.ingest(docs(spark, [("a", "aa"), ("b", "bb")]), steps(), store, force=True)
    assert ingestion.vacuum(spark, store) == [1]
    assert stored(spark, store) == [("a", "aa"), ("b", "bb")]


def test_nameless_documents_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="no name"):
        ingestion.ingest(docs(spark, [(None, "x")]), steps(), f"file://{tmp_path}/s")
    assert ingestion.ingest(docs(spark, []), steps(), f"file://{tmp_path}/s") is None
