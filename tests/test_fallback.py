from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import lexicon as L
from sparkloom.operators import embedding, evaluation, retrieval, telemetry


def _model():
    def model(texts):
        """Fails for questions on weather, and gives directions by a word for others."""
        if any("weather" in t for t in texts):
            raise ConnectionError("model is down")
        return np.array([[1.0, 0.1] if "insulin" in t else [0.1, 1.0] for t in texts])

    return model


model = _model()


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, "treatment", [1.0, 0.0], "Insulin", "insulin lowers glucose", 0.9), (2, "nutrition", [0.99, 0.1], "Food", "insulin with weather and food", 0.5), (3, "general", [0.9, 0.2], "All", "weather changes glucose", None),
            (4, "treatment", [0.0, 1.0], "References", "Smith J et al. 2020", 0.1), (5, "prevention", [0.0, 1.0], "Walk", "walking in warm weather", 0.8)]
    return spark.createDataFrame(rows, "chunk_id long, category string, embedding array<double>, section_title string, text string, quality_score double")


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "what is insulin", "all"), (2, "insulin please", "treatment"), (3, "warm weather", "all"), (4, "weather today", "nutrition"), (5, "  ", "all"), (6, None, None), (7, "insulin again", "no such")]
    return embedding.try_embed(spark.createDataFrame(rows, "query_id long, query string, category string"), model)


def test_failures_are_values(asked):
    got = {r.query_id: (r.query_vector is None, r.embedding_error) for r in asked.collect()}
    assert got == {1: (False, None), 2: (False, None), 3: (True, "ConnectionError"), 4: (True, "ConnectionError"), 5: (True, "blank"), 6: (True, "blank"), 7: (False, None)}


def test_a_failing_text_does_not_take_its_batch_along(spark):
    rows = spark.createDataFrame([(i, "weather" if i == 3 else f"insulin {i}") for i in range(8)], "i int, query string").coalesce(1)
    got = embedding.try_embed(rows, model, batch=4).collect()
    assert [r.i for r in got if r.query_vector is None] == [3]
    assert all(abs(np.linalg.norm(r.query_vector) - 1) < 1e-6 for r in got if r.query_vector)


def test_each_question_goes_its_way_and_to_its_category(corpus, asked):
    found = retrieval.retrieve_routed(corpus, asked, 3, 0.3)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault((r.query_id, r.retrieval_mode), []).append(r.id)
    assert got == {(1, "vector"): [2, 1, 3], (2, "vector"): [1, 3], (3, "lexical"): [5, 3, 2], (4, "lexical"): [3, 2], (7, "vector"): [2, 1, 3]}
    assert all(0 <= r.score <= 1 and abs(r.score + r.distance - 1) < 1e-3 for r in found.collect())


def test_a_corpus_without_categories_or_scores(corpus, asked):
    plain = corpus.drop("category", "quality_score")
    found = retrieval.retrieve_routed(plain, asked.drop("category"), 3, 0.3)
    assert {(r.query_id, r.retrieval_mode) for r in found.collect()} == {(1, "vector"), (2, "vector"), (3, "lexical"), (4, "lexical"), (7, "vector")}


def test_both_ways_embed_each_text_once(spark, asked, tmp_path):
    """Searching by words and fetching what was found don't call the corpus' model."""
    calls = str(tmp_path / "calls")

    def counted(texts):
        with open(calls, "a") as f:
            f.write("x" * len(texts))
        return np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([(i, "", f"warm weather {'x' * i}") for i in range(20)], "chunk_id long, section_title string, text string")
    found = retrieval.retrieve_routed(embedding.embed(rows, counted), asked.drop("category"), 3, 0.0).select("query_id", "id", "rank", "retrieval_mode")
    assert {(r.query_id, r.retrieval_mode, r["rank"]) for r in found.collect()} == {(q, way, n) for q, way in ((1, "vector"), (2, "vector"), (3, "lexical"), (4, "lexical"), (7, "vector")) for n in (1, 2, 3)}
    assert (tmp_path / "calls").stat().st_size == 20


def test_only_found_rows_are_asked_for_bibliographies(corpus, asked):
    ways = [retrieval.retrieve_routed(corpus, asked, 3, 0.3), retrieval.retrieve(corpus, asked.where("query_vector IS NOT NULL"), 3, 0.3)]
    for found in ways:
        plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
        named = [line for line in plan if "^(references|bibliography" in line]
        assert named and all("Join Inner" in line for line in named)
        assert 4 not in {r.id for r in found.collect()}


def test_hashed_words_are_signed_counts():
    def by_word(texts, width):
        out = np.zeros((len(texts), width), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % width] += 1 if h >> 63 else -1
        return out

    texts = ["a b A c", "", "  ", "ÜBER " * 300 + "x" * 500, "one"]
    for width in (7, 64):
        got = embedding.hashed_words(texts, width)
        assert got.dtype == np.float32 and (got == by_word(texts, width)).all()
    assert embedding.hashed_words([]).shape == (0, 64)


def test_evidence_of_other_categories_is_left_out(spark, corpus):
    """A question that is routed to a category gets its evidence and general one only; a stale index stops it."""
    catalog = spark.createDataFrame([("doc", True, "s", "https://x.org", "p", "2020")], "document_name string, enabled boolean, source_id string, source_url string, publisher string, publication_date string")
    rows = corpus.withColumn("document_name", F.lit("doc")).withColumn("text", F.concat(F.lit("insulin medication dose treatment "), "text"))
    question = spark.createDataFrame([(1, "insulin medication treatment for diabetes", [1.0, 0.0], [])], "query_id long, query string, query_vector array<double>, history array<string>")
    out = retrieval.stage_evidence(rows, question, catalog, 5, 0.3).first()
    assert out.category == "treatment" and out.status == "ready" and {c.id for c in out.chunks} <= {1, 3}
    assert retrieval.stage_evidence(rows, question, catalog, stale=F.lit(True)).first().status == "stale_index"


def test_cases_are_matched_by_id_alone_if_one_is_given(spark):
    cases = spark.createDataFrame([("a", "What is Insulin?", ["insulin: what?"]), ("b", "ＦＯＯＤ plans", None), ("c", None, [None, "what is insulin"])], "case_id string, query string, query_variants array<string>")
    asked = spark.createDataFrame([(1, "no matter", "a"), (2, "what is insulin", "zz"), (3, "WHAT is insulin", ""), (4, "insulin what", None), (5, "food, PLANS!", None), (6, "foods", None), (7, None, None)], "query_id int, query string, case_id string")
    got = {r.query_id: (r.case_id, r.match) for r in evaluation.match_cases(asked, cases).collect()}
    assert got == {1: ("a", "explicit_case_id"), 2: (None, "unknown_case_id"), 3: ("a", "canonical_query"), 4: ("a", "reviewed_variant"), 5: ("b", "canonical_query"), 6: (None, "unlabeled_query"), 7: ("c", "canonical_query")}


def test_the_longest_hint_counts_and_a_second_more():
    assert embedding.retry_seconds("Please retry in 0.5s.", 2.0) == 2.0
    assert embedding.retry_seconds("retry in 4s; {'retryDelay': '12.5s'}", 2.0) == 13.5
    assert embedding.retry_seconds("no hint", 5.0) == 5.0


def test_messages_for_users(spark):
    rows = spark.createDataFrame([(c, a, s) for c in L.PROVIDER_MESSAGES for a in (True, False) for s in (True, False)], "c string, a boolean, s boolean")
    got = {(r.c, r.a, r.s): r.m for r in rows.select("*", telemetry.provider_message(F.col("c"), F.col("a"), F.col("s")).alias("m")).collect()}
    assert got["rate_limited", False, True] == "The knowledge search is busy. Please try again in a minute."
    assert got["rate_limited", False, False] == "The AI service is busy. Please try again in a minute."
    assert got["safety_blocked", True, True] == got["safety_blocked", True, False] == "لا يمكنني المساعدة في هذا الطلب."
    assert all(got.values()) and "خدمة البحث" in got["timeout", True, True]
