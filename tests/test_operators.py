from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import lexicon as L
from sparkloom.operators import answers, evaluation, fingerprints, retrieval, telemetry, vectors
from sparkloom.sources import readers, sinks
from sparkloom.streaming import streams


def test_percentiles_are_values(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(1, 15)], "v double")
    row = frame.agg(*(telemetry.nearest_rank("v", p).alias(str(i)) for i, p in enumerate((0.5, 0.95, 0.99)))).first()
    assert tuple(row) == (7.0, 14.0, 14.0)


def test_ranking_metrics(spark):
    ranking = spark.createDataFrame([("q", 1, "a"), ("q", 2, "a"), ("q", 3, "x"), ("q", 4, "b")], "query_id string, rank int, item string")
    pool = spark.createDataFrame([("q", "a", 3), ("q", "b", 1), ("none", "z", 2)], "query_id string, item string, grade int")
    got = {r.query_id: r for r in evaluation.ranking_metrics(ranking, pool, 4).collect()}
    assert got["q"].average_precision == pytest.approx(0.833333) and got["q"].precision_at_k == 0.5 and got["q"].recall_at_k == 1.0
    assert got["none"].hit_rate_at_k == 0.0 and got["none"].ndcg_at_k == 0.0


def test_token_overlap(spark):
    pairs = spark.createDataFrame([(1, "a a b", "a b b"), (2, "", ""), (3, "a", ""), (4, "x", "y")], "id int, p string, r string")
    got = {r.id: r.token_f1 for r in evaluation.token_overlap(pairs, "id", "p", "r").collect()}
    assert got == {1: pytest.approx(0.666667), 2: 1.0, 3: 0.0, 4: 0.0}


def test_faithfulness(spark):
    a = spark.createDataFrame([(1, "The sky is blue. Zebras dance nightly.")], "query_id int, answer string")
    c = spark.createDataFrame([(1, "Today the sky is very blue")], "query_id int, text string")
    assert evaluation.faithfulness(a, c).first().faithfulness == 0.5


def test_lexical_scores(spark):
    corpus = spark.createDataFrame([("c1", "In 2024 there were 589 cases", 0.5), ("c2", "2024 only", None), ("c3", "2024 too", 0.9)], "chunk_id string, text string, quality_score double")
    asked = spark.createDataFrame([(1, "589 million adults in 2024 with what")], "query_id int, query string")
    assert asked.select(retrieval.lexical_terms(F.col("query")).alias("t")).first().t == ["589", "2024"]
    got = retrieval.lexical_topk(corpus, asked, 5).orderBy("rank").collect()
    assert [(r.id, r.score, r.distance) for r in got] == [("c1", 1.0, 0.0), ("c2", 0.75, 0.25), ("c3", 0.75, 0.25)]


def test_vector_search_blocks_agree(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = rows.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    whole = {tuple(r) for r in vectors.vector_topk(rows, asked, 3, "vec_id").collect()}
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 4)
    assert {tuple(r) for r in vectors.vector_topk(rows, asked, 3, "vec_id").collect()} == whole
    assert vectors.vector_topk(rows, asked, 0, "vec_id").count() == 0


def test_gates(spark):
    ask = ["", "I have chest pain", "what dose should i take", "type 5 diabetes", "help", "who won the football match yesterday", "what does insulin do"]
    frame = spark.createDataFrame([(q,) for q in ask], "q string")
    none = F.array().cast("array<string>")
    got = [r.s for r in frame.select(retrieval.gate_status(F.col("q"), F.lit(False), none, F.lit(False)).alias("s")).collect()]
    assert got == ["needs_clarification", "safety_blocked", "out_of_scope", "out_of_scope", "needs_clarification", "out_of_scope", None]


def test_rehydration(spark):
    corpus = spark.createDataFrame([("a", "d1"), ("b", "d2")], "chunk_id string, document_name string")
    catalog = spark.createDataFrame([("d1", "s1", "https://x", "p", "d", True), ("d2", "s2", "http://x", "p", "d", True)], "document_name string, source_id string, source_url string, publisher string, publication_date string, enabled boolean")
    asked = spark.createDataFrame([(1, ["a"], "h"), (2, ["a", "b"], "h"), (3, ["a", "z"], "h"), (4, ["a"], "old")], "query_id int, ids array<string>, manifest_hash string")
    got = {r.query_id: r.status for r in retrieval.rehydrate(corpus, asked, catalog, "h").collect()}
    assert got == {1: "ready", 2: "invalid_provenance", 3: "infrastructure_failure", 4: "stale_index"}


def test_candidates(spark):
    schema = "profile string, provider string, precision_at_5 double, hit_at_5 double, mean_latency_ms double, estimated_cost_usd double, refusal_pass_rate double, labels_complete boolean"
    per_k = F.create_map(F.lit(3), F.struct(F.lit(0.6).alias("macro_precision_at_k"), F.lit(0.9).alias("hit_at_k")), F.lit(5), F.struct(F.lit(0.6).alias("macro_precision_at_k"), F.lit(0.7).alias("hit_at_k")))
    pick = lambda *rows: evaluation.select_candidate(spark.createDataFrame(list(rows), schema).withColumn("per_k", per_k)).collect()
    local = ("large", "local", 0.45, 0.95, 400.0, 0.0, 1.0, True)
    near, far = ("large", "hosted", 0.48, 0.95, 300.0, 0.1, 1.0, True), ("large", "hosted", 0.52, 0.95, 300.0, 0.1, 1.0, True)
    assert [(r.provider, r.runtime_k) for r in pick(local, near)] == [("local", 3)]
    assert pick(local, far)[0].provider == "hosted" and pick(near)[0].provider == "hosted"
    assert pick(("x", "local", 0.3, 0.95, 1.0, 0.0, 1.0, True)) == []


def test_reservations_replay_in_order(spark):
    t0 = datetime.datetime(2024, 3, 10, 9, 0, 0)
    rows = [(1, "m", t0, 10), (2, "m", t0 + datetime.timedelta(seconds=1), 10), (3, "m", t0 + datetime.timedelta(seconds=2), 10), (4, "m", t0 + datetime.timedelta(seconds=60), 10), (5, "n", t0, 500)]
    frame = spark.createDataFrame(rows, "event_id long, model string, ts timestamp, input_tokens long")
    got = {r.event_id: (r.allowed, r.blocked_by) for r in telemetry.replay_reservations(frame, "model", 2, 400, 100, share=1.0).collect()}
    assert got == {1: (True, ""), 2: (True, ""), 3: (False, "rpm"), 4: (True, ""), 5: (False, "tpm")}


def test_pacific_days_know_daylight_saving(spark):
    frame = spark.sql("SELECT timestamp'2024-03-10 12:00:00' a, timestamp'2024-03-11 06:30:00' b, timestamp'2024-01-05 07:59:59' c")
    got = frame.select(*(telemetry.pacific_day_start(F.col(x)).cast("string").alias(x) for x in "abc")).first()
    assert tuple(got) == ("2024-03-10 08:00:00", "2024-03-10 08:00:00", "2024-01-04 08:00:00")


def test_answers(spark):
    said = "The first relevant sentence about insulin therapy has quite enough words to be used here. Short one."
    rows = [("q", "insulin therapy", 1, said, "doc", 4, "S"), ("q", "insulin therapy", 2, said.upper().capitalize(), "doc", 4, "S"), ("q", "insulin therapy", 3, "no", "doc", 5, "S")]
    frame = spark.createDataFrame(rows, "query_id string, query string, rank int, text string, document_name string, page_number int, section_title string").withColumns({"subsection_title": F.lit(""), "category": F.lit("general")})
    got = answers.extractive_bullets(frame).collect()
    assert [r.bullet for r in got] == ["- The first relevant sentence about insulin therapy has quite enough words to be used here. [E1] (Page 4)"]
    assert answers.citations(frame).count() == 2
    marked = spark.createDataFrame([("see 【source E2】 and [E 9]", 3)], "a string, n int").select(answers.normalize_citations(F.col("a"), F.col("n")).alias("x")).first().x
    assert marked == "see [E2] and [E 9]"


def test_partitioned_store(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = lambda *r: spark.createDataFrame(list(r), "namespace string, chunk_id string, document_name string, text string, seq int")
    sinks.upsert_partitions(spark, rows(("a", "1", "d1", "x", 0), ("a", "2", "d2", "y", 0), ("b", "1", "d1", "z", 0)), path, ["namespace", "chunk_id"], "seq")
    sinks.upsert_partitions(spark, rows(("a", "1", "d1", "older", 1), ("a", "1", "d1", "new", 2), ("a", "3", "d3", "w", 0)), path, ["namespace", "chunk_id"], "seq")
    read = lambda: {(r.namespace, r.chunk_id): r.text for r in spark.read.parquet(path).collect()}
    assert read() == {("a", "1"): "new", ("a", "2"): "y", ("a", "3"): "w", ("b", "1"): "z"}
    sinks.delete_document(spark, path, "a", "d2")
    assert ("a", "2") not in read() and ("b", "1") in read()
    sinks.reset_namespace(spark, path, "b")
    assert set(read()) == {("a", "1"), ("a", "3")}


def test_manifests_and_hashes(spark, tmp_path):
    path = f"file://{tmp_path}/m.json"
    assert readers.read_manifest(spark, path) is None
    sinks.write_manifest(spark, {"b": 1, "a": {"x": "é"}}, path)
    assert readers.read_manifest(spark, path) == {"a": {"x": "é"}, "b": 1}
    files = spark.createDataFrame([("B", "2"), ("a", "1")], "name string, digest string")
    import hashlib

    assert fingerprints.corpus_hash(files).first()[0] == hashlib.sha256(b"a\x001\nB\x002\n").hexdigest()


def test_vector_width_is_enforced(spark):
    frame = spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>")
    assert sinks.check_vectors(frame, 2).count() == 1
    with pytest.raises(Exception, match="not 3 wide"):
        sinks.check_vectors(frame, 3).collect()


def test_readers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\n\n\ntwo \n\n \n\nthree")
    (tmp_path / "in" / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "in" / "c.bin").write_text("no")
    readers.register_parser("md", lambda name, raw: iter([(1, "S", "", raw.decode(), "text")]))
    (tmp_path / "in" / "d.md").write_text("# x")
    files = readers.list_files(spark, str(tmp_path / "in"), ("txt", "md"))
    got = {(r.document_name, r.elem_idx): r.content for r in readers.parse_files(files).collect()}
    assert got == {("a.txt", 0): "one", ("a.txt", 1): "two", ("a.txt", 2): "three", ("b.txt", 0): "café", ("d.md", 0): "# x"}
    assert [r.content for r in readers.read_text_elements(spark, f"{tmp_path}/in/a.txt").collect()] == ["one", "two", "three"]
    good = {"source_id": "s", "document_name": "d", "source_url": "https://x", "publisher": "p", "publication_date": "1", "license_note": "l", "reuse_status": "r", "checksum": "a" * 64, "enabled": True}
    (tmp_path / "c.json").write_text(json.dumps({"sources": [good, good | {"source_id": "t", "source_url": "http://x", "checksum": "zz"}]}))
    issues = {(r.source_id, r.issue) for r in readers.catalog_issues(readers.read_catalog(spark, f"{tmp_path}/c.json")).collect()}
    assert issues == {("t", "url"), ("t", "checksum"), ("s", "duplicate document_name")}
    (tmp_path / "log.jsonl").write_text('{"trace_id": "1", "recorded_at": "2024-01-01", "conversation_id": "c"}\nbroken\n{"trace_id": "2", "recorded_at": "2024-01-02", "conversation_id": "c"}\n')
    schema = "trace_id string, recorded_at string, conversation_id string"
    assert [r.trace_id for r in readers.read_traces(spark, f"{tmp_path}/log.jsonl", schema, 5, "c").collect()] == ["1", "2"]


def test_streams_equal_their_batch_twins(spark, sf, tmp_path):
    source = readers_folder(spark, sf, tmp_path)
    batch = spark.read.parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    for i, f in enumerate((streams.tumbling, streams.sliding, streams.sessions)):
        live = streams.drain(f(streams.read_events(spark, source)), f"live{i}", "append" if f is streams.sessions else "complete", f"{tmp_path}/ck{i}")
        expected = {tuple(r) for r in f(batch).collect()}
        seen = {tuple(r) for r in live.collect()}
        # in append mode the last session may still be open
        assert seen == expected if f is not streams.sessions else seen <= expected and len(seen) >= 0.9 * len(expected)


def readers_folder(spark, sf, tmp_path):
    out = f"{tmp_path}/events"
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(out)
    return out


def test_streamed_reservations(spark, tmp_path):
    t0 = datetime.datetime(2024, 3, 10, 9, 0, 0)
    rows = [("m", i, t0 + datetime.timedelta(seconds=20 * i), 10) for i in range(8)]
    spark.createDataFrame(rows, "key string, event_id long, ts timestamp, input_tokens long").write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema("key string, event_id long, ts timestamp, input_tokens long").parquet(f"{tmp_path}/in")
    got = {r.event_id: r.allowed for r in streams.drain(streams.reservations(live, 2, 1000), "reserved", "append", f"{tmp_path}/ck").collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True}


def test_table_excerpts(spark):
    text = "Indicator | Insulin therapy in adults | Daily doses were adjusted by weekly fasting glucose over the whole study period | Other | x"
    frame = spark.createDataFrame([(text, ["insulin", "therapy"])], "t string, terms array<string>")
    got = frame.select(answers.table_excerpt(F.col("t"), F.col("terms")).alias("x")).first().x
    assert got == "Insulin therapy in adults: Daily doses were adjusted by weekly fasting glucose over the whole study period."
    assert frame.select(answers.table_excerpt(F.lit("no table"), F.col("terms")).alias("x")).first().x is None


def test_layout_rules(spark):
    from sparkloom.operators import layout

    spans = [("d", 1, 0, 0, 0, 0.0, 0.0, 10.0, 5.0, 20.0, False, "Big Title"), ("d", 1, 1, 0, 0, 0.0, 10.0, 10.0, 15.0, 10.0, True, "Sub"), ("d", 1, 2, 0, 0, 0.0, 20.0, 10.0, 30.0, 10.0, False, "Body"), ("d", 1, 2, 0, 1, 0.0, 20.0, 10.0, 30.0, 10.0, False, "text"), ("d", 1, 2, 1, 0, 0.0, 20.0, 10.0, 30.0, 10.0, False, "line"), ("d", 1, 3, 0, 0, 0.0, 40.0, 10.0, 50.0, 10.0, False, "cell")]
    schema = "document_name string, page_number int, block int, line int, span int, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, text string"
    tables = spark.createDataFrame([("d", 1, 0.0, 39.0, 10.0, 51.0)], "document_name string, page_number int, x0 double, y0 double, x1 double, y1 double")
    got = [(r.elem_idx, r.content_type, r.section_title, r.subsection_title, r.content) for r in layout.elements(spark.createDataFrame(spans, schema), tables).orderBy("elem_idx").collect()]
    assert got == [(0, "heading", "Big Title", "", "Big Title"), (1, "heading", "", "Sub", "Sub"), (2, "text", "", "", "Body text\nline")]


def test_blank_texts_and_questions(spark):
    from sparkloom.operators import embedding

    rows = embedding.embed(spark.createDataFrame([(1, " "), (2, "a b")], "id int, text string")).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in rows)
    with pytest.raises(Exception, match="blank"):
        embedding.embed_queries(spark.createDataFrame([(" ",)], "query string")).collect()


def test_engine_answers_from_its_corpus(spark):
    from sparkloom.plans.engine import Engine

    text = "Insulin therapy lowers the glucose level of most adults within a few weeks of careful daily treatment."
    elements = spark.createDataFrame([("d.txt", 0, "text", "", "", 3, text), ("e.txt", 0, "text", "References", "", 1, "insulin therapy glucose adults " * 5)], "document_name string, elem_idx long, content_type string, section_title string, subsection_title string, page_number int, content string")
    catalog = spark.createDataFrame([(n, f"s{n}", "https://x", "p", "2025", True) for n in ("d.txt", "e.txt")], "document_name string, source_id string, source_url string, publisher string, publication_date string, enabled boolean")
    engine = Engine.ingest(elements, catalog)
    asked = spark.createDataFrame([(1, "insulin therapy glucose adults treatment", []), (2, "I have chest pain", [])], "query_id int, query string, history array<string>")
    got = {r.query_id: (r.status, r.answer) for r in engine.answer(asked, threshold=0.1).collect()}
    assert got[1][0] == "ready" and got[1][1].startswith(f"- {text} [E1] (Page 3)") and got[1][1].endswith("medical decisions.*")
    assert got[2] == ("safety_blocked", None)
    assert engine.audit(64).count() == 2


def test_generation_totals(spark):
    frame = spark.createDataFrame([(10, 20, 30, None, "hosted", ["ok"]), (10, 20, 30, (5, 6, 11), "extractive", ["error", "ok"])], "query_tokens long, context_tokens long, answer_tokens long, usage struct<input:long,output:long,total:long>, provider string, attempts array<string>")
    got = [(r.total_tokens, r.estimated_cost_usd, r.fallback_count) for r in telemetry.with_generation_totals(frame, {"hosted": (1.0, 2.0)}).collect()]
    assert got == [(60, pytest.approx(9e-05), 0), (11, 0.0, 1)]


REVIEWED = "pos long, case_id string, query string, query_variants array<string>, language string, expect_evidence boolean, reference_answers array<string>, required_claims array<string>, relevant_items array<struct<source_id:string,relevance_grade:int>>, review struct<status:string,reviewer_role:string,reviewed_at:string>"


def test_review_issues(spark):
    done = ("reviewed", "doctor", "2025-01-01")
    cases = spark.createDataFrame(
        [
            (0, "a", "What is it?", ["how so"], "en", True, ["An answer"], ["claim"], [("s", 2)], done),
            (1, "a", "ＷＨＡＴ is it", [""], "xx", False, None, None, [], ("pending", "nurse", None)),
            (2, "", "new", None, "ar", True, ["English"], [], [("t", 0), ("zz", None)], ("reviewed", None, "")),
            (3, "d", "other", [], "en", True, [], ["c"], None, done),
            (4, "e", "another", [], "en", True, ["جواب"], ["c"], [("s", 1)], done),
        ],
        REVIEWED,
    )
    sources = spark.createDataFrame([("s", "https://x"), ("t", "http://x")], "source_id string, source_url string")
    got = {(r.case_id, r.issue, r.detail) for r in sinks.review_issues(cases, sources).collect()}
    assert got == {
        ("a", "duplicate_or_missing_case_id", "a"), ("a", "duplicate_query_or_variant", "ＷＨＡＴ is it"), ("a", "empty_query_or_variant", ""), ("a", "invalid_language", "xx"), ("a", "pending_human_review", "nurse"),
        ("", "duplicate_or_missing_case_id", "missing"), ("", "reviewed_case_missing_timestamp", ""), ("", "reference_language_content_mismatch", "Arabic case has no Arabic reference answer"), ("", "missing_required_claims", ""),
        ("", "non_https_provenance", "t"), ("", "invalid_relevance_grade", "0"), ("", "unknown_source_id", "zz"), ("", "invalid_relevance_grade", "None"),
        ("d", "missing_language_reference_answer", ""), ("d", "missing_relevance_judgments", ""), ("e", "reference_language_content_mismatch", "English case contains an Arabic reference answer"),
    }


def test_excerpts_of_texts_and_terms(spark):
    from sparkloom.operators import answers

    whole = "1) Insulin doses and glucose values\nof most adults were measured every day\nover twelve weeks of treatment by nurses."
    rows = [
        (1, "insulin glucose", 1, whole),
        (2, "insulin", 1, "٣٣٣٣٣٣ ٣٣٣٣٣ ٣٣٣٣٣٣ ٣٣٣٣٣٣ ٣٣٣٣٣ ٣٣٣٣ Insulin one two three four five six seven ٣٣٣٣٣ end."),
        (3, "السكري الثاني", 1, "Diabetes is named here and the sentence is long enough to be taken as it stands, I think. The other sentence says nothing of it but is long enough to be usable as well, or so."),
        (4, "insulin", 1, "123 456 789 1 2 3 4 5 6 7 8 9 ........................................................... !"),
    ]
    evidence = spark.createDataFrame([(q, t, r, x, "d", 2, "") for q, t, r, x in rows], "query_id int, query string, rank int, text string, document_name string, page_number int, section_title string")
    got = {r.query_id: r.excerpt for r in answers.best_excerpts(evidence).collect()}
    assert got[1] == whole.replace("\n", " ") and got[2] is None and got[4] is None and got[3].startswith("Diabetes is named")


def test_prompts_and_records(spark):
    from sparkloom.operators import answers

    evidence = spark.createDataFrame(
        [(1, 2, "low <b>", "b_c-d.pdf", "S", "", 0, "c", "text", 0.25, "s2", "https://2", "", None), (1, 1, "top", "a.pdf", "", "U", 7, "c", "text", 0.5, "s1", "https://1", "P", "2025")],
        "query_id int, rank int, text string, document_name string, section_title string, subsection_title string, page_number int, category string, content_type string, score double, source_id string, source_url string, publisher string, publication_date string",
    )
    questions = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id int, query string")
    history = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", f"t{i}" * 300) for i in range(9)] + [(1, 9, "system", "no")], "query_id int, turn int, role string, content string")
    prompt = {r.query_id: r.prompt for r in answers.grounded_prompts(questions, evidence, history).collect()}
    assert prompt[1].index("[E1 | a.pdf | Subsection: U | Page 7]\ntop") < prompt[1].index("---\n\n[E2 | b_c-d.pdf | Section: S]\nlow <b>") and "USER QUESTION: why?\n\nFirst verify" in prompt[1]
    assert prompt[1].count("Previous User: ") == 2 and prompt[1].count("Previous Assistant: ") == 3 and "t3" not in prompt[1] and "Previous User: " + ("t5" * 300)[:500] + "\n" in prompt[1]
    assert prompt[2].startswith("RETRIEVED CONTEXT: No relevant information was found.\n\nUSER QUESTION: how?")
    catalog = spark.createDataFrame([("b_c-d.pdf", "Q", "2020")], "document_name string, publisher string, publication_date string")
    assert [(r.evidence_id, r.publisher, r.publication_date) for r in answers.citation_records(evidence, catalog).orderBy("evidence_id").collect()] == [("E1", "P", "2025"), ("E2", "Q", "2020")]
    assert [r.n for r in evidence.select(answers.display_name(F.col("document_name")).alias("n")).orderBy("n").collect()] == ["a", "b c – d"]
    envelopes = spark.createDataFrame([(1, True, ""), (2, False, "none here"), (3, False, None)], "query_id int, ready boolean, message string")
    shown = {r.query_id: r.markdown for r in answers.rendered_evidence(envelopes, evidence).collect()}
    assert "#### 1. a.pdf · score 0.500\nSection: Not specified · Page 7\nSource: [s1](https://1)\n\n```text\ntop\n```\n" in shown[1] and "low <b>" in shown[1]
    assert shown[2] == "none here" and shown[3].startswith("*No evidence")
    asked = spark.createDataFrame([(1, "why?", "why so?", "c"), (2, "x", "y", "z")], "query_id int, query string, rewritten string, category string")
    debug = {r.query_id: r.debug for r in answers.debug_blocks(asked, evidence).collect()}
    assert "Chunks retrieved : 2" in debug[1] and "  [1] score=0.500 | a.pdf | p.7 | cat=c | type=text\n       preview: top..." in debug[1] and "Chunks retrieved : 0" in debug[2]


def test_normal_forms(spark):
    from sparkloom.functions import text as T

    row = spark.createDataFrame([("ＡＢ Straße ½x_1, don't!",)], "t string").select(T.normalize_words(F.col("t")).alias("w"), T.normalize_visible(F.col("t")).alias("v")).first()
    assert row.w == "ab strasse 1 2x_1 don t" and row.v == "ab straße 1 2x_1 don t"


def test_docx_files(spark, tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="Heading 2"/></w:style><w:style w:styleId="H3"><w:name w:val="Heading 3"/></w:style></w:styles>'
    para = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    body = para("One", "H1") + para("Sub", "H2") + para(" ") + "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p>" + para("deep", "H3") + para("Two", "H1") + para("end") + f"<w:tbl><w:tr><w:tc>{para('cell')}</w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)
    (tmp_path / "broken.docx").write_bytes(b"PK nonsense")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    (tmp_path / "t.txt").write_text("x\n\ny")
    files = readers.list_files(spark, f"file://{tmp_path}")
    got = [tuple(r)[3:] for r in readers.parse_files(files).where("document_name = 'f.docx'").orderBy("elem_idx").collect()]
    assert got == [("One", "", "One", "heading"), ("One", "Sub", "Sub", "heading"), ("One", "Sub", "a\tb", "text"), ("One", "Sub", "deep", "heading"), ("Two", "", "Two", "heading"), ("Two", "", "end", "text")]
    outcome = {r.document_name: (r.outcome, r.elements) for r in readers.parse_outcomes(files).collect()}
    assert outcome == {"f.docx": ("parsed", 6), "broken.docx": ("failed", 0), "scan.pdf": ("unsupported", 0), "t.txt": ("parsed", 2)}


def test_embedding_tries_again():
    import numpy as np

    from sparkloom.operators import embedding

    clock, slept, calls = [0.0], [], []

    def sleep(s):
        slept.append(s)
        clock[0] += s

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) in (2, 3):
            raise RuntimeError("429 RESOURCE_EXHAUSTED" + (" 'retryDelay': '7s', retry in 3s" if len(calls) == 3 else ""))
        return np.ones((len(texts), 2))

    make = lambda **more: embedding.Retrying(flaky, now=lambda: clock[0], sleep=sleep, **more)
    assert make()([f"t{i}" for i in range(40)]).shape == (40, 2) and calls == [16, 16, 16, 16, 8] and slept == [2.0, 8.0]
    calls[:] = [0]
    with pytest.raises(RuntimeError, match="429"):
        make(delays=())(["q"])
    calls[:], slept[:] = [0] * 9, []
    make(per_minute=20)([f"t{i}" for i in range(32)])
    assert slept == [60.25]
    with pytest.raises(RuntimeError, match="vectors"):
        embedding.Retrying(lambda t: np.ones((1, 2)))(["a", "b"])


def test_quota_decisions_and_errors(spark):
    rows = spark.createDataFrame([("", False, 0), ("rpm", True, 10), ("rpd", False, 10), ("tpm", False, 100), ("rpm", False, 4000)], "b string, i boolean, ms int")
    got = [(r.d.action, r.d.seconds) for r in rows.select(telemetry.acquire_decision(F.col("b"), F.col("i"), F.col("ms")).alias("d")).collect()]
    assert got == [("go", 0.0), ("fail", 0.0), ("fail", 0.0), ("wait", 0.25), ("wait", 4.0)]
    delays = spark.createDataFrame([(0, None), (3, None), (9, None), (2, 1.5)], "a int, p double").select(telemetry.retry_delay(F.col("a"), F.col("p"), F.lit(0.5)).alias("d"))
    assert [r.d for r in delays.collect()] == [1.5, 8.5, 60.0, 1.5]
    errors = [
        ("API key not valid", None, ("invalid_api_key", 400, False)), ("x", 401, ("authentication_failed", 401, False)), ("PERMISSION_DENIED", None, ("permission_denied", 403, False)), ("Model not found", 500, ("model_not_found", 500, False)),
        ("quota", None, ("rate_limited", 429, True)), ("blocked", None, ("safety_blocked", None, False)), ("timed out", None, ("timeout", None, True)), ("", 503, ("service_unavailable", 503, True)), ("bad request", None, ("invalid_request", 400, False)),
        ("API_KEY is not set", None, ("missing_api_key", None, False)), ("Error 503: try later", None, ("service_unavailable", 503, True)), ("code 5031", None, ("unknown_error", None, False)), (None, None, ("unknown_error", None, False)),
    ]
    frame = spark.createDataFrame([(i, m, s) for i, (m, s, _) in enumerate(errors)], "i int, m string, s int").select("i", telemetry.provider_error(F.col("m"), F.col("s")).alias("e")).orderBy("i")
    assert [(r.e.code, r.e.http_status, r.e.retryable) for r in frame.collect()] == [e[2] for e in errors]
    rows = telemetry.provider_errors(spark.createDataFrame([(i, m, s) for i, (m, s, _) in enumerate(errors)], "i int, m string, s int"), "m", "s")
    assert rows.columns == ["i", "code", "http_status", "retryable"] and [tuple(r)[1:] for r in rows.orderBy("i").collect()] == [e[2] for e in errors]


def test_provider_errors_read_a_message_once(spark):
    """Lower case and the number in a message are each in the plan once, whatever the number of kinds."""
    plan = telemetry.provider_errors(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1 and plan.count("lower(") == 1


def test_label_gates_and_backfill(spark):
    ranking = spark.createDataFrame([("a", i) for i in range(1, 8)] + [("b", 1)], "case_id string, rank int")
    labels = spark.createDataFrame([("a", 1, "relevant"), ("a", 2, "unjudged"), ("a", 3, "not_relevant"), ("a", 4, None)], "case_id string, rank int, relevance string")
    missing = evaluation.unjudged(ranking, labels)
    assert {tuple(r) for r in missing.collect()} == {("a", 2), ("a", 4), ("a", 5), ("b", 1)}
    with pytest.raises(ValueError, match=r"unjudged: a#2, a#4 … and 2 more"):
        evaluation.require_none(missing, "unjudged", shown=2)
    evaluation.require_none(missing.limit(0), "unjudged")
    with pytest.raises(Exception, match="invalid relevance"):
        evaluation.unjudged(ranking, labels.union(spark.createDataFrame([("b", 1, "maybe")], labels.schema))).collect()
    review = spark.createDataFrame(
        [("a", 1, "relevant", "x", "y", "relevant", "relevant", None), ("a", 2, "relevant", "x", "", "relevant", "relevant", None), ("a", 3, "relevant", "x", "y", "relevant", "not_relevant", None), ("a", 4, "not_relevant", None, None, None, None, "certified_anchor_oracle"), ("a", 5, "unjudged", None, None, None, None, "certified_anchor_oracle")],
        "case_id string, rank int, relevance string, reviewer_a string, reviewer_b string, reviewer_a_label string, reviewer_b_label string, label_method string",
    )
    assert sorted(r["rank"] for r in evaluation.unreviewed(review).collect()) == [2, 3, 5]
    records = spark.createDataFrame([("1", "v1", {"m": (0.5, True), "n": (None, False)}), ("2", "v2", {"m": (0.1, True)}), ("3", None, {})], "id string, metric_implementation_version string, quality_metrics map<string,struct<value:double,applicable:boolean>>")
    patched, counts = evaluation.backfill(records, "v2", lambda old: old)
    assert {r.id for r in patched.where("metric_implementation_version = 'v2' AND backfilled_at IS NOT NULL").collect()} == {"1", "3"} and tuple(counts.first()) == (2, 1, 1)


def test_certified_ingestion(spark, tmp_path):
    path = f"file://{tmp_path}/corpus"
    chunks = spark.createDataFrame([("c1", "d1"), ("c2", "d2")], "chunk_id string, document_name string")
    done = sinks.ingest_certified(spark, chunks, path, "n1", {"profile": "p"})
    assert (done["chunk_count"], done["document_count"]) == (2, 2) and readers.read_manifest(spark, f"{path}/_manifests/n1.json") == done
    with pytest.raises(ValueError, match="complete"):
        sinks.ingest_certified(spark, chunks, path, "n1", {})
    sinks.ingest_certified(spark, chunks.limit(1), path, "n2", {})
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError, match="no chunks"):
        sinks.ingest_certified(spark, chunks.limit(0), path, "n3", {})


def test_question_fields(spark):
    from sparkloom.functions import text as T

    frame = spark.createDataFrame([("mcq", {"question_text": "q", "options": "o", "answer": "a"}), ("new", {"statement": "s", "domain": "d", "options": "o"})], "kind string, m map<string,string>")
    got = frame.select(T.question_fields(F.col("m"), F.col("kind")).alias("x"), T.without_fields(F.col("m"), ["options"]).alias("y"), T.without_fields(F.col("m"), []).alias("z")).collect()
    assert [r.x for r in got] == [{"question_text": "q", "options": "o"}, {"domain": "d"}] and [set(r.y) for r in got] == [{"question_text", "answer"}, {"statement", "domain"}] and len(got[0].z) == 3


def test_answer_checks(spark):
    note = L.DISCLAIMERS["diagnosis"][0]
    rows = [("a", True, "ready", "Yes [E1]" + note, 2, "diagnosis"), ("b", True, "ready", "Yes", 0, "diagnosis"), ("c", False, "out_of_scope", "No.", 0, "safe")]
    frame = spark.createDataFrame(rows, "case_id string, expect_evidence boolean, status string, answer string, n_evidence int, safety string")
    got = [tuple(r)[1:] for r in evaluation.answer_checks(frame).orderBy("case_id").collect()]
    assert got == [(True, None, True, True), (False, None, False, False), (None, True, None, None)]
