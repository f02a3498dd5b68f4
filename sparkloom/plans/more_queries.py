"""Queries: language, policy texts, judgements, traces, layouts and the engine as a whole."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import classify, lexicon
from sparkloom.functions import text as T
from sparkloom.operators import embedding, evaluation, layout, retrieval, telemetry
from sparkloom.plans.engine import Engine
from sparkloom.plans.registry import query, quoted, sql_hits, sql_list

_WORDS = r"regexp_extract_all(lower(substr(text, 1, 3000)), '[\p{L}\p{N}_]+')"
_SCORES = ", ".join(f"len(list_filter({_WORDS}, lambda w: list_contains({sql_list(ws)}, w))) AS s_{k}" for k, ws in lexicon.LANGUAGE_WORDS.items())
_TOP = f"greatest({', '.join(f's_{k}' for k in lexicon.LANGUAGE_WORDS)})"


@query(rf"""WITH s AS (SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n, {_SCORES} FROM documents)
SELECT doc_id, CASE WHEN n < 20 THEN 'en' {" ".join(f"WHEN s_{k} = {_TOP} THEN '{k}'" for k in lexicon.LANGUAGE_WORDS)} END AS language FROM s""")
def lang_detect(t):
    return t.documents.select("doc_id", classify.language(F.col("text")).alias("language"))


_LEVEL = "CASE " + " ".join(f"WHEN {sql_hits('text', w)} >= 1 THEN {quoted(lexicon.DISCLAIMERS[k][0])}" for k, w in lexicon.SAFETY_SIGNALS.items()) + f" ELSE {quoted(lexicon.DISCLAIMERS['informational'][0])} END"


@query(f"SELECT conv_id, turn, {_LEVEL} AS note FROM conversations")
def saf_disclaimer(t):
    return t.conversations.select("conv_id", "turn", classify.disclaimer(classify.safety_level(F.col("text")), T.is_arabic(F.col("text"))).alias("note"))


@query("SELECT doc_id, doc_id % 3 = 0 OR contains(lower(text), 'type 2 diabetes risk factors') OR contains(lower(text), 'risk factors for type 2 diabetes') AS matches FROM documents")
def pol_direct_evidence(t):
    said = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Type 2  diabetes risk factors").otherwise(""))
    return t.documents.select("doc_id", classify.matches_directly(classify.evidence_groups(F.lit("Which risk factors of Type 2 are known?")), said).alias("matches"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Over USD 1 trillion was spent on diabetes in 2024; 12% of global health expenditure' ELSE 'adults living with diabetes projected 853 million by 2050' END AS rewritten FROM conversations""")
def rw_hints(t):
    asked = F.when(F.col("turn") % 2 == 0, "How much was spent in 2024?").otherwise("كم العدد المتوقع")
    return t.conversations.select("conv_id", "turn", classify.rewrite(asked, F.lit(""), F.lit(False)).alias("rewritten"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'safety_blocked' WHEN doc_id % 3 = 0 THEN 'out_of_scope' END AS status, doc_id FROM documents")
def ret_gate_status(t):
    asked = F.when(F.col("doc_id") % 2 == 0, "I have chest pain").when(F.col("doc_id") % 3 == 0, "what about type 7 diabetes").otherwise("how does insulin work")
    none = F.array().cast("array<string>")
    return t.documents.select("doc_id", retrieval.gate_status(asked, F.lit(False), none, F.lit(False)).alias("status"))


def _results(t):
    group = F.col("doc_id") % 40
    rank = F.row_number().over(Window.partitionBy(group).orderBy("doc_id"))
    return t.documents.select(group.alias("query_id"), rank.alias("rank"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("source_id"), F.col("lang").alias("document_name"), (F.col("doc_id") % 3).cast("int").alias("page_number"), "text").where("rank <= 8")


_RESULTS = "rs AS (SELECT * FROM (SELECT doc_id % 40 AS query_id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id)::INT AS rank, doc_id::VARCHAR AS chunk_id, source AS source_id, lang AS document_name, (doc_id % 3)::INT AS page_number FROM documents) WHERE rank <= 8)"
_ITEMS = "it AS (SELECT doc_id % 40 AS query_id, CASE WHEN doc_id % 5 <> 1 THEN doc_id::VARCHAR ELSE '' END AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS source_id, lang AS document_name, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE (doc_id % 3)::INT END AS page_number, (doc_id % 3 + 1)::INT AS grade FROM documents)"


@query(f"""WITH {_RESULTS}, {_ITEMS} SELECT r.query_id, r.rank, coalesce(max(i.grade), 0)::INT AS grade FROM rs r LEFT JOIN it i ON i.query_id = r.query_id AND
((i.chunk_id <> '' AND i.chunk_id = r.chunk_id) OR (i.chunk_id = '' AND (i.source_id = '' OR i.source_id = r.source_id) AND i.document_name = r.document_name AND (i.page_number = 0 OR i.page_number = r.page_number))) GROUP BY 1, 2""")
def evl_relevance_grades(t):
    """Every document is an item."""
    items = t.documents.select(
        (F.col("doc_id") % 40).alias("query_id"), F.when(F.col("doc_id") % 5 != 1, F.col("doc_id").cast("string")).otherwise("").alias("chunk_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("source_id"),
        F.col("lang").alias("document_name"), F.when(F.col("doc_id") % 7 == 0, 0).otherwise((F.col("doc_id") % 3).cast("int")).alias("page_number"), (F.col("doc_id") % 3 + 1).cast("int").alias("relevance_grade"), F.lit(None).cast("array<string>").alias("anchors"),
    )
    return evaluation.relevance_grades(_results(t), items)


@query(f"WITH {_RESULTS} SELECT query_id AS case_id, rank, CASE WHEN query_id % 4 <> 0 AND source_id = 'src' || query_id % 20 AND document_name = 'en' AND page_number = 1 THEN 'relevant' ELSE 'not_relevant' END AS relevance FROM rs")
def evl_anchor_relevance(t):
    results = _results(t).withColumnRenamed("query_id", "case_id").withColumns({"section_title": F.lit("The Intro"), "text": F.lit("An anchor, here")})
    cases = results.select("case_id").distinct().select(
        "case_id", (F.col("case_id") % 4 != 0).alias("expect_evidence"), F.concat(F.lit("src"), (F.col("case_id") % 20).cast("string")).alias("expected_source_id"), F.lit("en").alias("expected_document_name"),
        F.lit(1).alias("expected_page"), F.lit("intro").alias("expected_section"), F.array(F.lit("none"), F.lit("anchor here")).alias("text_anchors"),
    )
    return evaluation.anchor_relevance(results, cases)


@query("""WITH u AS (SELECT conv_id, unnest(['expected_status', 'required_claims_present', 'certified_citation_present', 'generation_not_called', 'structured_fields_present', 'answer_contains_accepted_value', 'other']) AS rule FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id AS case_id, rule, CASE rule WHEN 'expected_status' THEN true WHEN 'required_claims_present' THEN conv_id % 2 = 0 WHEN 'certified_citation_present' THEN conv_id % 3 = 0 WHEN 'generation_not_called' THEN false WHEN 'structured_fields_present' THEN true WHEN 'answer_contains_accepted_value' THEN conv_id % 2 = 0 END AS passed FROM u""")
def evl_task_rules(t):
    ids = t.conversations.select(F.col("conv_id").alias("case_id")).distinct()
    traces = ids.select("case_id", F.lit("ok").alias("status"), F.when(F.col("case_id") % 2 == 0, "About 589 million, 589 in all").otherwise("Nothing").alias("answer"), F.lit("c").alias("citations"), F.when(F.col("case_id") % 3 == 0, F.array(F.lit("s1"))).otherwise(F.array(F.lit("s2"))).alias("sources"), F.lit("x").alias("generation_provider"), F.lit(1).alias("retrieval_count"))
    names = ["expected_status", "required_claims_present", "certified_citation_present", "generation_not_called", "structured_fields_present", "answer_contains_accepted_value", "other"]
    cases = ids.select("case_id", F.array(*map(F.lit, names)).alias("task_pass_rules"), F.lit("ready").alias("expected_status"), F.array(F.lit("589 million 589")).alias("required_claims"), F.array(F.lit("s1")).alias("expected_sources"), F.array(F.lit("589 Million")).alias("accepted"))
    return evaluation.task_results(traces, cases)


@query()
def evl_answer_metrics(t):
    said = t.conversations.where("role = 'assistant'")
    last = telemetry.latest_per_key(said.select(F.col("conv_id").alias("query_id"), "turn", F.col("text").alias("answer")), "query_id", ["turn"])
    return evaluation.answer_metrics(last, t.conversations.where("role = 'user'").select(F.col("conv_id").alias("query_id"), F.col("text").alias("reference")))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 900 ELSE 110 + event_id % 50 END AS total_tokens, CASE WHEN event_id % 3 = 0 THEN 0.0 WHEN event_id % 4 = 0 THEN round(600 / 1e6 * 0.5 + 300 / 1e6 * 1.5, 8) ELSE round(110 / 1e6 * 0.5 + (event_id % 50) / 1e6 * 1.5, 8) END AS estimated_cost_usd, (event_id % 3 = 0)::INT AS fallback_count FROM events""")
def tel_generation_totals(t):
    usage = F.when(F.col("event_id") % 4 == 0, F.struct(F.lit(600).cast("long").alias("input"), F.lit(300).cast("long").alias("output"), F.lit(900).cast("long").alias("total")))
    rows = t.events.select("event_id", F.lit(10).cast("long").alias("query_tokens"), F.lit(100).cast("long").alias("context_tokens"), (F.col("event_id") % 50).alias("answer_tokens"), usage.alias("usage"), F.when(F.col("event_id") % 3 == 0, "extractive").otherwise("hosted").alias("provider"), F.array(F.lit("error"), F.lit("ok")).alias("attempts"))
    return telemetry.with_generation_totals(rows, {"hosted": (0.5, 1.5)}).select("event_id", "total_tokens", "estimated_cost_usd", "fallback_count")


@query("SELECT event_id, round((event_id % 80) / 100, 4) AS rpm_utilization, greatest(0, 100 - event_id % 80) AS rpm_remaining, CASE WHEN event_id % 80 >= 70 THEN 'warning' ELSE 'normal' END AS alert FROM events")
def quota_snapshot(t):
    return t.events.select("event_id", *telemetry.quota_snapshot({"rpm": F.col("event_id") % 80}, {"rpm": 100}))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS b FROM documents), k AS (SELECT * FROM l WHERE trim(t) <> '')
SELECT doc_id::VARCHAR AS document_name, 1 AS page_number, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS elem_idx, CASE WHEN length(t) < 15 THEN 'heading' ELSE 'text' END AS content_type FROM k""")
def src_layout_elements(t):
    """Lines in the role of spans: short ones are bold."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("b", "text"))
    spans = lines.select(F.col("doc_id").cast("string").alias("document_name"), F.lit(1).alias("page_number"), F.col("b").alias("block"), F.lit(0).alias("line"), F.lit(0).alias("span"), F.lit(0.0).alias("x0"), F.col("b").cast("double").alias("y0"), F.lit(1.0).alias("x1"), (F.col("b") + 1.0).alias("y1"), F.lit(11.0).alias("size"), (F.length("text") < 15).alias("bold"), "text")
    return layout.elements(spans).select("document_name", "page_number", "elem_idx", "content_type")


@query()
def emb_hashed_words(t):
    return embedding.embed(t.benchmark).select("item_id", F.size("embedding").alias("width"))


@query()
def engine_answers(t):
    """From elements to answers: conversations are the corpus, the benchmark asks."""
    elements = t.conversations.select(F.concat(F.lit("doc"), (F.col("conv_id") % 10).cast("string")).alias("document_name"), (F.col("conv_id") * 100 + F.col("turn")).alias("elem_idx"), (F.col("conv_id") + 1).cast("int").alias("page_number"), F.lit("text").alias("content_type"), F.lit("").alias("section_title"), F.lit("").alias("subsection_title"), F.col("text").alias("content"))
    names = elements.select("document_name").distinct()
    catalog = names.select("document_name", F.col("document_name").alias("source_id"), F.concat(F.lit("https://example.org/"), "document_name").alias("source_url"), F.lit("p").alias("publisher"), F.lit("2025").alias("publication_date"), F.lit(True).alias("enabled"))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.concat(F.lit("insulin "), "text").alias("query"), F.array().cast("array<string>").alias("history"))
    return Engine.ingest(elements, catalog).answer(asked, threshold=0.0)


@query("""SELECT event_type AS run_id, round(avg(value), 2) AS mean_latency_ms, round(list_sort(list(value))[greatest(floor(count(*) * 0.95)::INT - 1, 0) + 1], 2) AS p95_latency_ms FROM events GROUP BY 1""")
def evl_run_summary(t):
    return evaluation.run_summary(t.events.select(F.col("event_type").alias("run_id"), F.col("value").alias("latency_ms")))


@query("SELECT p.source AS profile, l.lang AS provider, p.source || '_' || l.lang AS run_id FROM (SELECT DISTINCT source FROM documents) p, (SELECT DISTINCT lang FROM documents) l")
def evl_experiment_grid(t):
    return evaluation.experiment_grid(t.documents.select(F.col("source").alias("profile")).distinct(), t.documents.select(F.col("lang").alias("provider")).distinct())


@query("""SELECT round(avg(toxic), 6) AS hit, round((SELECT quantile_disc(value, 0.95) FROM events), 2) AS retrieval_p95_ms, (SELECT count(DISTINCT label) FROM embeddings) AS verified_documents, (SELECT count(*) FROM embeddings) AS chunks, 0 AS invalid_vector_count FROM labels""")
def evl_stage_measures(t):
    from sparkloom.operators import vectors

    metrics = t.labels.select(F.col("doc_id").alias("query_id"), F.col("toxic").alias("hit"))
    return evaluation.stage_measures(metrics, t.events.select(F.col("value").alias("latency_ms")), vectors.width_audit(t.embeddings, "label", 64))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'treatment' WHEN doc_id % 3 = 1 THEN 'nutrition' ELSE 'general' END AS category FROM documents")
def cls_document_category(t):
    name = F.when(F.col("doc_id") % 3 == 0, "WHO Clinical-Guide.pdf").when(F.col("doc_id") % 3 == 1, "food atlas 2020").otherwise("other")
    return t.documents.select("doc_id", classify.document_category(name, {"clinical": "treatment", "food": "nutrition", "atlas": "prevention"}).alias("category"))
