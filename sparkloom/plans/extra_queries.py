"""Queries of operators around ingestion, review and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import lexicon as L
from sparkloom.functions import text as T
from sparkloom.operators import evaluation, structure, telemetry
from sparkloom.plans.registry import query, sql_list


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
    k AS (SELECT *, (pos - 1) // 4 AS page_number FROM l WHERE length(trim(text)) > 0)
    SELECT doc_id AS document_name, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS "index", page_number, length(text) AS char_count,
      len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS word_count FROM k
""")
def txt_page_records(t):
    """Lines of each document as chunks, four to a page."""
    lines = t.documents.where("text is not null").select(F.col("doc_id").alias("document_name"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.length(F.trim("text")) > 0)
    chunks = lines.select("document_name", F.floor(F.col("pos") / 4).cast("long").alias("page_number"), "pos", "text", F.lit(1.0).alias("quality_score"), F.lit("en").alias("language"))
    return structure.page_records(chunks).select("document_name", "index", "page_number", "char_count", "word_count")


_TYPES = ["mcq", "true_false", "short_answer", "essay", "other"]


def _shown() -> str:
    cases = " ".join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in L.QUESTION_FIELDS.items())
    return f"CASE kind {cases} ELSE {sql_list(L.OTHER_QUESTION_FIELDS)} END"


@query(f"""
    WITH q AS (SELECT p_partkey AS id, {sql_list(_TYPES)}[(p_size % 5 + 1)::INT] AS kind, p_name AS name, p_brand AS brand FROM part),
    f AS (SELECT *, {_shown()} AS shown FROM q)
    SELECT id, kind, list_aggregate(list_filter(['answer', 'difficulty', 'options', 'question_text', 'statement'], lambda k: list_contains(shown, k)), 'string_agg', ',') AS fields,
      CASE WHEN list_contains(shown, 'question_text') THEN name END AS question_text FROM f
""")
def sec_question_fields(t):
    """Parts as exam questions of five types: the fields that may be printed."""
    kind = F.array(*map(F.lit, _TYPES))[F.col("p_size") % 5]
    fields = F.create_map(F.lit("question_text"), "p_name", F.lit("options"), "p_brand", F.lit("answer"), "p_type", F.lit("statement"), "p_name", F.lit("difficulty"), F.lit("1"))
    shown = t.part.select(F.col("p_partkey").alias("id"), kind.alias("kind"), T.question_fields(fields, kind).alias("m"))
    return shown.select("id", "kind", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("fields"), F.col("m")["question_text"].alias("question_text"))


@query("""
    WITH s AS (SELECT source, count(*) AS pages, sum(length(coalesce(text, ''))) // 1000 AS chunks, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> ''))) AS tokens,
      CASE WHEN length(source) % 5 = 0 THEN 'broken' ELSE '' END AS error, count(*) % 3 = 0 AS skipped FROM documents GROUP BY source)
    SELECT count(*) AS documents, count(*) FILTER (WHERE error = '' AND NOT skipped) AS successful, count(*) FILTER (WHERE skipped) AS skipped, count(*) FILTER (WHERE error <> '') AS failed,
      coalesce(sum(pages) FILTER (WHERE error = '' AND NOT skipped), 0)::BIGINT AS pages, coalesce(sum(chunks) FILTER (WHERE error = '' AND NOT skipped), 0)::BIGINT AS chunks,
      coalesce(sum(tokens) FILTER (WHERE error = '' AND NOT skipped), 0)::BIGINT AS tokens FROM s
""")
def agg_ingestion_summary(t):
    """Sources as ingested documents."""
    text = F.coalesce("text", F.lit(""))
    stats = t.documents.groupBy("source").agg(F.count("*").alias("pages"), F.floor(F.sum(F.length(text)) / 1000).alias("chunks"), F.sum(T.word_count(text)).alias("token_count"))
    stats = stats.select(F.col("source").alias("file_name"), "pages", "chunks", "token_count", F.when(F.length("source") % 5 == 0, "broken").otherwise("").alias("error"), (F.col("pages") % 3 == 0).alias("skipped"))
    return telemetry.ingestion_summary(stats)


@query("""
    WITH r AS (SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, event_type, value FROM events),
    l AS (SELECT case_id, rank, CASE WHEN event_type = 'purchase' THEN 'relevant' WHEN event_type = 'click' THEN 'not_relevant' WHEN event_type = 'view' THEN 'unjudged' END AS relevance FROM r WHERE event_type <> 'error')
    SELECT r.case_id, r.rank::INTEGER AS rank FROM r LEFT JOIN l ON l.case_id = r.case_id AND l.rank = r.rank WHERE r.rank <= 5 AND coalesce(l.relevance, 'unjudged') = 'unjudged'
""")
def evl_unjudged_places(t):
    """A user's events as a ranking whose places are labelled by their type; errors have no label."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    ranking = t.events.select(F.col("user_id").alias("case_id"), rank.alias("rank"), "event_type")
    said = F.when(F.col("event_type") == "purchase", "relevant").when(F.col("event_type") == "click", "not_relevant").when(F.col("event_type") == "view", "unjudged")
    return evaluation.unjudged(ranking, ranking.where("event_type <> 'error'").select("case_id", "rank", said.alias("relevance")))


@query("""
    SELECT item_id, array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+'), ' ') AS words FROM benchmark
""")
def evl_normalised_words(t):
    """Benchmark passages as the words that answers are compared by."""
    return t.benchmark.select("item_id", T.normalize_words(F.col("text")).alias("words"))
