"""Queries: cleaning, chunking, scoring, classification, conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import chunking, classify, lexicon
from sparkloom.functions import text as T
from sparkloom.operators import conversation, structure
from sparkloom.plans.registry import query, quoted, sql_hits, sql_list

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
# DuckDB's \s is ASCII, as is all white space of the tables' texts but the no-break spaces that the first step replaces
_NORMAL = r"regexp_replace(translate(text, chr(160) || chr(8199) || chr(8239) || chr(65279) || chr(8203) || chr(8204) || chr(8205) || chr(8288), '   '), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
_WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"


@query(f"SELECT doc_id, {_NORMAL} AS text FROM documents")
def txt_normalize(t):
    return t.documents.select("doc_id", T.normalize(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '-\s*\n\s*', '', 'g') AS text FROM documents")
def txt_dehyphenate(t):
    return t.documents.select("doc_id", T.dehyphenate(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '\s*[0-9]{1,4}\s*')), chr(10)) AS text,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_full_match(x, '\s*[0-9]{1,4}\s*')))::BIGINT AS removed FROM documents""")
def txt_page_numbers(t):
    return t.documents.select("doc_id", T.drop_page_numbers(F.col("text")).alias("text"), T.count_page_numbers(F.col("text")).alias("removed"))


@query(r"SELECT doc_id, regexp_replace(text, '\n\s*\n+', chr(10) || chr(10), 'g') AS text FROM documents")
def txt_collapse_blank_lines(t):
    return t.documents.select("doc_id", T.collapse_blank_lines(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)), '^\s+|\s+$', '', 'g') AS text FROM documents")
def txt_strip_lines(t):
    return t.documents.select("doc_id", T.strip_lines(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), chr(65279), ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def txt_clean_content(t):
    return t.documents.select("doc_id", T.clean_content(F.col("text")).alias("text"))


@query(r"""WITH l AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE regexp_matches(x, '\s*[|·•\-–—]\s*[0-9IVXLCDM]{1,5}$'))
SELECT doc_id, x AS line, regexp_replace(regexp_replace(x, '\s*[|·•\-–—]\s*[0-9IVXLCDM]{1,5}$', ''), '\s+$', '') AS base FROM l""")
def txt_page_markers(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.withColumn("base", T.page_marker_base(F.col("line"))).where("base is not null")


def _pages(t):
    at = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return t.documents.select(F.col("source").alias("document_name"), at.alias("page_number"), "text")


@query(r"""WITH p AS (SELECT source AS document_name, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS page_number, text FROM documents),
raw AS (SELECT document_name, page_number, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM p),
l AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM raw),
n AS (SELECT document_name, count(*) AS n FROM p GROUP BY 1),
s AS (SELECT DISTINCT document_name, page_number, raw, line FROM l WHERE line <> '' AND length(line) <= 100),
e AS (SELECT document_name, line FROM s JOIN n USING (document_name) GROUP BY document_name, line, n HAVING n >= 3 AND count(*) >= greatest(3, floor(n * 0.5))),
b AS (SELECT document_name, base FROM (SELECT *, regexp_replace(regexp_replace(line, '\s*[|·•\-–—]\s*[0-9IVXLCDM]{1,5}$', ''), '\s+$', '') AS base FROM s WHERE regexp_matches(line, '\s*[|·•\-–—]\s*[0-9IVXLCDM]{1,5}$')) JOIN n USING (document_name)
  WHERE base <> '' GROUP BY document_name, base, n HAVING n >= 3 AND count(*) >= greatest(3, floor(n * 0.25))),
touched AS (SELECT document_name FROM e UNION SELECT document_name FROM b)
SELECT l.document_name, l.page_number,
  coalesce(string_agg(CASE WHEN t.document_name IS NULL THEN raw ELSE l.line END, chr(10) ORDER BY pos) FILTER (WHERE t.document_name IS NULL OR (e.line IS NULL AND l.line <> '')), '') AS text,
  count(e.line)::BIGINT AS exact_removed, 0::BIGINT AS marker_removed
FROM l LEFT JOIN e ON e.document_name = l.document_name AND e.line = l.line LEFT JOIN touched t ON t.document_name = l.document_name GROUP BY 1, 2""")
def txt_repeated_lines(t):
    return structure.drop_repeated_lines(_pages(t))


@query()
def txt_clean_pages(t):
    return structure.clean_pages(_pages(t))[1]


def _elements(t):
    """Conversations in the role of elements: system turns are headings, long texts in the third place tables."""
    kind = F.when(F.col("turn") % 3 == 0, "heading").when(F.col("turn") % 5 == 4, "table").otherwise("text")
    section = F.when((kind == "heading") & (F.col("turn") % 2 == 0), F.substring("text", 1, 12)).otherwise("")
    sub = F.when((kind == "heading") & (F.col("turn") % 2 == 1), F.substring("text", 1, 8)).otherwise("")
    return t.conversations.select(F.col("conv_id").cast("string").alias("document_name"), F.col("turn").alias("elem_idx"), (F.floor(F.col("turn") / 4) + 1).cast("int").alias("page_number"), kind.alias("content_type"), section.alias("section_title"), sub.alias("subsection_title"), F.col("text").alias("content"))


_ELEMENTS = """e AS (SELECT conv_id::VARCHAR AS document_name, turn AS elem_idx, (turn // 4 + 1)::INT AS page_number,
  CASE WHEN turn % 3 = 0 THEN 'heading' WHEN turn % 5 = 4 THEN 'table' ELSE 'text' END AS content_type,
  CASE WHEN turn % 3 = 0 AND turn % 2 = 0 THEN substr(text, 1, 12) ELSE '' END AS section_title,
  CASE WHEN turn % 3 = 0 AND turn % 2 = 1 THEN substr(text, 1, 8) ELSE '' END AS subsection_title, text AS content FROM conversations)"""


@query(f"""WITH {_ELEMENTS},
g AS (SELECT *, content_type = 'heading' AS h, sum((content_type = 'heading' AND section_title <> '')::INT) OVER (PARTITION BY document_name ORDER BY elem_idx) AS grp FROM e)
SELECT document_name, elem_idx, page_number, content_type, content,
  CASE WHEN h OR section_title <> '' THEN section_title ELSE coalesce(last_value(CASE WHEN h AND section_title <> '' THEN section_title END IGNORE NULLS) OVER (PARTITION BY document_name ORDER BY elem_idx), '') END AS section_title,
  CASE WHEN h OR subsection_title <> '' THEN subsection_title ELSE coalesce(last_value(CASE WHEN h AND subsection_title <> '' THEN subsection_title END IGNORE NULLS) OVER (PARTITION BY document_name, grp ORDER BY elem_idx), '') END AS subsection_title
FROM g""")
def txt_forward_fill(t):
    return structure.fill_titles(_elements(t))


@query(rf"""WITH {_ELEMENTS},
c AS (SELECT * REPLACE (regexp_replace(regexp_replace(content, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS content) FROM e),
k AS (SELECT *, CASE WHEN content_type = 'table' THEN elem_idx ELSE -1 END AS tab FROM c WHERE content <> '')
SELECT document_name, page_number, min(elem_idx) AS unit_idx, coalesce(first(section_title ORDER BY elem_idx) FILTER (WHERE section_title <> ''), '') AS section_title,
  coalesce(first(subsection_title ORDER BY elem_idx) FILTER (WHERE subsection_title <> ''), '') AS subsection_title,
  CASE WHEN first(content_type ORDER BY elem_idx) = 'heading' AND bool_or(content_type <> 'heading') THEN 'text' ELSE first(content_type ORDER BY elem_idx) END AS content_type,
  string_agg(content, chr(10) || chr(10) ORDER BY elem_idx) AS content
FROM k GROUP BY document_name, page_number, tab""")
def txt_merge_units(t):
    return structure.merge_units(_elements(t))


@query(r"""SELECT source AS document_name, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS chunk_index,
  substr(regexp_replace(regexp_replace(source, '\.[^.]*$', ''), '[^\p{L}\p{N}_]', '_', 'g'), 1, 40) || '_p1_c' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS chunk_id FROM documents""")
def txt_chunk_ids(t):
    rows = t.documents.select(F.col("source").alias("document_name"), "doc_id", F.lit(1).alias("page_number"))
    return structure.number_chunks(rows, ["doc_id"]).select("document_name", "doc_id", "chunk_index", "chunk_id")


@query()
def txt_chunks_core(t):
    return chunking.chunk_documents(t.documents, size=2000, overlap=200)


@query()
def txt_chunks_small(t):
    return chunking.chunk_documents(t.documents, size=1200, overlap=0)


@query()
def txt_chunks_v2(t):
    return chunking.chunk_documents(t.documents, splitter="budgeted", size=500, overlap=50)


@query()
def txt_chunks_para(t):
    return chunking.chunk_documents(t.documents, splitter="paragraphs", size=500, overlap=50)


@query()
def txt_chunk_records(t):
    return structure.chunk_elements(_elements(t), profile="balanced")


_STRIPPED = STRIP.format("text")


@query(rf"""WITH s AS (SELECT doc_id, {_STRIPPED} AS x FROM documents),
f AS (SELECT doc_id, x, length(x) AS n, coalesce(list_sum(list_transform(regexp_extract_all(x, '[|\-=_•·~*#^]{{3,}}'), lambda m: length(m))), 0) AS noise, length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) AS letters, {_WORDS.format("x")} AS words FROM s)
SELECT doc_id, round(CASE WHEN x = '' THEN 0.0 WHEN n < 20 THEN 0.1 WHEN regexp_full_match(x, '[0-9][0-9\s.,]+') THEN 0.15 WHEN noise / n > 0.5 THEN 0.2 WHEN letters / n < 0.3 THEN 0.3 + letters / n ELSE 0.5 + least(1.0::DOUBLE, words / 50) * 0.5 END::DOUBLE, 6) AS quality_score FROM f""")
def q_core_score(t):
    return t.documents.select("doc_id", F.round(T.core_score(F.col("text")), 6).alias("quality_score"))


@query(rf"""WITH f AS (SELECT doc_id, text, length(regexp_replace(text, '[^\p{{L}}\s]', '', 'g')) / length(text) AS plain, {_WORDS.format("text")} AS words,
  len(regexp_extract_all(text, '(?i)\b(theorem|equation|process|analysis)\b')) + len(regexp_extract_all(text, '[0-9]+[.,][0-9]+|[0-9]+%')) + len(regexp_extract_all(text, '[=<>+\-*/]')) AS signals FROM documents)
SELECT doc_id, CASE WHEN text = '' THEN 0.0 ELSE round(least(1.0::DOUBLE, least(words / 100, 1.0::DOUBLE) * 0.4::DOUBLE + plain * 0.4::DOUBLE + least(signals / 5, 1.0::DOUBLE) * 0.2::DOUBLE), 3) END AS quality_score FROM f""")
def q_signal_score(t):
    return t.documents.select("doc_id", T.signal_score(F.col("text")).alias("quality_score"))


@query(r"""WITH n AS (SELECT doc_id, length(regexp_replace(text, '[^\x{0600}-\x{06FF}\x{0750}-\x{077F}]', '', 'g')) AS a, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents)
SELECT doc_id, CASE WHEN a + l = 0 OR a / (a + l) < 0.3 THEN 'en' WHEN a / (a + l) > 0.7 THEN 'ar' ELSE 'mixed' END AS language FROM n""")
def lang_script_ratio(t):
    return t.documents.select("doc_id", T.script_language(F.col("text")).alias("language"))


@query("SELECT doc_id, 'en' AS language FROM documents")
def lang_document(t):
    return t.documents.select("doc_id", T.document_language(F.col("text")).alias("language"))


def _sql_best(hits: dict[str, str], alias: str) -> str:
    names = list(hits)
    top = f"greatest({', '.join(f'{alias}_{n}' for n in names)})"
    second = f"list_sort([{', '.join(f'{alias}_{n}' for n in names)}], 'DESC')[2]"
    name = "CASE " + " ".join(f"WHEN {alias}_{n} = {top} THEN '{n}'" for n in names) + " END"
    return f"{name} AS {alias}_name, {top} AS {alias}_best, {second} AS {alias}_second"


_CHUNK_SQL = {k: sql_hits("text", w) for k, w in lexicon.CHUNK_KEYWORDS.items()}


@query(f"""WITH h AS (SELECT doc_id, {", ".join(f"{v} AS c_{k}" for k, v in _CHUNK_SQL.items())} FROM documents),
b AS (SELECT doc_id, {_sql_best(_CHUNK_SQL, "c")} FROM h)
SELECT doc_id, CASE WHEN c_best >= 3 AND c_best >= c_second + 2 THEN c_name WHEN c_best >= 2 THEN c_name ELSE 'general' END AS category FROM b""")
def cls_keyword_category(t):
    return t.documents.select("doc_id", classify.classify_chunk(F.lit(""), F.col("text"), F.lit("general")).alias("category"))


_ROUTE_SQL = {k: sql_hits("text", w) for k, w in lexicon.ROUTE_SIGNALS.items()}


@query(f"""WITH h AS (SELECT conv_id, turn, {", ".join(f"{v} AS c_{k}" for k, v in _ROUTE_SQL.items())} FROM conversations),
b AS (SELECT conv_id, turn, {_sql_best(_ROUTE_SQL, "c")} FROM h)
SELECT conv_id, turn, CASE WHEN c_best >= 2 AND c_best >= c_second + 1 THEN c_name ELSE 'all' END AS category FROM b""")
def cls_route(t):
    return t.conversations.select("conv_id", "turn", classify.route(F.col("text"), F.lit("all")).alias("category"))


_SAFETY = " ".join(f"WHEN {sql_hits('text', w)} >= 1 THEN '{k}'" for k, w in lexicon.SAFETY_SIGNALS.items())


@query(f"SELECT conv_id, turn, CASE {_SAFETY} ELSE 'informational' END AS level FROM conversations")
def saf_level(t):
    return t.conversations.select("conv_id", "turn", classify.safety_level(F.col("text")).alias("level"))


@query(f"SELECT doc_id, regexp_matches(text, {quoted('(?i)(' + '|'.join(lexicon.INJECTIONS) + ')')}) AS flagged FROM documents")
def pol_injection(t):
    return t.documents.select("doc_id", T.tries_injection(F.col("text")).alias("flagged"))


@query(rf"""SELECT conv_id, turn, '---USER_CONTENT_START---' || chr(10) || regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') || chr(10) || '---USER_CONTENT_END---' AS wrapped FROM conversations""")
def txt_wrap_content(t):
    return t.conversations.select("conv_id", "turn", T.wrap_content(F.col("text")).alias("wrapped"))


_SAID = "said AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant'))"


@query(f"""WITH {_SAID} SELECT conv_id, turn, coalesce(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), []) AS turns FROM said""")
def mem_rolling_history(t):
    return conversation.rolling_history(t.conversations).select("conv_id", "turn", F.transform("history", lambda h: h["turn"]).alias("turns"))


@query(f"""WITH {_SAID}, n AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS newest FROM said)
SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role, text FROM n WHERE turn < newest""")
def mem_model_history(t):
    return conversation.model_history(t.conversations)


@query(rf"""WITH {_SAID},
p AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS last_user, count(*) OVER w AS n_before FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS own, regexp_replace(last_user, '^\s+|\s+$', '', 'g') AS last_user, n_before FROM p WHERE role = 'user'),
r AS (SELECT conv_id, turn, CASE WHEN own = '' THEN own
  WHEN n_before > 0 AND coalesce(last_user, '') <> '' AND (regexp_matches(own, '(?i)^\s*(what about|how about|and what about|tell me more about)\s') OR regexp_matches(own, '(?i)^\s*(can i|can i eat|can i have)\s+\w+\s*\??\s*$')) THEN last_user || '. ' || own
  WHEN length(own) < 20 AND n_before = 0 THEN own || ' in the context of diabetes management' ELSE own END AS x FROM s)
SELECT conv_id, turn, regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS rewritten FROM r""")
def rw_contextualise(t):
    return conversation.rewrite_questions(t.conversations).select("conv_id", "turn", "rewritten")


def _asked(t):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    users = t.conversations.where("role = 'user'")
    return users.withColumn("history", F.collect_list("text").over(before))


_TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}]+'))"


@query(rf"""WITH u AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^[ .?!؟]+', ''), '[ .?!؟]+$', '') AS q,
  coalesce(max(length(regexp_replace(text, '^\s+|\s+$', '', 'g'))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 8, false) AS ctx FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN q = '' THEN true WHEN list_contains({sql_list(lexicon.VAGUE_QUESTIONS)}, q) THEN NOT ctx WHEN list_has_any({_TOKENS.format("q")}, {sql_list(lexicon.DOMAIN_ANCHORS)}) THEN false
  ELSE len(list_filter({_TOKENS.format("q")}, lambda w: NOT list_contains({sql_list(lexicon.LIGHT_WORDS)}, w))) < 2 AND NOT ctx END AS vague FROM u""")
def pol_needs_clarification(t):
    context = F.exists("history", lambda h: F.length(T.strip(h)) >= 8)
    return _asked(t).select("conv_id", "turn", classify.needs_clarification(F.col("text"), context).alias("vague"))


_DOMAIN = rf"(list_has_any({_TOKENS.format('text')}, {sql_list(lexicon.DOMAIN_ANCHORS)}) OR " + " OR ".join(f"contains(lower(text), {quoted(w)})" for w in lexicon.DOMAIN_FRAGMENTS) + ")"


@query(f"""SELECT conv_id, turn, NOT coalesce(bool_or({_DOMAIN}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS off_domain FROM conversations WHERE role = 'user'""")
def pol_out_of_domain(t):
    return _asked(t).select("conv_id", "turn", classify.is_out_of_domain(F.col("text"), F.col("history")).alias("off_domain"))


@query(r"SELECT doc_id, greatest(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')), ceil(length(text) / 3))::BIGINT AS tokens FROM documents")
def quota_token_estimate(t):
    return t.documents.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))
