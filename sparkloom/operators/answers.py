"""Answer assembly from evidence rows (query_id, query, rank, text, document_name, page_number, section_title, ...)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import lexicon as L
from sparkloom.functions import text as T

CONTEXT_CHARS = 12_000
EXCERPT_CHARS = 420


def sentences(c: Column) -> Column:
    """Parts of a text between sentence ends and line breaks."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?؟])\s+|\n+"), clean_sentence), lambda s: s != "")


def clean_sentence(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, rf"{T.SPACE}+", " "), r"^[ \t\r\n\-*•|#]+", ""), r"[ \t\r\n\-*•|#]+\z", "")


def query_terms(c: Column) -> Column:
    """Word tokens without stop words, and what Arabic ones stand for."""
    own = F.array_distinct(F.filter(T.tokens(c), lambda t: ~t.isin(L.ANSWER_STOPWORDS)))
    meant = F.create_map(*(x for k, v in L.ARABIC_TERMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.array_union(own, F.flatten(F.transform(own, lambda t: F.coalesce(meant[t], F.array().cast("array<string>")))))


def is_usable(s: Column) -> Column:
    """A whole, prose-like sentence."""
    words = T.tokens(s)
    last = F.element_at(F.concat(F.array(F.lit("")), words), -1)
    letter = F.regexp_extract(s, r"(\p{L})", 1)
    digits = F.length(F.regexp_replace(s, r"[^\p{Nd}]", "")) / F.greatest(F.length(s), F.lit(1))
    ends = F.substring(F.regexp_replace(s, rf"{T.SPACE}+\z", ""), -1, 1).isin(L.SENTENCE_ENDS)
    return (F.length(s) >= 70) & (F.size(words) >= 9) & ~F.contains(s, F.lit("|")) & ~F.contains(s, F.lit("---")) & ~last.isin(L.TRAILING_WORDS) & ends & (letter != "") & ~letter.rlike("^[a-z]$") & (digits < 0.18)


def trim_excerpt(c: Column, limit: int = EXCERPT_CHARS) -> Column:
    short = F.regexp_replace(F.regexp_replace(F.substring(c, 1, limit), " [^ ]*$", ""), r"[ ,;:]+$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(short, F.lit("…")))


def table_excerpt(text: Column, terms: Column) -> Column:
    """The table cell that shares most terms, with the cell after it; null if the text has no table, no cell fits or the excerpt is short."""
    cells = F.filter(F.transform(F.split(text, r"\|"), clean_sentence), lambda c: (c != "") & ~c.rlike("^[-: ]+$") & ~F.lower(c).isin(L.TABLE_HEADERS))
    shared = lambda c: F.size(F.array_intersect(F.array_distinct(T.tokens(c)), terms))
    best = F.array_max(F.transform(cells, lambda c, i: F.struct(shared(c).alias("n"), (-i).alias("i"))))
    head, detail = F.get(cells, -best["i"]), F.coalesce(F.get(cells, 1 - best["i"]), F.lit(""))
    detail = F.regexp_replace(F.regexp_replace(detail, r"\b[0-9]+\.\s*", ""), r"\s+(?=[A-Z][a-z]+(?:\s+[a-z]+){0,3}\s+(?:prevalence|control)\b)", "; ")
    joined = F.concat(F.regexp_replace(F.when(detail != "", F.concat(head, F.lit(": "), detail)).otherwise(head), r"[ ;:,.!]+$", ""), F.lit("."))
    return F.when(F.contains(text, F.lit("|")) & (best["n"] > 0) & (F.length(joined) >= 70), trim_excerpt(joined))


def best_excerpts(evidence: DataFrame) -> DataFrame:
    """The best excerpt of each evidence row: of a table if one fits, else the sentence with most shared terms, then closest to 240 characters, then first; without a usable sentence the whole text if it reads as one."""
    parts = evidence.select("*", query_terms(F.col("query")).alias("__terms"), F.posexplode_outer(F.filter(sentences(F.col("text")), is_usable)).alias("__pos", "sentence"))
    whole = clean_sentence(F.col("text"))
    overlap = F.size(F.array_intersect(F.array_distinct(T.tokens(F.col("sentence"))), F.col("__terms")))
    order = Window.partitionBy("query_id", "rank").orderBy(F.desc("overlap"), F.abs(F.length("sentence") - 240), "__pos")
    ranked = parts.withColumn("overlap", overlap).withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return ranked.withColumn("excerpt", F.coalesce(table_excerpt(F.col("text"), F.col("__terms")), trim_excerpt(F.col("sentence")), F.when(is_usable(whole), trim_excerpt(whole)))).drop("__terms", "__pos", "__n", "sentence")


def extractive_bullets(evidence: DataFrame, most: int = 3) -> DataFrame:
    """Up to `most` different excerpts for each query, in rank order: query_id, n, bullet."""
    best = best_excerpts(evidence).where("excerpt is not null")
    first = F.row_number().over(Window.partitionBy("query_id", F.lower("excerpt")).orderBy("rank"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    kept = best.withColumn("__first", first).where("__first = 1").withColumn("n", n).where(F.col("n") <= most)
    page = F.when(F.col("page_number") != 0, F.concat(F.lit(" (Page "), F.col("page_number").cast("string"), F.lit(")"))).otherwise("")
    return kept.select("query_id", "n", F.concat(F.lit("- "), F.col("excerpt"), F.lit(" [E"), F.col("rank").cast("string"), F.lit("]"), F.coalesce(page, F.lit(""))).alias("bullet"))


def context_blocks(evidence: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """Evidence in rank order until the budget is used: query_id, rank, block; the row that crosses it is cut at a word if over 200 characters are left."""
    part = lambda label, c, n: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), F.substring(c, 1, n)))
    page = F.when(F.coalesce("page_number", F.lit(0)) != 0, F.concat(F.lit("Page: "), F.col("page_number").cast("string")))
    head = F.concat_ws(" | ", F.concat(F.lit("[SOURCE "), F.col("rank").cast("string"), F.lit("]")), F.concat(F.lit("Document: "), F.col("document_name")), part("Section: ", F.col("section_title"), 100), part("Subsection: ", F.col("subsection_title"), 80), page, F.concat(F.lit("Category: "), F.col("category")))
    rows = evidence.select("query_id", "rank", head.alias("head"), T.strip(F.col("text")).alias("body")).withColumn("size", F.length("head") + 1 + F.length("body"))
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"upto": F.sum("size").over(order), "nth": F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))})
    over = (F.col("upto") > budget) & (F.col("nth") > 1)
    rows = rows.withColumn("over", F.sum(over.cast("int")).over(order)).where(F.col("over") <= 1)
    left = budget - (F.col("upto") - F.col("size"))
    cut = F.substring("body", F.lit(1), F.greatest(left - F.length("head") - 50, F.lit(0)).cast("int"))
    cut = F.when(F.instr(F.substring(cut, F.lit(2), F.length(cut)), " ") > 0, F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut)
    block = F.when(F.col("over") == 0, F.concat("head", F.lit("\n"), "body")).when(left > 200, F.concat("head", F.lit("\n"), cut, F.lit("... [truncated]")))
    return rows.select("query_id", "rank", block.alias("block")).where("block is not null")


def citations(evidence: DataFrame) -> DataFrame:
    """One citation for each document, page and section of a query; it keeps the first rank."""
    first = F.row_number().over(Window.partitionBy("query_id", "document_name", "page_number", "section_title").orderBy("rank"))
    return evidence.withColumn("__n", first).where("__n = 1").withColumn("evidence_id", F.concat(F.lit("E"), F.col("rank").cast("string"))).drop("__n")


def label_for_prompt(document: Column, section: Column, subsection: Column, page: Column, text: Column, index: Column) -> Column:
    part = lambda label, c, n: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), F.substring(c, 1, n)))
    number = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit("Page "), page.cast("string")))
    head = F.concat_ws(" | ", F.concat(F.lit("E"), index.cast("string")), document, part("Section: ", section, 80), part("Subsection: ", subsection, 60), number)
    return F.concat(F.lit("["), head, F.lit("]\n"), text)


_MARK = re.compile(L.CITATION_MARK, re.I)


def normalize_citations(answer: Column, evidence_count: Column) -> Column:
    """Variants of citation marks become [E#] if the number is one of the evidence rows; Spark has no conditional replace, so this is an Arrow UDF."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, counts: pd.Series) -> pd.Series:
        fix = lambda n: lambda m: f"[E{int(m[1])}]" if 1 <= int(m[1]) <= n else m[0]
        return pd.Series([None if t is None else _MARK.sub(fix(n), t) for t, n in zip(texts, counts)])

    return run(answer, evidence_count)


def ensure_citations(answer: Column, evidence_count: Column) -> Column:
    """An answer without a mark gets all of them at its end."""
    marks = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(evidence_count, F.lit(1))), lambda i: F.concat(F.lit("[E"), i.cast("string"), F.lit("]"))), " ")
    return F.when((evidence_count <= 0) | answer.rlike(r"\[E[0-9]+\]"), answer).otherwise(F.concat(F.regexp_replace(answer, rf"{T.SPACE}+\z", ""), F.lit("\n\nEvidence: "), marks))


def display_name(document: Column) -> Column:
    """A file name for readers: no extension, underscores as spaces, dashes set off."""
    bare = F.regexp_replace(F.regexp_replace(document, r"\.[^.]*\z", ""), "_", " ")
    return T.strip(F.regexp_replace(F.regexp_replace(bare, "-", " – "), " {2,}", " "))


def citation_records(evidence: DataFrame, catalog: DataFrame) -> DataFrame:
    """One structured citation for each evidence row: query_id, evidence_id and provenance; publisher and date come from the catalog where the row has none."""
    known = catalog.select("document_name", F.col("publisher").alias("__p"), F.col("publication_date").alias("__d")).dropDuplicates(["document_name"])
    filled = lambda own, other: F.coalesce(F.nullif(F.col(own), F.lit("")), F.col(other), F.lit("")).alias(own)
    met = evidence.join(known, "document_name", "left")
    return met.select("query_id", F.concat(F.lit("E"), F.col("rank").cast("string")).alias("evidence_id"), "source_id", "document_name", "source_url", filled("publisher", "__p"), filled("publication_date", "__d"), "page_number", "section_title")


def in_rank_order(evidence: DataFrame, item: Column, joiner: str, name: str) -> DataFrame:
    """One row per query: its items joined in rank order; a query's evidence is bounded by the k that it was fetched with."""
    listed = F.sort_array(F.collect_list(F.struct("rank", item.alias("item"))))
    return evidence.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["item"]), joiner).alias(name))


def grounded_prompts(questions: DataFrame, evidence: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """query_id, prompt: the labelled evidence of each question (query_id, query), after its last six turns (query_id, turn, role, content), 500 characters of each."""
    label = label_for_prompt(F.col("document_name"), F.col("section_title"), F.col("subsection_title"), F.col("page_number"), F.col("text"), F.col("rank"))
    out = questions.join(in_rank_order(evidence, label, "\n\n---\n\n", "__context"), "query_id", "left")
    if history is None:
        out = out.withColumn("__history", F.lit(None).cast("string"))
    else:
        back = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("turn")))
        who = F.when(F.col("role") == "user", "Previous User: ").when(F.col("role") == "assistant", "Previous Assistant: ")
        said = history.withColumn("__n", back).where("__n <= 6").withColumn("rank", F.col("turn")).withColumn("__line", F.concat(who, F.substring("content", 1, 500))).where("__line is not null")
        out = out.join(in_rank_order(said, F.col("__line"), "\n", "__history"), "query_id", "left")
    before, after = L.PROMPT_CONTEXT.split("{}")
    context = F.when(F.col("__context").isNotNull(), F.concat(F.lit(before), "__context", F.lit(after))).otherwise(L.PROMPT_NO_CONTEXT)
    head, tail = L.PROMPT_HISTORY.split("{}")
    past = F.coalesce(F.concat(F.lit(head), F.col("__history"), F.lit(tail)), F.lit(""))
    return out.select("query_id", F.concat(past, context, F.lit("\nUSER QUESTION: "), F.col("query"), F.lit("\n\n" + L.PROMPT_RULES)).alias("prompt"))


def _escaped(c: Column) -> Column:
    """Text for HTML."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


def rendered_evidence(envelopes: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, markdown: ranked texts with provenance of the envelopes (query_id, ready, message) that are ready, else their message."""
    section = F.coalesce(F.nullif(F.col("section_title"), F.lit("")), F.lit("Not specified"))
    item = F.concat(
        F.lit("#### "), F.col("rank").cast("string"), F.lit(". "), _escaped(F.col("document_name")), F.lit(" · score "), F.format_string("%.3f", F.col("score").cast("double")), F.lit("\nSection: "), _escaped(section), F.lit(" · Page "),
        F.coalesce(F.col("page_number").cast("string"), F.lit("None")), F.lit("\nSource: ["), _escaped(F.col("source_id")), F.lit("]("), F.col("source_url"), F.lit(")\n\n```text\n"), F.col("text"), F.lit("\n```\n"),
    )
    met = envelopes.join(in_rank_order(evidence, item, "\n", "__body"), "query_id", "left")
    none = F.coalesce(F.nullif(F.col("message"), F.lit("")), F.lit(L.NO_EVIDENCE))
    return met.select("query_id", F.when(F.col("ready"), F.concat(F.lit("### Retrieved evidence\n\n"), F.coalesce("__body", F.lit("")))).otherwise(none).alias("markdown"))


def debug_blocks(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, debug: what retrieval did for each question (query_id, query, rewritten, category), a line for each evidence row."""
    line = F.concat(F.format_string("  [%d] score=%.3f | ", F.col("rank").cast("int"), F.col("score").cast("double")), F.col("document_name"), F.lit(" | p."), F.col("page_number").cast("string"), F.lit(" | cat="), F.col("category"), F.lit(" | type="), F.col("content_type"))
    section = F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit("\n       section: "), F.substring("section_title", 1, 80))).otherwise("")
    item = F.concat(line, section, F.lit("\n       preview: "), T.strip(F.substring("text", 1, 100)), F.lit("...\n"))
    n = evidence.groupBy("query_id").agg(F.count("*").alias("__n"))
    met = queries.join(in_rank_order(evidence, item, "\n", "__items"), "query_id", "left").join(n, "query_id", "left")
    rule = "─" * 49
    head = F.concat(
        F.lit("```\n── DEBUG INFO " + "─" * 34 + "\nOriginal query   : "), F.substring("query", 1, 120), F.lit("\nRewritten query  : "), F.substring("rewritten", 1, 120), F.lit("\nRouted category  : "), F.col("category"), F.lit("\nChunks retrieved : "),
        F.coalesce("__n", F.lit(0)).cast("string"), F.lit("\n\n"),
    )
    return met.select("query_id", F.concat(head, F.coalesce(F.concat("__items", F.lit("\n")), F.lit("")), F.lit(rule + "\n```")).alias("debug"))
