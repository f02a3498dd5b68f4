"""Retrieval: lexical and vector search of question batches, provenance, lookups and the gate chain."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import classify as C
from sparkloom.functions import lexicon as L
from sparkloom.functions import text as T
from sparkloom.operators.vectors import BROADCAST_QUERIES, category_filter, vector_topk
from sparkloom.sources.workspace import written

THRESHOLD, SUFFICIENT = 0.30, 0.25


def lexical_terms(query: Column, most: int = 12) -> Column:
    """Distinct telling terms in order: numbers, and words of 4 letters or more that are no stop words."""
    found = F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*map(F.lit, L.LEXICAL_STOPWORDS))
    return F.slice(F.array_distinct(F.filter(found, lambda t: ~F.array_contains(stop, t) & (t.rlike("^[0-9]+$") | (F.length(t) >= 4)))), 1, most)


def _best_rows(questions, k: int):
    """Local top k of each query over the rows of a task: one pass of an Aho-Corasick automaton over each text, whatever the number of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        asked = questions.value  # [(query_id, terms)]
        automaton = ahocorasick.Automaton()
        by_term: dict[str, list[int]] = {}
        for n, (_, terms) in enumerate(asked):
            for t in terms:
                by_term.setdefault(t, []).append(n)
        for t, ns in by_term.items():
            automaton.add_word(t, (t, ns))
        if not by_term:
            return
        automaton.make_automaton()
        order = lambda r: (-r[0], r[1] is not None, -(r[1] or 0.0), r[2])
        held: list[list[tuple]] = [[] for _ in asked]
        least = [0.0] * len(asked)
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                found = {t: ns for _, (t, ns) in automaton.iter(text)} if text else {}
                hits: dict[int, int] = {}
                for ns in found.values():
                    for n in ns:
                        hits[n] = hits.get(n, 0) + 1
                for n, count in hits.items():
                    share = count / len(asked[n][1])
                    if share >= least[n]:
                        own = held[n]
                        own.append((share, b.column(2)[i].as_py(), b.column(0)[i].as_py()))
                        if len(own) >= 4 * k + 16:
                            own.sort(key=order)
                            del own[k:]
                            least[n] = own[-1][0]
        rows = [(n, *r) for n, own in enumerate(held) for r in sorted(own, key=order)[:k]]
        if rows:
            n, share, quality, ids = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(ids, kind), pa.array(share, pa.float64()), pa.array(quality, pa.float64())], ["n", "id", "coverage", "q"])

    return run


def lexical_topk(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", text_col: str = "text", quality_col: str = "quality_score") -> DataFrame:
    """Best rows by the share of a query's terms that the text contains: query_id, id, coverage, score, distance, rank.

    Ties go to the higher quality (unknown first), then the smaller id.  Terms
    match as substrings, which tokens cannot answer, so each text passes once
    through an automaton of all terms; tasks return only their k best rows of
    each query.  Queries are sent to the tasks in blocks of bounded size.
    """
    spark = corpus.sparkSession
    asked = queries.select("query_id", lexical_terms(F.col("query")).alias("terms")).where(F.size("terms") > 0)
    rows = corpus.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"), F.col(quality_col).cast("double").alias("q"))
    kinds = dict(rows.dtypes)
    blocks = max(1, -(-asked.count() // BROADCAST_QUERIES))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("coverage"), F.desc_nulls_first("q"), "id"))
    out = None
    for i in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        known = [(r["query_id"], list(r["terms"])) for r in part.collect()]
        if not known:
            continue
        names = spark.createDataFrame([(n, x) for n, (x, _) in enumerate(known)], f"n int, query_id {dict(queries.dtypes)['query_id']}")
        local = rows.mapInArrow(_best_rows(spark.sparkContext.broadcast(known), max(k, 1)), f"n int, id {kinds['id']}, coverage double, q double")
        found = local.join(F.broadcast(names), "n").withColumn("rank", rank).where(F.col("rank") <= k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, id {kinds['id']}, coverage double, rank int")
    score = F.round(0.5 + 0.5 * F.col("coverage"), 4)
    return out.select("query_id", "id", "coverage", score.alias("score"), F.round(1 - score, 4).alias("distance"), "rank")


def enrich(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Provenance of the document from the catalog's enabled entries; blank where there is none.

    The catalog decides: provenance columns that the rows have are replaced.
    """
    names = ["source_id", "source_url", "publisher", "publication_date"]
    known = catalog.where("enabled").select("document_name", *names)
    met = rows.drop(*names).join(known, "document_name", "left")
    return met.withColumns({c: F.coalesce(c, F.lit("")) for c in names})


def is_certified(source_id: Column, url: Column) -> Column:
    return (F.coalesce(T.strip(source_id), F.lit("")) != "") & F.coalesce(F.lower(url).startswith("https://"), F.lit(False))


def lookup(corpus: DataFrame, requests: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Rows by id in the order asked for, repeats included: requests is (query_id, ids); missing ids give no row, pos is the place."""
    return requests.select("query_id", F.posexplode("ids").alias("pos", id_col)).join(corpus, id_col)


def _best_content(found: DataFrame, corpus: DataFrame, k: int, id_col: str) -> DataFrame:
    """The first k of each query's found rows that are no bibliographies, with the corpus' columns.

    What was found is written, so that its size is known and the corpus isn't
    shuffled to meet a few rows.
    """
    met = written(found, "found").join(corpus.withColumnRenamed(id_col, "id"), "id")
    # ranks are above 0; without them the condition would go below the join, to every text of the corpus
    good = met.where(F.when(F.col("rank") > 0, ~C.is_reference_only(F.col("section_title"), F.col("text"))))
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return good.withColumn("rank", again).where(F.col("rank") <= k)


def retrieve(corpus: DataFrame, queries: DataFrame, k: int = 5, threshold: float = THRESHOLD, id_col: str = "chunk_id", digits: int = 12) -> DataFrame:
    """Vector search that over-fetches 2k, then drops low scores and bibliographies, then keeps k: filters act after the first rank."""
    return _best_content(vector_topk(corpus, queries, 2 * k, id_col, digits=digits).where(F.col("score") >= threshold), corpus, k, id_col)


def retrieve_routed(corpus: DataFrame, queries: DataFrame, k: int = 5, threshold: float = THRESHOLD, id_col: str = "chunk_id") -> DataFrame:
    """query_id, id, score, distance, rank, retrieval_mode and the corpus' columns: each question by vector, or by its words where it has no vector.

    queries: query_id, query, query_vector (null where embedding failed) and,
    optionally, category.  A category admits its own rows and general ones;
    each category's questions pass over its part of the corpus.  Both ways
    over-fetch 2k, then drop low scores and bibliographies, then keep k.  Blank
    questions find nothing.  A corpus without categories is searched whole,
    without quality scores has unknown ones.
    """
    named = F.coalesce("category", F.lit("all")) if "category" in queries.columns else F.lit("all")
    asked = queries.where(F.length(T.strip(F.coalesce("query", F.lit("")))) > 0).withColumn("category", named)
    rows = corpus if "quality_score" in corpus.columns else corpus.withColumn("quality_score", F.lit(None).cast("double"))
    ways = ["all", *(L.CATEGORIES if "category" in corpus.columns else [])]
    found = None
    for way in ways:
        own = F.col("category") == way if way != "all" else ~F.col("category").isin(*ways[1:]) if ways[1:] else F.lit(True)
        mine, part = asked.where(own), rows.where(category_filter(way))
        near = vector_topk(part, mine.where("query_vector IS NOT NULL"), 2 * k, id_col).select("query_id", "id", "score", "distance", "rank", F.lit("vector").alias("retrieval_mode"))
        words = lexical_topk(part, mine.where("query_vector IS NULL"), 2 * k, id_col).select("query_id", "id", "score", "distance", "rank", F.lit("lexical").alias("retrieval_mode"))
        both = near.unionByName(words)
        found = both if found is None else found.unionByName(both)
    return _best_content(found.where(F.col("score") >= threshold), corpus, k, id_col)


def sufficient(found: DataFrame) -> DataFrame:
    """query_id and whether the best score is enough."""
    return found.groupBy("query_id").agg((F.max("score") >= SUFFICIENT).alias("sufficient"))


def has_document(corpus: DataFrame, names: DataFrame) -> DataFrame:
    return names.join(corpus.select("document_name").distinct(), "document_name", "left_semi")


def missing_documents(corpus: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """What an ingestion has to do: everything if forced, else documents that aren't stored."""
    return incoming if force else incoming.join(corpus.select("document_name").distinct(), "document_name", "left_anti")


def gate_status(query: Column, has_context: Column, history: Column, stale: Column) -> Column:
    """The first gate that stops a question, in order; null if it may be searched."""
    level = C.safety_level(query)
    return (
        F.when(T.strip(query) == "", "needs_clarification")
        .when(level == "emergency", "safety_blocked")
        .when((level == "high_risk") | C.unsupported_type(query), "out_of_scope")
        .when(C.needs_clarification(query, has_context), "needs_clarification")
        .when(C.is_out_of_domain(query, history), "out_of_scope")
        .when(stale, "stale_index")
    )


def stage_evidence(corpus: DataFrame, queries: DataFrame, catalog: DataFrame, k: int = 5, threshold: float = THRESHOLD, stale: Column | None = None) -> DataFrame:
    """One envelope per question (query_id, query, query_vector, history): status, rewritten query, category and the evidence in order.

    Questions that a gate stops are never searched; others are searched in the
    category that they are routed to, by their words if they have no vector.
    stale says of a question that its index is out of date.
    """
    history = F.coalesce("history", F.array().cast("array<string>"))
    asked = queries.withColumn("status", gate_status(F.col("query"), F.exists(history, lambda h: F.length(T.strip(h)) >= 8), history, F.lit(False) if stale is None else stale))
    rewritten = C.rewrite(F.col("query"), F.try_element_at(history, F.lit(-1)), F.size(history) > 0)
    asked = asked.withColumn("rewritten", rewritten).withColumn("category", C.route(F.col("rewritten"), F.lit("all")))
    asked = written(asked, "questions")  # the rules are long expressions, which each way of searching would repeat
    open_questions = asked.where("status is null")
    found = enrich(retrieve_routed(corpus, open_questions.select("query_id", F.col("rewritten").alias("query"), "query_vector", "category"), k, threshold), catalog)
    # evidence must name the condition that the question names
    named = found.join(open_questions.select("query_id", C.evidence_groups(F.col("query")).alias("__groups")), "query_id")
    found = named.where(C.matches_directly(F.col("__groups"), F.concat_ws(" ", "section_title", "text"))).drop("__groups")
    best = found.groupBy("query_id").agg(
        F.max("score").alias("best"),
        F.sort_array(F.collect_list(F.when(is_certified(F.col("source_id"), F.col("source_url")), F.struct("rank", "id", "score", "document_name", "source_id", "source_url")))).alias("chunks"),
    )
    out = asked.join(best, "query_id", "left")
    status = (
        F.when(F.col("status").isNotNull(), F.col("status"))
        .when(F.coalesce("best", F.lit(0.0)) < SUFFICIENT, "out_of_scope")
        .when(F.size("chunks") == 0, "invalid_provenance")
        .when(F.get("chunks", F.lit(0))["score"] < SUFFICIENT, "out_of_scope")
        .otherwise("ready")
    )
    return out.withColumn("status", status).select("query_id", "status", "rewritten", "category", F.when(F.col("status") == "ready", F.col("chunks")).alias("chunks"))


def rehydrate(corpus: DataFrame, requests: DataFrame, catalog: DataFrame, manifest_hash: str) -> DataFrame:
    """Reload evidence by id (query_id, ids, manifest_hash): ready only if the manifest agrees and every id is found and certified."""
    found = enrich(lookup(corpus, requests), catalog)
    n = found.groupBy("query_id").agg(F.count("*").alias("found"), F.count_if(is_certified(F.col("source_id"), F.col("source_url"))).alias("certified"))
    met = requests.join(n, "query_id", "left")
    wanted = F.size("ids")
    status = F.when(F.col("manifest_hash") != manifest_hash, "stale_index").when(F.coalesce("found", F.lit(0)) < wanted, "infrastructure_failure").when(F.col("certified") < wanted, "invalid_provenance").otherwise("ready")
    return met.select("query_id", status.alias("status"))
