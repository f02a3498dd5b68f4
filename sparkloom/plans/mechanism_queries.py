"""Queries over embeddings that build an index, a neighbour graph, clusters or a layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import ann, density, embedding, evaluation, layout2d, retrieval, telemetry, vectors
from sparkloom.functions import lexicon as L
from sparkloom.plans.data_queries import _DIGITS, _UNIT, _pairs, _queries, _shown, _top
from sparkloom.plans.registry import query, quoted
from sparkloom.sources import workspace


def _index(t):
    return ann.build(t.embeddings, workspace.new_path(t.spark, "index"), id_col="vec_id")


@query(f"WITH {_UNIT}, {_pairs('q.vec_id % 50 = 0')} {_top(10)}")
def vec_index_all_lists(t):
    """The index with all of its lists probed: the exact result."""
    index = _index(t)
    return _shown(ann.search(index, _queries(t, "vec_id % 50 = 0"), 10, probes=index.lists, digits=_DIGITS))


@query()
def vec_index_recall(t):
    """How many of the ten nearest three fifths of the lists find; the vectors have random directions, which lists tell apart worst."""
    index, asked = _index(t), _queries(t, "vec_id % 50 = 0")
    return ann.recall(ann.search(index, asked, 10, probes=-(-3 * index.lists // 5)), vectors.vector_topk(t.embeddings, asked, 10, "vec_id"))


_NEAR = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT * FROM (SELECT a.vec_id AS u, b.vec_id AS v, round(list_distance(a.v, b.v), 12) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)
  QUALIFY row_number() OVER (PARTITION BY u ORDER BY d, v) <= 15)"""


@query(f"WITH {_NEAR} SELECT u, v, round(d, 6) AS distance FROM n")
def vec_neighbour_graph(t):
    return density.neighbours(t.embeddings, 15).select("u", "v", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_NEAR}, c AS (SELECT u, max(d) AS core FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d, v) AS r FROM n) WHERE r <= 3 GROUP BY u),
p AS (SELECT least(u, v) AS u, greatest(u, v) AS v, min(d) AS d FROM n GROUP BY 1, 2)
SELECT p.u, p.v, round(greatest(d, a.core, b.core), 6) AS w FROM p JOIN c a ON a.u = p.u JOIN c b ON b.u = p.v""")
def vec_mutual_reachability(t):
    return density.reachability(density.neighbours(t.embeddings, 15), 3).select("u", "v", F.round("w", 6).alias("w"))


@query()
def vec_density_clusters(t):
    """Tested against a tree of all pairs."""
    out = density.density_clusters(t.embeddings, 5, 1)
    return out.select("vec_id", "label", F.round("probability", 6).alias("probability"))


@query()
def vec_reduce_layout(t):
    """Places in the plane, to three decimals; tests measure the neighbours kept."""
    out = layout2d.reduce(t.embeddings)
    return out.select("vec_id", F.transform("reduced", lambda x: F.round(x, 3)).alias("reduced"))


@query()
def vec_layout_kept_neighbours(t):
    """Share of each vector's 15 nearest, by direction, that are among its 15 nearest in the plane, under the layout and under principal components."""
    held = []
    plane = layout2d.reduce(t.embeddings, keep_near=held)
    pca = vectors.reduce_dimensions(t.embeddings).select("vec_id", "reduced")
    shares = [layout2d.kept_neighbours(held[0], x).select(F.lit(name).alias("method"), "kept") for name, x in (("layout", plane), ("components", pca))]
    return shares[0].unionByName(shares[1])


_WORDS = "array_to_string(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+'), ' ')"


@query(f"""WITH q AS (
  SELECT item_id AS query_id, upper(text) || '!' AS query, CASE item_id % 5 WHEN 0 THEN item_id::VARCHAR WHEN 1 THEN 'gone-' || item_id ELSE '' END AS case_id FROM benchmark
  UNION ALL SELECT 100000 + item_id, substr(text, 1, 30), '' FROM benchmark UNION ALL SELECT 200000 + doc_id, substr(text, 1, 200), NULL FROM documents),
c AS (SELECT words, min((kind, id)) AS m FROM (
  SELECT {_WORDS.format("text")} AS words, 0 AS kind, item_id::VARCHAR AS id FROM benchmark UNION ALL SELECT {_WORDS.format("substr(text, 1, 30)")}, 1, item_id::VARCHAR FROM benchmark) GROUP BY 1),
k AS (SELECT q.*, m[1] AS kind, m[2] AS of, EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id::VARCHAR = q.case_id) AS known FROM q LEFT JOIN c ON c.words = {_WORDS.format("q.query")})
SELECT query_id, CASE WHEN coalesce(case_id, '') <> '' THEN CASE WHEN known THEN case_id END ELSE of END AS case_id,
  CASE WHEN coalesce(case_id, '') <> '' THEN CASE WHEN known THEN 'explicit_case_id' ELSE 'unknown_case_id' END WHEN kind IS NULL THEN 'unlabeled_query' WHEN kind = 0 THEN 'canonical_query' ELSE 'reviewed_variant' END AS match FROM k""")
def evl_match_cases(t):
    """Passages as cases, their beginnings as variants; passages shouted, beginnings and documents ask."""
    item = F.col("item_id").cast("string")
    start = F.substring("text", 1, 30)
    cases = t.benchmark.select(item.alias("case_id"), F.col("text").alias("query"), F.array(start).alias("query_variants"))
    given = F.when(F.col("item_id") % 5 == 0, item).when(F.col("item_id") % 5 == 1, F.concat(F.lit("gone-"), item)).otherwise("")
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.concat(F.upper("text"), F.lit("!")).alias("query"), given.alias("case_id"))
    asked = asked.unionByName(t.benchmark.select((F.col("item_id") + 100_000).alias("query_id"), start.alias("query"), F.lit("").alias("case_id")))
    asked = asked.unionByName(t.documents.select((F.col("doc_id") + 200_000).alias("query_id"), F.substring("text", 1, 200).alias("query"), F.lit(None).cast("string").alias("case_id")))
    return evaluation.match_cases(asked, cases)


def _error_sql(column: int) -> str:
    """CASE over the kinds of errors: their code, status or whether they may be tried again."""
    out = "CASE"
    for name, statuses, parts, again in L.PROVIDER_ERRORS:
        one = {"invalid_api_key": 400, "invalid_request": 400}.get(name, statuses[0] if len(statuses) == 1 else None)
        value = (quoted(name), f"coalesce(status, {one if one else 'NULL'})", str(again).lower())[column]
        hits = [f"contains(said, {quoted(p)})" for p in parts] + ([f"coalesce(status IN ({', '.join(map(str, statuses))}), false)"] if statuses else [])
        out += f" WHEN {' OR '.join(hits)} THEN {value}"
    return out + f" ELSE {("'unknown_error'", "status", "false")[column]} END"


@query(f"""WITH m AS (SELECT doc_id, lower(text) AS said, nullif(regexp_extract(lower(text), '\\b(400|401|403|404|408|409|429|500|502|503|504)\\b', 1), '')::INT AS status, text FROM documents)
SELECT doc_id, {_error_sql(0)} AS code, ({_error_sql(1)})::INT AS http_status, {_error_sql(2)} AS retryable FROM m""")
def tel_provider_errors(t):
    """Texts in the role of messages, without a status: words and numbers in them decide."""
    return telemetry.provider_errors(t.documents.select("doc_id", "text"), "text")


@query()
def ret_routed_fallback(t):
    """Passages ask documents; the model fails for those of an odd length, which are searched by their words."""

    def model(texts):
        if any(len(x) % 2 for x in texts):
            raise TimeoutError
        return embedding.hashed_words(texts)

    corpus = embedding.embed(t.documents.select(F.col("doc_id").alias("chunk_id"), "text", F.lit("").alias("section_title")))
    asked = embedding.try_embed(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), model)
    found = retrieval.retrieve_routed(corpus, asked, 5, 0.0)
    return found.select("query_id", "id", F.round("score", 3).alias("score"), "rank", "retrieval_mode")
