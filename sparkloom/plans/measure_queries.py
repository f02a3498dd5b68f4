"""Queries: language profiles, stale indexes, percentiles by sketches, sinks, logs, ingestion and a grid of runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import classify
from sparkloom.operators import grid, langid, manifests, percentiles, telemetry, vectors
from sparkloom.plans.registry import query
from sparkloom.sources import ingestion, logs, workspace
from sparkloom.streaming import streams


@query(rf"""WITH w AS (SELECT lang, unnest(string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}]+', ' ', 'g')), ' ')) AS word FROM documents WHERE lang IS NOT NULL),
c AS (SELECT lang, word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2),
g AS (SELECT lang, k AS n, unnest(list_transform(range(1, length(word) + 4 - k), lambda i: substr(' ' || word || ' ', i, k))) AS gram, n AS own FROM c, (VALUES (1), (2), (3)) t(k)),
f AS (SELECT lang, n, gram, sum(own)::BIGINT AS count FROM g WHERE gram <> ' ' GROUP BY 1, 2, 3)
SELECT lang, n, gram, count, (sum(count) OVER (PARTITION BY lang, n))::BIGINT AS total FROM f QUALIFY row_number() OVER (PARTITION BY lang, n ORDER BY count DESC, gram) <= {langid.PROFILE}""")
def lang_profiles(t):
    return langid.profiles(t.documents)


def _held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


@query()
def lang_identified(t):
    """Languages and probabilities of all documents, by profiles of four fifths of them."""
    found = langid.identify(t.documents.select("doc_id", "text"), langid.fit(t.documents.where(~_held_out())))
    return found.select("doc_id", "language", F.round("probability", 6).alias("probability"))


@query()
def lang_heldout_accuracy(t):
    """Documents that the profiles have not seen: how many of each language they tell, and how many the vote of frequent words does."""
    rest = t.documents.where(_held_out()).select("doc_id", "lang", "text")
    told = langid.accuracy(langid.identify(rest, langid.fit(t.documents.where(~_held_out()))))
    voted = langid.accuracy(rest.withColumn("language", classify.language(F.col("text"))))
    return told.withColumn("method", F.lit("profiles")).unionByName(voted.withColumn("method", F.lit("words")))


_HASH = "sha256('{{\"chunk_profile\":\"large\",{0}\"dimension\":' || {1} || ',{2}\"embedding_model\":\"hashed\",\"embedding_provider\":\"local\",\"namespace\":\"' || namespace || '\",\"source_catalog_hash\":\"' || sha256(namespace) || '\"{3}}}')"
_MANIFEST = _HASH.format('"corpus_hash":"\' || corpus_hash || \'",', "384", '"document_chunk_counts":{\' || counts || \'},', ',"token_count":\' || token_count || \'')
_RUNTIME = _HASH.format("", "384", "", "")


@query(f"""WITH l AS (SELECT source AS namespace, lang, count(*) AS n, sum(n_chars) AS chars FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2),
m AS (SELECT namespace, sha256(string_agg(lang, ',' ORDER BY lang)) AS corpus_hash, string_agg('"' || lang || '":' || n, ',' ORDER BY lang) AS counts, sum(chars)::BIGINT AS token_count FROM l GROUP BY 1),
a AS (SELECT namespace, CASE WHEN token_count % 2 = 0 THEN {_MANIFEST} ELSE '' END AS active_hash FROM m
  UNION ALL SELECT namespace, {_RUNTIME} FROM (SELECT DISTINCT lang AS namespace FROM documents WHERE lang IS NOT NULL)),
r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS namespace, CASE WHEN doc_id % 3 = 0 THEN sha256(text) END AS index_hash FROM documents)
SELECT doc_id, coalesce(active_hash, '') AS active_hash, coalesce(active_hash, '') = '' OR coalesce(index_hash <> active_hash, false) AS stale FROM r LEFT JOIN a USING (namespace)""")
def fpr_stale_gate(t):
    """Sources as indexes with manifests, of which those with an odd count run in another width; languages as hosted indexes; documents ask."""
    docs = t.documents
    fixed = {"dimension": F.lit(384), "chunk_profile": F.lit("large"), "embedding_provider": F.lit("local"), "embedding_model": F.lit("hashed")}
    by_lang = docs.where("source IS NOT NULL AND lang IS NOT NULL").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    counts = by_lang.groupBy(F.col("source").alias("namespace")).agg(F.array_sort(F.collect_list(F.struct("lang", "n"))).alias("x"), F.sum("chars").alias("token_count"))
    own = counts.withColumns({**fixed, "source_catalog_hash": F.sha2("namespace", 256), "corpus_hash": F.sha2(F.array_join("x.lang", ","), 256), "document_chunk_counts": F.map_from_entries("x")}).drop("x")
    settings = ["namespace", *manifests.COMPARED, "hosted"]
    ran = own.withColumns({"dimension": F.when(F.col("token_count") % 2 == 0, 384).otherwise(768), "hosted": F.lit(False)}).select(settings)
    hosted = docs.where("lang IS NOT NULL").select(F.col("lang").alias("namespace")).distinct().withColumns({**fixed, "source_catalog_hash": F.sha2("namespace", 256), "hosted": F.lit(True)}).select(settings)
    asked = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.col("lang")).alias("namespace"), F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).alias("index_hash"))
    return manifests.with_stale(asked, manifests.active_hashes(ran.unionByName(hosted), own)).select("doc_id", "active_hash", "stale")


@query()
def tel_sketch_percentiles(t):
    """Latencies kept as a sketch for each day and type, rolled up by type, beside the exact percentiles."""
    kept = workspace.written(percentiles.sketches(t.events.withColumn("day", F.to_date("ts")), "value", ["day", "event_type"]), "sketches")
    rolled = percentiles.rolled_up(kept, telemetry.RANKS, ["event_type"]).withColumnRenamed("value", "estimate")
    return rolled.join(percentiles.exact(t.events, "value", telemetry.RANKS, ["event_type"]), ["event_type", "p"])


@query("SELECT event_type, p, v AS value FROM (SELECT event_type, unnest([0.01, 0.25, 0.5, 0.75, 0.999]) AS p, unnest(quantile_disc(value, [0.01, 0.25, 0.5, 0.75, 0.999])) AS v FROM events GROUP BY 1)")
def tel_exact_percentiles(t):
    return percentiles.exact(t.events, "value", (0.01, 0.25, 0.5, 0.75, 0.999), ["event_type"])


@query("SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def snk_bounded_log(t):
    """A log of the newest 2,000 events after the later half was appended before the earlier one."""
    path = workspace.new_path(t.spark, "log")
    rows = t.events.select("ts", "event_id", "user_id", "value")
    for half in (1, 0):
        logs.append_log(t.spark, path, rows.where(F.col("event_id") % 2 == half), ["ts", "event_id"], 2000)
    return logs.read_log(t.spark, path).select("event_id", "user_id", "value")


@query("SELECT sink, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, (VALUES ('log'), ('table')) s(sink) GROUP BY 1, 2")
def snk_fan_out(t):
    """Events streamed to two sinks, the second of which fails at first and catches up."""
    root = workspace.new_path(t.spark, "fan-out")
    failures = iter([True])
    table = logs.epoch_writer(f"{root}/table")

    def shaky(df, epoch):
        if next(failures, False):
            raise OSError("no connection")
        table(df, epoch)

    sinks = {"log": logs.epoch_writer(f"{root}/log", "json"), "table": shaky}
    events = streams.read_events(t.spark, f"{t.sf_dir}/event[s].parquet")  # a pattern serves a file and a folder
    logs.fan_out(events, sinks, f"{root}/ledger", f"{root}/checkpoint").awaitTermination()
    logs.deliver(t.spark, sinks, f"{root}/ledger")
    read = t.spark.read.schema(streams.EVENTS.replace("timestamp_ntz", "timestamp"))
    both = read.json(f"{root}/log/*").withColumn("sink", F.lit("log")).unionByName(read.parquet(f"{root}/table/*").withColumn("sink", F.lit("table")))
    return both.groupBy("sink", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


_PARTS = "list_filter(string_split(text, chr(10)), lambda x: length(x) >= 40)"


@query(f"""WITH d AS (SELECT doc_id::VARCHAR AS document_name, text, len({_PARTS}) AS n, doc_id % 10 = 0 AS again FROM documents)
SELECT document_name, CASE WHEN e OR n = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN e THEN 'extract' WHEN n = 0 THEN 'split' END AS step, CASE WHEN e THEN 'no text' WHEN n = 0 THEN 'nothing left' END AS error,
  CASE WHEN e THEN 0 ELSE n END AS n, CASE WHEN again OR e OR n = 0 THEN 2 ELSE 1 END AS run FROM (SELECT *, trim(coalesce(text, '')) = '' AS e FROM d)""")
def src_ingestion_states(t):
    """Documents in two runs: the second takes those that failed, and one in ten that are forced."""
    store = workspace.new_path(t.spark, "ingestion")
    docs = t.documents.select(F.col("doc_id").cast("string").alias("document_name"), "text", (F.col("doc_id") % 10 == 0).alias("again"))
    steps = [
        ("extract", lambda r: r.withColumn("error", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text"))),
        ("split", lambda r: r.select("document_name", F.explode(F.split("text", "\n")).alias("text")).where("length(text) >= 40")),
    ]
    ingestion.ingest(docs, steps, store)
    failed = ingestion.states(t.spark, store).where("status = 'failed'").select("document_name", F.lit(True).alias("failed"))
    second = docs.join(failed, "document_name", "left").where("again OR failed").drop("failed")
    ingestion.ingest(second, steps, store, force=True)
    return ingestion.states(t.spark, store)


_WIDTHS = {"whole": 64, "half": 32, "quarter": 16}


@query(f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), w(profile, width) AS (VALUES {", ".join(f"('{k}', {n})" for k, n in _WIDTHS.items())}),
s AS (SELECT profile, q.vec_id AS q, q.label AS wanted, e.vec_id, e.label, row_number() OVER (PARTITION BY profile, q.vec_id ORDER BY list_cosine_distance(q.v[1:width], e.v[1:width]), e.vec_id) AS r FROM w, e q, e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
c AS (SELECT profile, q, count(*) FILTER (WHERE label = wanted) AS n FROM s WHERE r <= 5 GROUP BY 1, 2)
SELECT profile || '_cosine' AS run_id, round(avg(round(n / 5, 4)), 4) AS precision_at_5, round(avg((n > 0)::INT), 4) AS hit_at_5, true AS labels_complete FROM c GROUP BY profile""")
def evl_grid_results(t):
    """A grid of vector widths, broken off after its first cell and run again; vectors of the question's label are relevant."""
    folder = workspace.new_path(t.spark, "grid")
    asked = t.embeddings.where("vec_id % 50 = 0")
    label = t.embeddings.select(F.col("vec_id").alias("item"), "label")
    wanted = asked.select(F.col("vec_id").alias("case_id"), F.col("label").alias("wanted"))

    def evaluate(profile, provider):
        cut = F.slice("embedding", 1, _WIDTHS[profile])
        found = vectors.vector_topk(t.embeddings.withColumn("embedding", cut), asked.select(F.col("vec_id").alias("query_id"), cut.alias("query_vector")), 6, "vec_id")
        others = found.where("id <> query_id")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        return others.withColumn("rank", place).where("rank <= 5").select(F.col("query_id").alias("case_id"), "rank", F.col("id").alias("item"), F.lit(1.0).alias("latency_ms"), F.lit(0.0).alias("cost_usd"))

    def judge(rankings):
        met = rankings.join(label, "item").join(wanted, "case_id")
        return met.select("case_id", "rank", F.when(F.col("label").eqNullSafe(F.col("wanted")), "relevant").otherwise("not_relevant").alias("relevance"))

    cells = [(profile, "cosine") for profile in _WIDTHS]
    grid.run_grid(t.spark, cells[:1], evaluate, judge, folder)
    grid.run_grid(t.spark, cells, evaluate, judge, folder)
    candidates = grid.results(t.spark, cells, wanted.select("case_id", F.lit(True).alias("expect_evidence")), folder)
    return candidates.select("run_id", "precision_at_5", "hit_at_5", "labels_complete")
