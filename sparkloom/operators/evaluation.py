"""Evaluation: token overlap, faithfulness, ranking metrics, candidate selection and the rollout gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import lexicon as L
from sparkloom.functions import text as T
from sparkloom.operators import percentiles

QUALITY_KEYS = ["hit_rate_at_5", "recall_at_5", "ndcg_at_5", "task_success"]


def token_overlap(pairs: DataFrame, id_col: str, prediction: str, reference: str, tokens: Callable[[Column], Column] = T.folded_tokens) -> DataFrame:
    """Multiset precision, recall and F1 of word tokens (folded ones, if not told otherwise), six decimals; two empty texts agree wholly."""

    def counts(c: str, name: str) -> DataFrame:
        return pairs.select(id_col, F.explode(tokens(F.col(c).cast("string"))).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias(name))

    both = counts(prediction, "a").join(counts(reference, "b"), [id_col, "token"], "full")
    sums = both.groupBy(id_col).agg(F.sum(F.coalesce("a", F.lit(0))).alias("n_a"), F.sum(F.coalesce("b", F.lit(0))).alias("n_b"), F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))).alias("n"))
    met = pairs.select(id_col).join(sums, id_col, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)) == 0
    p, r = F.col("n") / F.nullif(F.col("n_a"), F.lit(0)), F.col("n") / F.nullif(F.col("n_b"), F.lit(0))
    value = lambda v: F.when(zero("n_a") & zero("n_b"), 1.0).when(zero("n"), 0.0).otherwise(F.round(v, 6))
    return met.select(id_col, value(p).alias("token_precision"), value(r).alias("token_recall"), value(2 * p * r / (p + r)).alias("token_f1"))


def scoreable(answer: Column) -> Column:
    """The answer without one disclaimer at its end and without citation marks."""
    cut = answer
    for note in (n for pair in L.DISCLAIMERS.values() for n in pair if n):
        cut = F.when(answer.endswith(note), F.substring(answer, F.lit(1), F.length(answer) - len(note))).otherwise(cut)
    return T.strip(F.regexp_replace(cut, r"\s*\[E[0-9]+\]", ""))


def faithfulness(answers: DataFrame, contexts: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Share of an answer's sentences half of whose tokens stand in its contexts: answers (id, answer), contexts (id, text)."""
    known = contexts.select(id_col, F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token")).distinct()
    claims = answers.select(id_col, F.posexplode(F.filter(F.transform(F.split(scoreable(F.col("answer")), r"(?<=[.!?؟])\s+"), T.strip), lambda s: s != "")).alias("pos", "claim"))
    words = claims.select(id_col, "pos", F.explode_outer(T.tokens(F.col("claim"))).alias("token"))
    met = words.join(known.withColumn("known", F.lit(1)), [id_col, "token"], "left")
    per_claim = met.groupBy(id_col, "pos").agg((F.sum(F.coalesce("known", F.lit(0))) / F.nullif(F.count("token"), F.lit(0))).alias("share"))
    some = known.select(id_col).distinct()
    return per_claim.join(some, id_col, "left_semi").groupBy(id_col).agg(F.round(F.count_if(F.col("share") >= 0.5) / F.count("*"), 6).alias("faithfulness"))


def ranking_metrics(ranking: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """hit, precision, recall, reciprocal rank, average precision and nDCG at k for each query of the pool.

    ranking is (query_id, rank, item); pool is (query_id, item, grade), grades
    above 0.  The ranking is cut to k first, then repeated items are dropped.
    Gains are linear in the grade; the ideal is the pool cut to k.
    """
    cut = ranking.where(F.col("rank") <= k)
    seen = F.row_number().over(Window.partitionBy("query_id", "item").orderBy("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    ranked = cut.withColumn("__n", seen).where("__n = 1").withColumn("at", place).join(pool.where("grade > 0"), ["query_id", "item"], "left")
    hit = F.col("grade").isNotNull()
    upto = F.sum(hit.cast("int")).over(Window.partitionBy("query_id").orderBy("at"))
    sums = ranked.withColumn("upto", upto).groupBy("query_id").agg(
        F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("at"))).alias("first"), F.sum(F.when(hit, F.col("upto") / F.col("at"))).alias("ap"), F.sum(F.when(hit, F.col("grade") / F.log2(F.col("at") + 1))).alias("dcg")
    )
    ideal = pool.where("grade > 0").withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "item")))
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("size"), F.sum(F.when(F.col("at") <= k, F.col("grade") / F.log2(F.col("at") + 1))).alias("best"))
    met = ideal.join(sums, "query_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    hits = F.coalesce("hits", F.lit(0))
    return met.select(
        "query_id", (hits > 0).cast("double").alias("hit_rate_at_k"), F.round(hits / k, 6).alias("precision_at_k"), F.round(hits / F.col("size"), 6).alias("recall_at_k"),
        F.round(z(1.0 / F.col("first")), 6).alias("reciprocal_rank"), F.round(z(F.col("ap")) / F.col("size"), 6).alias("average_precision"), F.round(z(F.col("dcg")) / F.col("best"), 6).alias("ndcg_at_k"),
    )


def macro_at_k(labels: DataFrame, cases: DataFrame, k_values: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """Per k: macro precision, hit and recall of cases that expect evidence, refusal pass rate of the others; four decimals.

    labels is (case_id, rank, relevance), cases (case_id, expect_evidence).
    """
    grid = cases.select("case_id", "expect_evidence", F.explode(F.array(*map(F.lit, k_values))).alias("k"))
    good = labels.where("relevance = 'relevant'").select("case_id", "rank").distinct()
    n = grid.join(good, "case_id", "left").groupBy("case_id", "expect_evidence", "k").agg(F.count_if(F.col("rank") <= F.col("k")).alias("n"))
    hit = (F.col("n") > 0).cast("double")
    return n.groupBy("k").agg(
        F.round(F.avg(F.when(F.col("expect_evidence"), F.round(F.col("n") / F.col("k"), 4))), 4).alias("macro_precision_at_k"), F.round(F.avg(F.when(F.col("expect_evidence"), hit)), 4).alias("hit_at_k"),
        F.round(F.avg(F.when(F.col("expect_evidence"), hit)), 4).alias("macro_recall_at_k"), F.round(F.avg(F.when(~F.col("expect_evidence"), 1 - hit)), 4).alias("no_evidence_refusal_pass_rate"),
    )


def unlabelled(rankings: DataFrame, labels: DataFrame) -> DataFrame:
    """Ranked rows (case_id, rank) without a judgement."""
    return rankings.join(labels.where("relevance in ('relevant', 'not_relevant')"), ["case_id", "rank"], "left_anti")


def select_candidate(candidates: DataFrame) -> DataFrame:
    """The winning candidate and its runtime k, or no row if none is eligible.

    Eligible: precision@5 0.40, hit@5 0.90, all refusals, complete labels.  Each
    provider's best goes on; of local and hosted a lead of 0.05 in precision
    decides, else cost, then latency, then local.
    """
    eligible = candidates.where("precision_at_5 >= 0.40 AND hit_at_5 >= 0.90 AND refusal_pass_rate = 1.0 AND labels_complete")
    order = Window.partitionBy("provider").orderBy(F.desc("precision_at_5"), F.desc("hit_at_5"), "mean_latency_ms", "estimated_cost_usd", "profile")
    winners = eligible.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    best = winners.agg(F.max("precision_at_5").alias("top"), F.min("precision_at_5").alias("low"), F.count("*").alias("n"))
    met = winners.crossJoin(best)  # one row on the right: the extremes of the few winners
    close = (F.col("n") > 1) & (F.round(F.col("top") - F.col("low"), 9) < 0.05)
    keys = [F.when(close, F.col("estimated_cost_usd")).otherwise(-F.col("precision_at_5")), F.when(close, F.col("mean_latency_ms")).otherwise(0.0), (F.col("provider") != "local").cast("int"), F.col("provider")]
    winner = met.orderBy(*keys).limit(1)
    per_k = winner.select("*", F.explode("per_k").alias("runtime_k", "__m")).where("__m.hit_at_k >= 0.80")
    return per_k.orderBy(F.desc("__m.macro_precision_at_k"), "runtime_k").limit(1).drop("__m", "top", "low", "n")


def rollout_checks(previous: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row per check of a candidate stage against the one before: name, passed."""
    c = candidate.select(*(F.col(x).alias(f"c_{x}") for x in candidate.columns))
    p = previous.select(*(F.col(x).alias(f"p_{x}") for x in previous.columns))
    both = c.join(p, F.lit(True), "left")  # one row each
    checks = {
        "document_completeness": F.col("c_verified_documents") == F.col("c_expected_documents"),
        "document_checksums": F.col("c_checksums_match"),
        "vector_dimensions": F.col("c_invalid_vector_count") == 0,
        **{k: F.col(f"c_{k}") >= F.col(f"p_{k}") - 0.02 for k in QUALITY_KEYS},
        "retrieval_p95": F.col("c_retrieval_p95_ms") <= 2 * F.col("p_retrieval_p95_ms"),
        **{k: F.col(f"c_{k}") for k in ("provenance_pass", "citations_pass", "refusal_pass", "preview_logs_clean")},
    }
    rows = F.array(*(F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()))
    return both.select(F.explode(rows).alias("c")).select("c.name", "c.passed")


def match_cases(queries: DataFrame, cases: DataFrame) -> DataFrame:
    """query_id, case_id and match: the case that a query (query_id, query, case_id) belongs to, and how that was found.

    A case_id that is given decides alone: `explicit_case_id`, or
    `unknown_case_id` without a case.  Else texts whose words agree, those of a
    case's query (`canonical_query`) before those of a variant
    (`reviewed_variant`); else `unlabeled_query`.  Of several cases the
    smallest id is taken; near matches are none.
    """
    given = F.coalesce(F.col("case_id").cast("string"), F.lit("")) != ""
    keys = queries.select("query_id", "case_id", given.alias("given"), T.normalize_words(F.coalesce("query", F.lit(""))).alias("words"))
    known = cases.select(F.col("case_id").alias("of"), F.coalesce("query", F.lit("")).alias("text"), F.coalesce("query_variants", F.array().cast("array<string>")).alias("variants"))
    texts = known.select("of", F.lit(0).alias("kind"), "text").unionByName(known.select("of", F.lit(1).alias("kind"), F.explode("variants").alias("text")))
    by_text = texts.where("text IS NOT NULL").groupBy(T.normalize_words(F.col("text")).alias("words")).agg(F.min(F.struct("kind", "of")).alias("m"))
    by_id = known.select("of").distinct()
    met = keys.join(by_id, F.col("given") & (F.col("case_id") == F.col("of")), "left").join(by_text, "words", "left")
    match = F.when(F.col("given"), F.when(F.col("of").isNotNull(), "explicit_case_id").otherwise("unknown_case_id"))
    match = match.when(F.col("m").isNull(), "unlabeled_query").when(F.col("m.kind") == 0, "canonical_query").otherwise("reviewed_variant")
    return met.select("query_id", F.when(F.col("given"), F.col("of")).otherwise(F.col("m.of")).alias("case_id"), match.alias("match"))


def embedding_cost(provider: Column, tokens: Column) -> Column:
    """0.20 USD a million tokens if hosted, nothing if local."""
    return F.when(provider == "local", 0.0).otherwise(F.round(tokens / 1_000_000 * 0.20, 8))


def answer_metrics(answers: DataFrame, references: DataFrame) -> DataFrame:
    """Best reference by F1, and whether any is the same: answers (query_id, answer), references (query_id, reference)."""
    pairs = answers.select("query_id", scoreable(F.col("answer")).alias("answer")).join(references, "query_id").withColumn("pair", F.struct("query_id", "reference"))
    scores = token_overlap(pairs.dropDuplicates(["pair"]), "pair", "answer", "reference")
    same = lambda c: F.array_join(T.tokens(F.col(c)), " ")
    exact = pairs.groupBy("query_id").agg(F.max((same("answer") == same("reference")).cast("double")).alias("exact_match"))
    order = F.struct(F.col("token_f1"), F.col("pair.reference"))
    best = scores.groupBy(F.col("pair.query_id").alias("query_id")).agg(F.max_by(F.struct("token_precision", "token_recall", "token_f1"), order).alias("m"))
    return best.join(exact, "query_id").select("query_id", "exact_match", "m.*")


def anchor_relevance(results: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, rank, relevance of results by their case's anchors: source, document and page agree, the section holds the expected one, the text one of the anchors."""
    met = results.join(cases, "case_id")
    words = lambda c: F.array_join(T.tokens(c), " ")
    place = (F.col("source_id") == F.col("expected_source_id")) & (F.col("document_name") == F.col("expected_document_name")) & (F.col("page_number") == F.col("expected_page"))
    section = (F.coalesce("expected_section", F.lit("")) == "") | F.contains(words(F.col("section_title")), words(F.col("expected_section")))
    anchor = F.exists("text_anchors", lambda a: F.contains(words(F.col("text")), words(a)))
    good = F.col("expect_evidence") & F.coalesce(place & section & anchor, F.lit(False))
    return met.select("case_id", "rank", F.when(good, "relevant").otherwise("not_relevant").alias("relevance"))


def relevance_grades(results: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, rank, grade: the best grade of the judged items that a result matches, by chunk id or, for items without one, by place (blanks match all).

    An item that names another chunk still counts where the place agrees and the
    text holds one of its anchors.  Two equi-joins instead of a nested loop: by
    chunk id, and by query for the few items that a query has.
    """
    by_id = results.join(items.where("coalesce(chunk_id, '') <> ''").select("query_id", "chunk_id", "relevance_grade"), ["query_id", "chunk_id"]).select("query_id", "rank", F.col("relevance_grade").alias("grade"))
    i = items.select("query_id", *(F.col(c).alias(f"i_{c}") for c in ("chunk_id", "source_id", "document_name", "page_number", "relevance_grade", "anchors")))
    met = results.join(i, "query_id")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0")
    place = F.lit(True)
    for c in ("source_id", "document_name", "page_number"):
        place = place & (blank(f"i_{c}") | (F.col(f"i_{c}") == F.col(c)))
    words = lambda c: F.array_join(T.tokens(c), " ")
    anchored = F.exists(F.coalesce("i_anchors", F.array().cast("array<string>")), lambda a: F.contains(words(F.col("text")), words(a)))
    by_place = met.where(place & (blank("i_chunk_id") | anchored)).select("query_id", "rank", F.col("i_relevance_grade").alias("grade"))
    best = by_id.unionByName(by_place).groupBy("query_id", "rank").agg(F.max("grade").alias("grade"))
    return results.select("query_id", "rank").join(best, ["query_id", "rank"], "left").select("query_id", "rank", F.coalesce("grade", F.lit(0)).alias("grade"))


def task_results(traces: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, rule, passed for each rule that a case names; unknown rules have null.

    traces: case_id, status, answer, citations, sources, generation_provider,
    retrieval_count; cases: case_id, task_pass_rules, expected_status,
    required_claims, expected_sources, accepted.
    """
    met = traces.join(cases, "case_id").withColumn("rule", F.explode(F.when(F.size("task_pass_rules") > 0, F.col("task_pass_rules")).otherwise(F.array(F.lit("expected_status")))))
    said = F.array_join(T.tokens(F.col("answer")), " ")
    count = lambda tokens, t: F.size(F.filter(tokens, lambda x: x == t))
    covered = lambda claim: F.forall(F.array_distinct(T.tokens(claim)), lambda t: count(T.tokens(claim), t) <= count(T.tokens(F.col("answer")), t))
    rules = {
        "expected_status": (F.col("status") == F.col("expected_status")) | (F.col("expected_status") == "ready") & F.col("status").isin("ok", "ok_with_fallback"),
        "required_claims_present": (F.size("required_claims") > 0) & F.forall("required_claims", covered),
        "certified_citation_present": (F.coalesce("citations", F.lit("")) != "") & F.arrays_overlap("sources", "expected_sources"),
        "generation_not_called": F.col("generation_provider") == "not_called",
        "retrieval_not_called": F.coalesce("retrieval_count", F.lit(0)) == 0,
        "structured_fields_present": T.strip(F.col("answer")) != "",
        "answer_contains_accepted_value": F.exists("accepted", lambda a: F.contains(said, F.array_join(T.tokens(a), " "))),
    }
    passed = F.lit(None).cast("boolean")
    for name, value in rules.items():
        passed = F.when(F.col("rule") == name, F.coalesce(value, F.lit(False))).otherwise(passed)
    return met.select("case_id", "rule", passed.alias("passed"))


def task_success(results: DataFrame) -> DataFrame:
    """case_id and whether all rules that apply passed; null if none applies."""
    return results.groupBy("case_id").agg(F.bool_and("passed").alias("task_success"))


def run_summary(latencies: DataFrame) -> DataFrame:
    """Per run of a benchmark (run_id, latency_ms): mean and its 95th percentile, which here is the element floor(0.95 n) - 1 in order; two decimals."""
    runs = latencies.groupBy("run_id").agg(F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms"))
    late = percentiles.exact(latencies, "latency_ms", [0.95], ["run_id"], rank=F.floor).select(F.col("run_id").alias("of"), F.round("value", 2).alias("p95_latency_ms"))
    return runs.join(late, F.col("run_id").eqNullSafe(F.col("of")), "left").drop("of")


def experiment_grid(profiles: DataFrame, providers: DataFrame) -> DataFrame:
    """Every profile with every provider: a handful of rows on both sides."""
    return profiles.crossJoin(F.broadcast(providers)).withColumn("run_id", F.concat_ws("_", "profile", "provider"))


def needs_backfill(traces: DataFrame, version: str) -> DataFrame:
    """Traces whose metrics an older version computed."""
    return traces.where(F.coalesce("metric_version", F.lit("")) != version)


def stage_measures(metrics: DataFrame, latencies: DataFrame, audit: DataFrame) -> DataFrame:
    """One row: means of the ranking metrics, nearest-rank 95th percentile of latency, and the audit's totals."""
    means = metrics.agg(*(F.round(F.avg(c), 6).alias(c) for c in metrics.columns if c != "query_id"))
    slow = percentiles.exact(latencies, "latency_ms", [0.95]).agg(F.round(F.max("value"), 2).alias("retrieval_p95_ms"))
    totals = audit.agg(F.count("*").alias("verified_documents"), F.sum("chunks").alias("chunks"), F.sum("invalid_vectors").alias("invalid_vector_count"))
    return means.crossJoin(slow).crossJoin(totals)  # one row each


def unjudged(ranking: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """(case_id, rank) of the first k places of rankings whose label is missing or says unjudged; a label of another word fails the job."""
    known = F.col("relevance").isin("relevant", "not_relevant", "unjudged")
    word = F.coalesce("relevance", F.lit("unjudged"))
    checked = labels.select("case_id", "rank", F.when(known | F.col("relevance").isNull(), word).otherwise(F.raise_error(F.concat(F.lit("invalid relevance label: "), F.col("relevance")))).alias("word"))
    met = ranking.where(F.col("rank") <= k).select("case_id", "rank").distinct().join(checked, ["case_id", "rank"], "left")
    return met.where(F.coalesce("word", F.lit("unjudged")) == "unjudged").select("case_id", "rank")


def unreviewed(labels: DataFrame, certified: str = "certified_anchor_oracle") -> DataFrame:
    """(case_id, rank) of labels that neither a certified method nor two agreeing reviewers have settled."""
    final = F.coalesce("relevance", F.lit("unjudged"))
    signed = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    agreed = signed("reviewer_a") & signed("reviewer_b") & (F.coalesce("reviewer_a_label", F.lit("unjudged")) == final) & (F.coalesce("reviewer_b_label", F.lit("unjudged")) == final) & (final != "unjudged")
    settled = F.when(F.coalesce(F.col("label_method") == certified, F.lit(False)), final.isin("relevant", "not_relevant")).otherwise(agreed)
    return labels.where(~settled).select("case_id", "rank")


def require_none(problems: DataFrame, what: str, shown: int = 10) -> None:
    """Fails if there are (case_id, rank) rows; the message names the first ones and how many more there are."""
    n = problems.count()
    if n:
        first = ", ".join(f"{r['case_id']}#{r['rank']}" for r in problems.orderBy("case_id", "rank").limit(shown).collect())
        raise ValueError(f"{what}: {first}" + (f" … and {n - shown} more" if n > shown else ""))


def backfill(records: DataFrame, version: str, recompute) -> tuple[DataFrame, DataFrame]:
    """Records of another metric version with their metrics computed anew, and one row of counts: updated, skipped, unavailable_metrics.

    recompute gives the old records with new `quality_metrics` (a map of structs
    with `applicable`); records of this version are skipped.
    """
    same = F.coalesce(F.col("metric_implementation_version") == version, F.lit(False))
    patched = recompute(records.where(~same)).withColumns({"metric_implementation_version": F.lit(version), "backfilled_at": F.current_timestamp()})
    missing = F.size(F.filter(F.map_values("quality_metrics"), lambda m: ~F.coalesce(m["applicable"], F.lit(False))))
    sums = patched.agg(F.count("*").alias("updated"), F.coalesce(F.sum(F.greatest(missing, F.lit(0))), F.lit(0)).alias("unavailable_metrics"))
    skipped = records.agg(F.count_if(same).alias("skipped"))
    return patched, sums.join(skipped).select("updated", "skipped", "unavailable_metrics")


def answer_checks(answers: DataFrame) -> DataFrame:
    """End-to-end checks of answers (case_id, expect_evidence, status, answer, n_evidence, safety): case_id and one column per check, null where it doesn't apply."""
    ready = F.col("status") == "ready"
    cited = F.col("answer").rlike(r"\[E[0-9]+\]")
    note = F.lit(None).cast("string")
    for level, (english, arabic) in L.DISCLAIMERS.items():
        note = F.when(F.col("safety") == level, F.when(T.is_arabic(F.col("answer")), arabic).otherwise(english)).otherwise(note)
    return answers.select(
        "case_id", F.when(F.col("expect_evidence"), ready & (F.col("n_evidence") > 0)).alias("retrieval_ok"), F.when(~F.col("expect_evidence"), ~ready & ~cited).alias("refusal_ok"),
        F.when(ready, cited).alias("citation_ok"), F.when(ready & (F.length(note) > 0), F.endswith("answer", note)).alias("disclaimer_ok"),
    )
