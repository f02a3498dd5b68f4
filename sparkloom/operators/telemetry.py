"""Telemetry: reports over request traces, latest state, drift between runs, rolling quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import lexicon as L
from sparkloom.operators import percentiles

PACIFIC = "America/Los_Angeles"
RANKS = (0.5, 0.95, 0.99)


def nearest_rank(c: Column, p: float) -> Column:
    """Percentile that is one of the values: element ceil(p * n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{c}`)") if isinstance(c, str) else F.percentile(c, p)


def report(traces: DataFrame) -> DataFrame:
    """One row: requests, conversations, availability, error rate and latency percentiles of finished traces."""
    done = traces.where("coalesce(status, '') <> 'running'")
    ok = F.coalesce(~F.col("status").isin(L.OPERATIONAL_FAILURES), F.lit(True))
    ranks = percentiles.columns(percentiles.exact(done, "total_ms", RANKS), RANKS)
    summary = done.agg(
        F.count("*").alias("requests"), F.countDistinct(F.nullif("conversation_id", F.lit(""))).alias("conversations"), F.round(F.count_if(ok) / F.nullif(F.count("*"), F.lit(0)), 6).alias("availability"),
        F.round(F.count_if(~ok) / F.nullif(F.count("*"), F.lit(0)), 6).alias("error_rate"),
    )
    both = summary.withColumn("one", F.lit(1)).join(ranks.withColumn("one", F.lit(1)), "one")  # a row each
    return both.select(*summary.columns, *(F.round(c, 2).alias(c) for c in ranks.columns))


def errors_by_type(traces: DataFrame) -> DataFrame:
    return traces.where(F.col("status").isin(L.OPERATIONAL_FAILURES)).groupBy("status").agg(F.count("*").alias("n"))


def metric_summary(metrics: DataFrame) -> DataFrame:
    """Per metric name: mean of applicable values, measured and eligible counts; metrics is (trace_id, name, value, applicable, reason)."""
    good = F.col("applicable") & F.col("value").isNotNull()
    return metrics.groupBy("name").agg(F.round(F.avg(F.when(good, F.col("value"))), 6).alias("mean"), F.count_if(good).alias("measured_count"), F.count("*").alias("eligible_count"))


def unavailable_reasons(metrics: DataFrame) -> DataFrame:
    lost = ~(F.coalesce("applicable", F.lit(False)) & F.col("value").isNotNull()) & (F.coalesce("reason", F.lit("")) != "")
    return metrics.where(lost).groupBy("name", "reason").agg(F.count("*").alias("n"))


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, as a max over a struct: no sort of a whole key."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("m")).select(key, *(F.col(f"m.{c}").alias(c) for c in (*order, *rest)))


def with_delta(rows: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumns({"previous": before, "delta": F.round(F.col(value) - before, 6)})


def rolling_usage(events: DataFrame, by: str, ts: str = "ts", requests: str = "request_count", tokens: str = "input_tokens", seconds: int = 60) -> DataFrame:
    """Requests and tokens of the last `seconds` (lower end excluded), and requests since midnight Pacific time, at each event of a key.

    Events of one time count for each other.  A key is cut into buckets of
    `seconds`: an event is in its own and, as one of the past, in the next, and
    windows run within a bucket.  The day's count is what the bucket has of the
    day so far and the sum over the day's buckets before.  So a task holds
    two buckets' events, whatever a key has.
    """
    size = seconds * 1_000_000
    us, day = "__us", "__day"
    rows = events.withColumns({us: F.unix_micros(F.col(ts).cast("timestamp")), day: F.date_trunc("day", F.from_utc_timestamp(F.col(ts).cast("timestamp"), PACIFIC))})
    rows = rows.withColumn("__own", F.expr(f"__us div {size}") - (F.col(us) < 0).cast("long"))
    twice = rows.withColumn("__late", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__bucket", F.col("__own") + F.col("__late"))
    recent = Window.partitionBy(by, "__bucket").orderBy(us).rangeBetween(-(size - 1), 0)
    so_far = Window.partitionBy(by, "__bucket", day).orderBy(us).rangeBetween(Window.unboundedPreceding, 0)
    mine = F.when(F.col("__late") == 0, F.col(requests))
    near = twice.withColumns({"rpm_used": F.sum(requests).over(recent), "tpm_used": F.sum(tokens).over(recent), "__today": F.sum(mine).over(so_far)}).where("__late = 0")
    buckets = rows.groupBy(F.col(by).alias("__by"), F.col("__own").alias("__b"), F.col(day).alias("__d")).agg(F.sum(requests).alias("__n"))
    before = Window.partitionBy("__by", "__d").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    earlier = buckets.select("__by", "__b", "__d", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    met = near.join(earlier, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__own") == F.col("__b")) & (F.col(day) == F.col("__d")), "left")
    out = met.withColumn("rpd_used", F.when(F.col("__today").isNotNull() | (F.col("__before") > 0), F.coalesce("__today", F.lit(0)) + F.coalesce("__before", F.lit(0))))
    return out.select(*events.columns, "rpm_used", "tpm_used", "rpd_used")


def pacific_day_start(ts: Column) -> Column:
    """Midnight of the Pacific day, in UTC; knows daylight saving."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts.cast("timestamp"), PACIFIC)), PACIFIC)


def block_reason(rpm_used: Column, tpm_used: Column, rpd_used: Column, tokens: Column, rpm: int, tpm: int, rpd: int, share: float = 0.70, day_share: float = 0.95) -> Column:
    """The first budget that one more request would exceed, in daily, request, token order; empty if none."""
    cap = lambda limit, s: max(1, int(limit * s))
    return F.when(rpd_used + 1 > cap(rpd, day_share), "rpd").when(rpm_used + 1 > cap(rpm, share), "rpm").when(tpm_used + tokens > cap(tpm, share), "tpm").otherwise("")


def alert(utilization: list[Column]) -> Column:
    top = F.greatest(*utilization) if len(utilization) > 1 else utilization[0]
    return F.when(top >= 0.95, "hard_stop").when(top >= 0.85, "critical").when(top >= 0.70, "warning").otherwise("normal")


def replay_reservations(events: DataFrame, by: str, rpm: int, tpm: int, rpd: int, share: float = 0.70, day_share: float = 0.95) -> DataFrame:
    """Which requests (key, event_id, ts, input_tokens) a key's quota lets through when blocked ones use nothing.

    Each decision rests on the ones before it, so a key's events pass through
    one ordered loop; its state is the last minute and a day's count, and keys
    run in parallel.
    """
    caps = {"rpm": max(1, int(rpm * share)), "tpm": max(1, int(tpm * share)), "rpd": max(1, int(rpd * day_share))}

    def run(frames):
        from collections import deque

        import pandas as pd

        key, recent, minute, day, today = object(), deque(), 0, 0, None
        for f in frames:
            out = []
            for k, event, us, d, tokens in f.itertuples(index=False):
                if k != key:
                    key, recent, minute, day, today = k, deque(), 0, 0, None
                if d != today:
                    today, day = d, 0
                while recent and recent[0][0] <= us - 60_000_000:
                    minute -= recent.popleft()[1]
                why = "rpd" if day + 1 > caps["rpd"] else "rpm" if len(recent) + 1 > caps["rpm"] else "tpm" if minute + tokens > caps["tpm"] else ""
                if not why:
                    recent.append((us, tokens))
                    minute, day = minute + tokens, day + 1
                out.append((k, event, not why, why))
            yield pd.DataFrame(out, columns=["key", "event_id", "allowed", "blocked_by"])

    day = F.date_trunc("day", F.from_utc_timestamp(F.col("ts").cast("timestamp"), PACIFIC)).cast("string")
    rows = events.select(F.col(by).alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), day.alias("day"), "input_tokens")
    placed = rows.repartition("key").sortWithinPartitions("key", "us", "event_id")
    return placed.mapInPandas(run, f"key {dict(rows.dtypes)['key']}, event_id {dict(rows.dtypes)['event_id']}, allowed boolean, blocked_by string")


def category_stats(chunks: DataFrame) -> DataFrame:
    """Rows per category, general ones counted in every category."""
    n = chunks.groupBy("category").agg(F.count("*").alias("n"))
    general = n.agg(F.coalesce(F.max(F.when(F.col("category") == "general", F.col("n"))), F.lit(0)).alias("g"))
    return n.crossJoin(general).select("category", F.when(F.col("category") == "general", F.col("n")).otherwise(F.col("n") + F.col("g")).alias("n"))


def profile_catalog(chunks: DataFrame, expected: int, accepted: list[int]) -> DataFrame:
    """Readiness of each vector width: ready, awaiting_acceptance, ingesting or pending."""
    n = chunks.groupBy("dimension").agg(F.count("*").alias("chunks"), F.countDistinct("document_name").alias("documents"))
    full = F.col("documents") >= expected
    status = F.when(full & F.col("dimension").isin(accepted), "ready").when(full, "awaiting_acceptance").when(F.col("chunks") > 0, "ingesting").otherwise("pending")
    return n.withColumn("status", status)


def with_generation_totals(traces: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Token totals (the provider's own if it reports them), cost in USD to eight decimals, failures and fallbacks.

    traces: query_tokens, context_tokens, answer_tokens, usage struct<input, output,
    total>, provider, attempts array<string> of statuses; prices per million
    input and output tokens by provider; the extractive provider costs nothing.
    """
    told = F.coalesce(F.col("usage.total"), F.lit(0)) > 0
    rows = traces.withColumns({
        "input_tokens": F.when(told, F.col("usage.input")).otherwise(F.col("query_tokens") + F.col("context_tokens")), "output_tokens": F.when(told, F.col("usage.output")).otherwise(F.col("answer_tokens")),
        "provider_failure_count": F.size(F.filter("attempts", lambda a: a == "error")),
    })
    cost = F.when(F.col("provider") == "extractive", 0.0)
    for name, (given, made) in prices.items():
        cost = cost.when(F.col("provider") == name, F.round(F.col("input_tokens") / 1e6 * given + F.col("output_tokens") / 1e6 * made, 8))
    fallback = (F.col("provider_failure_count") > 0) & F.col("provider").isin(L.FALLBACK_PROVIDERS)
    return rows.withColumns({"total_tokens": F.when(told, F.col("usage.total")).otherwise(F.col("input_tokens") + F.col("output_tokens")), "estimated_cost_usd": cost, "fallback_count": fallback.cast("int")})


def report_markdown(rows: DataFrame, columns: list[str]) -> str:
    """A small result as a Markdown table; meant for reports of a few rows, which pass through the driver one partition at a time."""
    body = [[str(r[c]) for c in columns] for r in rows.select(*columns).toLocalIterator()]
    return "\n".join("| " + " | ".join(cells) + " |" for cells in (columns, ["---"] * len(columns), *body))


def quota_snapshot(used: dict[str, Column], limits: dict[str, int]) -> list[Column]:
    """Utilisation (four decimals), what remains and the alert of each budget, as columns."""
    share = {k: F.round(used[k] / limits[k], 4) if limits[k] else F.lit(0.0) for k in limits}
    left = [F.greatest(F.lit(0), F.lit(limits[k]) - used[k]).alias(f"{k}_remaining") for k in limits]
    return [*(v.alias(f"{k}_utilization") for k, v in share.items()), *left, alert(list(share.values())).alias("alert")]


def acquire_decision(blocked_by: Column, interactive: Column, retry_after_ms: Column) -> Column:
    """What a request does about its quota: struct of action (go, fail or wait) and seconds; waiting users and exhausted days fail, others wait at least a quarter second."""
    blocked = F.coalesce(blocked_by, F.lit("")) != ""
    action = F.when(~blocked, "go").when(interactive | (blocked_by == "rpd"), "fail").otherwise("wait")
    return F.struct(action.alias("action"), F.when(action == "wait", F.greatest(F.lit(0.25), F.coalesce(retry_after_ms, F.lit(0)) / 1000)).otherwise(0.0).alias("seconds"))


def retry_delay(attempt: Column, provider_delay: Column, jitter: Column) -> Column:
    """Seconds before the next try: what the provider says, else two to the power of the attempt and a jitter of up to a second, a minute at most."""
    return F.coalesce(provider_delay.cast("double"), F.least(F.lit(60.0), F.pow(F.lit(2.0), attempt) + jitter))


def provider_error(message: Column, status: Column) -> Column:
    """Kind of a provider's error: struct of code, http_status and whether it may be tried again. A status that is not given is read from the message.

    For long messages in tables see `provider_errors`, which reads each once.
    """
    said = F.lower(F.coalesce(message, F.lit("")))
    status = F.coalesce(status.cast("int"), _said_status(said))
    at = _error_kind(said, status)
    return F.struct(*_error_fields(at, status))


def provider_errors(rows: DataFrame, message: str, status: str | None = None) -> DataFrame:
    """The rows with code, http_status and retryable in place of the message and the status.

    Lower case, the number in the message and the kind are columns of steps of
    their own, so that each message is read once for each of them.
    """
    said, number, kind = "__said", "__number", "__kind"
    given = F.col(status).cast("int") if status else F.lit(None).cast("int")
    steps = rows.withColumn(said, F.lower(F.coalesce(message, F.lit(""))))
    steps = steps.withColumn(number, F.coalesce(given, _said_status(F.col(said))))
    steps = steps.withColumn(kind, _error_kind(F.col(said), F.col(number)))
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (message, status)]
    return steps.select(*kept, *_error_fields(F.col(kind), F.col(number)))


def _said_status(said: Column) -> Column:
    return F.regexp_extract(said, L.PROVIDER_STATUSES, 1).try_cast("int")


def _error_kind(said: Column, status: Column) -> Column:
    """The place of the first kind of error in the list that fits; null if none does."""
    kind = F.lit(None).cast("int")
    for at, (_, statuses, parts, _) in reversed(list(enumerate(L.PROVIDER_ERRORS))):
        hit = F.coalesce(status.isin(*statuses), F.lit(False)) if statuses else F.lit(False)
        for part in parts:
            hit = hit | F.contains(said, F.lit(part))
        kind = F.when(hit, at).otherwise(kind)
    return kind


def _error_fields(kind: Column, status: Column) -> list[Column]:
    code, again, assumed = F.lit("unknown_error"), F.lit(False), F.lit(None).cast("int")
    for at, (name, statuses, _, retryable) in enumerate(L.PROVIDER_ERRORS):
        one = {"invalid_api_key": 400, "invalid_request": 400}.get(name, statuses[0] if len(statuses) == 1 else None)
        code, again, assumed = F.when(kind == at, name).otherwise(code), F.when(kind == at, retryable).otherwise(again), F.when(kind == at, F.lit(one).cast("int")).otherwise(assumed)
    return [code.alias("code"), F.coalesce(status, assumed).alias("http_status"), again.alias("retryable")]


def ingestion_summary(stats: DataFrame) -> DataFrame:
    """One row over documents (file_name, pages, chunks, token_count, error, skipped): how many there are of each outcome, and sums over the successful ones."""
    failed = F.coalesce("error", F.lit("")) != ""
    skipped = F.coalesce("skipped", F.lit(False))
    good = ~failed & ~skipped
    total = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0)).cast("long")
    return stats.agg(
        F.count("*").alias("documents"), F.count_if(good).alias("successful"), F.count_if(skipped).alias("skipped"), F.count_if(failed).alias("failed"), total("pages").alias("pages"), total("chunks").alias("chunks"), total("token_count").alias("tokens"),
    )


def ingestion_categories(chunks: DataFrame, stats: DataFrame) -> DataFrame:
    """category, chunks: over the documents that were ingested."""
    good = stats.where((F.coalesce("error", F.lit("")) == "") & ~F.coalesce("skipped", F.lit(False))).select("file_name")
    rows = chunks.join(good, chunks["document_name"] == good["file_name"], "left_semi")
    return rows.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("chunks"))


def provider_message(code: Column, is_arabic: Column, search: Column) -> Column:
    """What a user is told of an error's code; messages about a search name that service."""
    said = F.when(F.lit(False), "")
    for name, both in L.PROVIDER_MESSAGES.items():
        named = both if name in L.SERVICE_NAME_STAYS else tuple(text.replace(*swap) for text, swap in zip(both, L.SERVICE_NAMES))
        for arabic in (True, False):
            mine = (code == name) & (is_arabic if arabic else ~is_arabic)
            said = said.when(mine & search, named[not arabic]).when(mine, both[not arabic])
    return said
