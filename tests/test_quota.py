from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from sparkloom.operators import telemetry
from sparkloom.streaming import streams


def test_stream_equals_the_batch_replay_over_batches_and_a_restart(spark, sf, tmp_path):
    """Events come in five files in the order of time; the query stops after two and goes on from its checkpoint."""
    source = tmp_path / "in"
    source.mkdir()
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id")
    rows = events.toPandas()
    limits = {"rpm": 1, "tpm": 300, "rpd": 6}

    def run(lo, hi):
        for k in range(lo, hi):
            rows.iloc[len(rows) * k // 5 : len(rows) * (k + 1) // 5].to_parquet(source / f"{k}.parquet", index=False, coerce_timestamps="us")
            stream = streams.quota_stream(streams.quota_requests(streams.read_events(spark, str(source))), **limits)
            job = stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
            job.awaitTermination()

    run(0, 2)
    run(2, 5)
    got = {(r.key, r.event_id): (r.allowed, r.blocked_by) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    asked = streams.quota_requests(events.withColumn("ts", F.col("ts").cast("timestamp")))
    want = {(r.key, r.event_id): (r.allowed, r.blocked_by) for r in telemetry.replay_reservations(asked.select("key", "event_id", "ts", "input_tokens"), "key", **limits).collect()}
    assert got == want and len(got) == len(rows)
    assert {b for _, b in got.values()} == {"", "rpd", "rpm", "tpm"}, {b for _, b in got.values()}


def test_rolling_usage_equals_plain_loops(spark):
    r = random.Random(4)
    at = dt.datetime(2024, 3, 10, 6, 58)  # around a Pacific midnight and a change of the clock
    rows = [(r.choice(["a", "a", "b", None]), at + dt.timedelta(microseconds=r.choice([0, 1, 10**6 * r.randrange(0, 14_400), 60_000_000 * r.randrange(0, 240)])), r.randrange(0, 3), r.randrange(0, 100)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "k string, ts timestamp, request_count long, input_tokens long")
    got = defaultdict(list)
    for x in telemetry.rolling_usage(frame, "k").collect():
        got[x.k, x.ts].append((x.request_count, x.input_tokens, x.rpm_used, x.tpm_used, x.rpd_used))
    day = {x.ts: x.d for x in frame.select("ts", telemetry.pacific_day_start(F.col("ts")).alias("d")).collect()}
    want = defaultdict(list)
    for k, ts, n, tokens in rows:
        near = [x for x in rows if x[0] == k and dt.timedelta(0) <= ts - x[1] < dt.timedelta(seconds=60)]
        today = [x for x in rows if x[0] == k and x[1] <= ts and day[x[1]] == day[ts]]
        want[k, ts].append((n, tokens, sum(x[2] for x in near), sum(x[3] for x in near), sum(x[2] for x in today)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_rolling_usage_of_nothing(spark):
    frame = spark.createDataFrame([], "k string, ts timestamp, request_count long, input_tokens long")
    assert telemetry.rolling_usage(frame, "k").count() == 0
