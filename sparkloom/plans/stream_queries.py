"""Queries: batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.streaming import streams


def _events(t):
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_events_window(t):
    return streams.tumbling(_events(t)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1""")
def stream_events_sliding(t):
    return streams.sliding(_events(t)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTES, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(t):
    return streams.sessions(_events(t)).withColumn("start", F.col("start").cast("timestamp_ntz"))
