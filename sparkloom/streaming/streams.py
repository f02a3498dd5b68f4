"""Structured Streaming over event telemetry; each stream has a batch twin with the same rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.operators.telemetry import PACIFIC

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream; ts becomes a zoned timestamp, which watermarks need."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests, errors and their share for each window and type."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    n = seen.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return n.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    n = seen.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return n.select(F.col("window.start").alias("start"), "n", "errors")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events less than the gap apart."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    n = seen.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return n.select("user_id", F.col("session_window.start").alias("start"), "n")


def latest_traces(events: DataFrame, write, checkpoint: str):
    """Keep the latest event of each user in a table by upserting each micro-batch; write(batch, epoch) must be idempotent."""
    return events.writeStream.foreachBatch(lambda df, epoch: write(df.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select("user_id", "m.*"), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reservations(events: DataFrame, rpm: int, tpm: int) -> DataFrame:
    """Per key the requests that a rolling minute's budget lets through; state is the accepted requests of the last minute.

    events: key string, event_id long, ts timestamp, input_tokens long.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        out = []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for event, ts, tokens in zip(rows["event_id"], rows["ts"], rows["input_tokens"]):
            us = ts.value // 1000
            held = [h for h in held if h[0] > us - 60_000_000]
            ok = len(held) + 1 <= rpm and sum(h[1] for h in held) + tokens <= tpm
            if ok:
                held.append((us, int(tokens)))
            out.append((key[0], event, ok))
        state.update(([h[0] for h in held], [h[1] for h in held]))
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed"])

    return events.groupBy("key").applyInPandasWithState(run, "key string, event_id long, allowed boolean", "us array<long>, tokens array<long>", "append", "NoTimeout")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def quota_requests(events: DataFrame, key: str = "event_type") -> DataFrame:
    """Events as requests of a quota: key, event_id, ts, us, input_tokens (the value, rounded down), and their Pacific day with its end."""
    local = F.from_utc_timestamp("ts", PACIFIC)
    end = F.to_utc_timestamp(F.date_trunc("day", local) + F.expr("INTERVAL 1 DAY"), PACIFIC)
    return events.select(
        F.col(key).alias("key"), "event_id", "ts", F.unix_micros("ts").alias("us"), F.floor("value").cast("long").alias("input_tokens"), F.datediff(local, F.lit("1970-01-01")).cast("long").alias("day"), F.unix_millis(end).alias("day_end")
    )


class _Quota(StatefulProcessor):
    """A key's accepted requests of the last minute (a list), and how many its Pacific day has seen (a value)."""

    def __init__(self, rpm: int, tpm: int, rpd: int):
        self.rpm, self.tpm, self.rpd = rpm, tpm, rpd

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "us long, tokens long")
        self.today = handle.getValueState("today", "day long, used long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = deque((int(us), int(tokens)) for us, tokens in self.recent.get())
        day, used = map(int, self.today.get()) if self.today.exists() else (None, 0)
        minute, out = sum(tokens for _, tokens in held), []
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"])
        for event, us, tokens, its_day in zip(batch["event_id"], batch["us"], batch["input_tokens"], batch["day"]):
            if its_day != day:
                day, used = int(its_day), 0
            while held and held[0][0] <= us - 60_000_000:
                minute -= held.popleft()[1]
            why = "rpd" if used + 1 > self.rpd else "rpm" if len(held) + 1 > self.rpm else "tpm" if minute + tokens > self.tpm else ""
            if not why:
                held.append((int(us), int(tokens)))
                minute, used = minute + int(tokens), used + 1
            out.append((key[0], int(event), not why, why))
        self.recent.put(list(held)) if held else self.recent.clear()
        self.today.update((day, used))
        self.handle.registerTimer(int(us) // 1000 + 60_000)
        self.handle.registerTimer(int(batch["day_end"].iloc[-1]))
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed", "blocked_by"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What the watermark has passed is forgotten, so a key without requests holds no state after its day."""
        mark = timerValues.getCurrentWatermarkInMs()
        held = [(us, tokens) for us, tokens in self.recent.get() if us // 1000 + 60_000 > mark]
        self.recent.put(held) if held else self.recent.clear()
        if not held and self.today.exists() and mark >= expiredTimerInfo.getExpiryTimeInMs() and not any(t > mark for t in self.handle.listTimers()):
            self.today.clear()
        yield pd.DataFrame([], columns=["key", "event_id", "allowed", "blocked_by"])

    def close(self) -> None:
        pass


def quota_stream(requests: DataFrame, rpm: int, tpm: int, rpd: int, share: float = 0.70, day_share: float = 0.95, late: str = "10 minutes") -> DataFrame:
    """key, event_id, allowed, blocked_by of a stream of `quota_requests`: what a key's budgets of a minute and a Pacific day let through when blocked requests use nothing.

    The twin of `telemetry.replay_reservations`.  A key's state is at most rpm
    requests and a count; event-time timers end it.  Requests are decided in the
    order of their times within a micro-batch, and of arrival across them.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    caps = (max(1, int(rpm * share)), max(1, int(tpm * share)), max(1, int(rpd * day_share)))
    schema = "key string, event_id long, allowed boolean, blocked_by string"
    return requests.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(_Quota(*caps), schema, "append", "EventTime")


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there and return its rows from memory; for tests and small jobs."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
