"""Sinks that fail independently of each other, and logs that keep their newest records and are replaced as a whole."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparkloom.sources.sinks import keep_newest

Sink = Callable[[DataFrame, int], None]
_log = logging.getLogger(__name__)


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    target, files = _files(spark, path)
    return files.exists(target)


def _epochs(spark: SparkSession, folder: str) -> list[int]:
    """Epochs that have an entry in the folder, in order."""
    target, files = _files(spark, folder)
    if not files.exists(target):
        return []
    return sorted(int(s.getPath().getName().removeprefix("epoch=")) for s in files.listStatus(target) if s.getPath().getName().startswith("epoch="))


def _mark(spark: SparkSession, path: str) -> None:
    target, files = _files(spark, path)
    files.create(target, True).close()


def _remove(spark: SparkSession, path: str) -> None:
    target, files = _files(spark, path)
    files.delete(target, True)


def deliver(spark: SparkSession, sinks: dict[str, Sink], ledger: str) -> dict[str, list[int]]:
    """Give each sink, in order, the staged epochs that it has not marked; for each sink the epochs it still lacks.

    A sink that fails keeps its place and is tried again next time; the others
    go on.  An epoch that every sink has marked is removed.
    """
    staged = [e for e in _epochs(spark, f"{ledger}/staged") if _exists(spark, f"{ledger}/staged/epoch={e}/_SUCCESS")]
    lacking: dict[str, list[int]] = {}
    for name, write in sinks.items():
        done = set(_epochs(spark, f"{ledger}/done/{name}"))
        lacking[name] = [e for e in staged if e not in done]
        for epoch in list(lacking[name]):
            try:
                write(spark.read.parquet(f"{ledger}/staged/epoch={epoch}"), epoch)
            except Exception:  # whatever a sink raises is its own affair
                _log.exception("sink %s failed at epoch %s", name, epoch)
                break
            _mark(spark, f"{ledger}/done/{name}/epoch={epoch}")
            lacking[name].remove(epoch)
    for epoch in staged:
        if not any(epoch in missed for missed in lacking.values()):
            _remove(spark, f"{ledger}/staged/epoch={epoch}")
    return lacking


def fan_out(stream: DataFrame, sinks: dict[str, Sink], ledger: str, checkpoint: str) -> StreamingQuery:
    """Write a stream to several sinks, each of which may fail without holding up the stream or the others.

    Each micro-batch is staged in the ledger once and delivered from there; a
    sink marks each epoch it has written.  An epoch that comes again after a
    restart is staged and delivered again only to sinks without its mark.  A
    sink that dies between its write and its mark sees the epoch twice, so it
    must replace what it wrote for an epoch, as `epoch_writer` does.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        if not all(_exists(spark, f"{ledger}/done/{name}/epoch={epoch}") for name in sinks):
            df.write.mode("overwrite").parquet(f"{ledger}/staged/epoch={epoch}")
        deliver(spark, sinks, ledger)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def epoch_writer(path: str, form: str = "parquet") -> Sink:
    """A sink that keeps each epoch in a folder of its own and replaces it if the epoch comes again."""
    return lambda df, epoch: df.write.mode("overwrite").format(form).save(f"{path}/epoch={epoch}")


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The log as it is now; None before its first append."""
    name = _newest(spark, path)
    return spark.read.parquet(f"{path}/{name}") if name else None


def _newest(spark: SparkSession, path: str) -> str | None:
    """The version with the highest number that was written to its end."""
    target, files = _files(spark, path)
    if not files.exists(target):
        return None
    names = sorted(s.getPath().getName() for s in files.listStatus(target))
    return next((n for n in reversed(names) if n.startswith("version=")), None)


def append_log(spark: SparkSession, path: str, rows: DataFrame, order: list[str], max_records: int) -> None:
    """Append records to a log that keeps the newest `max_records` by `order`, all of its columns deciding ties.

    The compacted log is written beside and renamed to the next version, so a
    reader sees the log before or after, never half of it; a writer that dies
    leaves the log as it was.  The version before stays for its readers, older
    ones go.  One writer at a time: of two the later one fails at the rename.
    """
    last = _newest(spark, path)
    held = spark.read.parquet(f"{path}/{last}") if last else None
    both = held.unionByName(rows, allowMissingColumns=True) if held is not None else rows
    ties = [c for c in both.columns if c not in order]
    staged = f"{path}/.staged-{uuid.uuid4().hex}"
    keep_newest(both, max_records, [*order, *ties]).write.parquet(staged)
    number = int(last.removeprefix("version=")) + 1 if last else 0
    source, files = _files(spark, staged)
    target, _ = _files(spark, f"{path}/version={number:012d}")
    if files.exists(target) or not files.rename(source, target):
        files.delete(source, True)
        raise RuntimeError(f"another writer has replaced {path}")
    for s in files.listStatus(_files(spark, path)[0]):
        name = s.getPath().getName()
        if name.startswith("version=") and int(name.removeprefix("version=")) < number - 1:
            files.delete(s.getPath(), True)
