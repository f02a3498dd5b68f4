"""Ingestion of batches of documents in steps: a ledger of states, staged tables, one commit, undo, and resumption.

A store is a folder: `runs` holds what open runs have staged, `chunks` a folder
of rows a run, `ledger` a folder of outcomes a run.  A run's rows count only
once its ledger is there, which one rename puts in place, so no reader ever sees
half of a document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Step = tuple[str, Callable[[DataFrame], DataFrame]]
OUTCOME = "document_name string, status string, step string, error string, n long"


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    target, files = _files(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []
    return sorted(int(n.removeprefix("run=")) for n in names if n.startswith("run="))


def _done(spark: SparkSession, path: str) -> bool:
    target, files = _files(spark, f"{path}/_SUCCESS")
    return files.exists(target)


def _remove(spark: SparkSession, path: str) -> None:
    target, files = _files(spark, path)
    files.delete(target, True)


def _once(spark: SparkSession, path: str, rows: Callable[[], DataFrame]) -> DataFrame:
    """The table at the path, written first if it isn't there in full."""
    if not _done(spark, path):
        rows().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _outcomes(spark: SparkSession, store: str) -> DataFrame:
    """Every outcome of every committed run, with its run."""
    runs = _numbers(spark, f"{store}/ledger")
    if not runs:
        return spark.createDataFrame([], f"{OUTCOME}, run int")
    return spark.read.schema(f"{OUTCOME}, run int").option("basePath", f"{store}/ledger").parquet(*(f"{store}/ledger/run={n}" for n in runs))


def _latest(outcomes: DataFrame) -> DataFrame:
    rest = [c for c in outcomes.columns if c not in ("document_name", "run")]
    return outcomes.groupBy("document_name").agg(F.max(F.struct("run", *rest)).alias("m")).select("document_name", *(F.col(f"m.{c}").alias(c) for c in rest), "m.run")


def states(spark: SparkSession, store: str) -> DataFrame:
    """(document_name, status, step, error, n, run): the last state of each document; those of a run that is not over are processing."""
    known = _latest(_outcomes(spark, store))
    for run in _open(spark, store):
        held = spark.read.parquet(f"{store}/runs/run={run}/input").select("document_name").distinct()
        now = held.select("document_name", F.lit("processing").alias("status"), F.lit(None).cast("string").alias("step"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("long").alias("n"), F.lit(run).alias("run"))
        known = known.join(held, "document_name", "left_anti").unionByName(now)
    return known


def _open(spark: SparkSession, store: str) -> list[int]:
    committed = set(_numbers(spark, f"{store}/ledger"))
    return [n for n in _numbers(spark, f"{store}/runs") if n not in committed and _done(spark, f"{store}/runs/run={n}/input")]


def committed(spark: SparkSession, store: str) -> DataFrame | None:
    """The stored rows of all documents, each as its last completed run left it; None before the first run."""
    good = _latest(_outcomes(spark, store).where("status = 'completed'")).select("document_name", "run")
    runs = [n for n in _numbers(spark, f"{store}/chunks") if _done(spark, f"{store}/chunks/run={n}")]
    if not runs:
        return None
    rows = spark.read.option("basePath", f"{store}/chunks").parquet(*(f"{store}/chunks/run={n}" for n in runs))
    return rows.join(good, ["document_name", "run"], "left_semi")


def ingest(documents: DataFrame, steps: Sequence[Step], store: str, force: bool = False) -> int | None:
    """Take documents (document_name and what the first step needs) through the steps; the number of the run, None if there is nothing to do.

    A run that was broken off is finished first, from the last step that it
    staged.  Documents whose last completed run counts are left alone unless
    `force`; their rows stay in force until the new run is committed, also if
    the new run fails them.  A step gets and returns rows with document_name and
    must give the same rows if run again.  A document fails alone: if a step
    gives it a row with a non-null `error`, or no row at all.  An exception
    breaks the run off with nothing visible.  Rows without a name are an error;
    of documents of one name all rows are taken as one document's.
    """
    spark = documents.sparkSession
    for run in _open(spark, store):
        _finish(spark, steps, store, run)
    kept = documents.withColumn("document_name", F.when(F.col("document_name").isNull(), F.raise_error(F.lit("a document has no name"))).otherwise(F.col("document_name")).cast("string"))
    if not force:
        kept = kept.join(_latest(_outcomes(spark, store).where("status = 'completed'")), "document_name", "left_anti")
    run = max([0, *_numbers(spark, f"{store}/runs"), *_numbers(spark, f"{store}/ledger"), *_numbers(spark, f"{store}/chunks")]) + 1
    held = _once(spark, f"{store}/runs/run={run}/input", lambda: kept)
    if held.isEmpty():
        _remove(spark, f"{store}/runs/run={run}")
        return None
    _finish(spark, steps, store, run)
    return run


def _finish(spark: SparkSession, steps: Sequence[Step], store: str, run: int) -> None:
    base = f"{store}/runs/run={run}"
    rows = spark.read.parquet(f"{base}/input")
    failed = []
    for i, (name, step) in enumerate(steps):
        before = rows
        out = _once(spark, f"{base}/step={i}", lambda: step(before))  # noqa: B023
        if "error" not in out.columns:
            out = out.withColumn("error", F.lit(None).cast("string"))
        seen = out.groupBy("document_name").agg(F.min("error").alias("error"))
        met = before.select("document_name").distinct().join(seen.withColumn("there", F.lit(True)), "document_name", "left")
        bad = met.where("there IS NULL OR error IS NOT NULL").select("document_name", F.lit(name).alias("step"), F.coalesce("error", F.lit("nothing left")).alias("error"))
        failed.append(bad)
        rows = out.drop("error").join(bad, "document_name", "left_anti")
    stored = _once(spark, f"{store}/chunks/run={run}", lambda: rows)
    good = stored.groupBy("document_name").agg(F.count("*").alias("n")).select("document_name", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("step"), F.lit(None).cast("string").alias("error"), "n")
    lost = [b.select("document_name", F.lit("failed").alias("status"), "step", "error", F.lit(0).cast("long").alias("n")) for b in failed]
    reduce(DataFrame.unionByName, [good, *lost]).write.mode("overwrite").parquet(f"{base}/outcome")
    target, files = _files(spark, f"{store}/ledger")
    files.mkdirs(target)
    if not files.rename(_files(spark, f"{base}/outcome")[0], _files(spark, f"{store}/ledger/run={run}")[0]):
        raise RuntimeError(f"run {run} could not be committed")
    _remove(spark, base)


def undo(spark: SparkSession, store: str, run: int) -> None:
    """Take back a run, open or committed: its documents are again as the runs before left them."""
    target, files = _files(spark, f"{store}/ledger/run={run}")
    if files.exists(target):
        hidden = _files(spark, f"{store}/ledger/.undone-{run}")[0]
        files.rename(target, hidden)  # at once; what follows can't be seen
        files.delete(hidden, True)
    _remove(spark, f"{store}/runs/run={run}")
    _remove(spark, f"{store}/chunks/run={run}")


def vacuum(spark: SparkSession, store: str) -> list[int]:
    """Remove the rows of runs that have no document's last completed state; which runs."""
    held = set(_open(spark, store))
    used = {r.run for r in _latest(_outcomes(spark, store).where("status = 'completed'")).select("run").distinct().collect()}
    gone = [n for n in _numbers(spark, f"{store}/chunks") if n not in used and n not in held]
    for n in gone:
        _remove(spark, f"{store}/chunks/run={n}")
    return gone
