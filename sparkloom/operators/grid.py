"""Benchmarks over a grid of configurations that can be interrupted: finished cells are kept, labels merged, a finalist chosen."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import evaluation

Cell = tuple[str, str]
DEPTH = 5


def experiment_key(profile: str, provider: str) -> str:
    return f"{profile}_{provider}"


def _there(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def run_grid(spark: SparkSession, cells: Iterable[Cell], evaluate: Callable[[str, str], DataFrame], label: Callable[[DataFrame], DataFrame], folder: str, again: Iterable[Cell] = ()) -> list[str]:
    """Compute the cells (profile, provider) that the folder lacks, and those asked for again; their keys, in order.

    evaluate gives a cell's rankings: case_id, rank (null where a case has no
    result), item, latency_ms and cost_usd of the case.  label judges rankings:
    case_id, rank, relevance.  A cell counts once its rankings are written in
    full; labels are written after them and made anew where they are missing,
    so a run that was broken off goes on with the same result.
    """
    ran, redo = [], set(again)
    for profile, provider in cells:
        key = experiment_key(profile, provider)
        raw, judged = f"{folder}/raw/run_id={key}", f"{folder}/labels/run_id={key}"
        fresh = (profile, provider) in redo or not _there(spark, raw)
        if fresh:
            rows = evaluate(profile, provider).withColumns({"profile": F.lit(profile), "provider": F.lit(provider)})
            rows.write.mode("overwrite").parquet(raw)
        if fresh or not _there(spark, judged):
            label(spark.read.parquet(raw)).write.mode("overwrite").parquet(judged)
        if fresh:
            ran.append(key)
    return ran


def results(spark: SparkSession, cells: Iterable[Cell], cases: DataFrame, folder: str) -> DataFrame:
    """One candidate for each cell that has run: key, precision and hits at 5, refusals, latency, cost, whether all of its first five places are judged, and the measures of each k.

    cases is (case_id, expect_evidence).  Cells are few: each is a plan of its own.
    """
    found = []
    for profile, provider in cells:
        key = experiment_key(profile, provider)
        if not _there(spark, f"{folder}/labels/run_id={key}"):
            continue
        raw, labels = spark.read.parquet(f"{folder}/raw/run_id={key}"), spark.read.parquet(f"{folder}/labels/run_id={key}")
        per_k = evaluation.macro_at_k(labels, cases)
        measures = F.map_from_entries(F.collect_list(F.struct("k", F.struct(*(c for c in per_k.columns if c != "k")))))
        spent = raw.groupBy("case_id").agg(F.max("latency_ms").alias("latency_ms"), F.max("cost_usd").alias("cost_usd"))
        open_ = evaluation.unlabelled(raw.where(F.col("rank") <= DEPTH), labels)
        parts = [
            per_k.agg(measures.alias("per_k")),
            spent.agg(F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms"), F.sum("cost_usd").alias("estimated_cost_usd")),
            open_.agg((F.count("*") == 0).alias("labels_complete")),
        ]
        one = reduce(lambda a, b: a.join(b, "run_id"), [p.withColumn("run_id", F.lit(key)) for p in parts])  # a row each
        found.append(one.withColumns({"profile": F.lit(profile), "provider": F.lit(provider)}))
    if not found:
        raise ValueError("no cell of the grid has run")
    at = F.col("per_k")[DEPTH]
    named = {"precision_at_5": at["macro_precision_at_k"], "hit_at_5": at["hit_at_k"], "refusal_pass_rate": at["no_evidence_refusal_pass_rate"]}
    return reduce(DataFrame.unionByName, found).withColumns(named)


def finalize(spark: SparkSession, cells: Iterable[Cell], cases: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The candidates, and the one that is selected with its runtime k: no row if none is eligible, which incomplete labels are not."""
    candidates = results(spark, list(cells), cases, folder)
    return candidates, evaluation.select_candidate(candidates)
