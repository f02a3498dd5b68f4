"""A grid that is broken off goes on with the same result as one that ran through."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import grid

CELLS = [("small", "local"), ("large", "local"), ("large", "hosted")]
GOOD = {("small", "local"): 2, ("large", "local"): 4, ("large", "hosted"): 4}


def parts(spark, calls, broken=None, gap=False):
    def evaluate(profile, provider):
        calls.append((profile, provider))
        rows = [(c, r, f"{profile}{c}{r}", 10.0 + len(profile), 0.01 if provider == "hosted" else 0.0) for c in ("a", "b") for r in range(1, 6)] + [("none", None, None, 5.0, 0.0)]
        out = spark.createDataFrame(rows, "case_id string, rank int, item string, latency_ms double, cost_usd double").withColumn("good", F.lit(GOOD[profile, provider]))
        return out.withColumn("item", F.raise_error(F.lit("broken")).cast("string")) if (profile, provider) == broken else out

    def label(rankings):
        judged = rankings.where("rank IS NOT NULL").select("case_id", "rank", F.when(F.col("rank") <= F.col("good"), "relevant").otherwise("not_relevant").alias("relevance"))
        return judged.where("rank <> 3") if gap else judged

    return evaluate, label


def cases(spark):
    return spark.createDataFrame([("a", True), ("b", True), ("none", False)], "case_id string, expect_evidence boolean")


def outcome(spark, folder):
    found, chosen = grid.finalize(spark, CELLS, cases(spark), folder)
    shown = found.select("run_id", "precision_at_5", "hit_at_5", "refusal_pass_rate", "mean_latency_ms", F.round("estimated_cost_usd", 4), "labels_complete")
    return sorted(map(tuple, shown.collect())), [(r.profile, r.provider, r.runtime_k) for r in chosen.collect()]


def test_an_interrupted_grid_goes_on(spark, tmp_path):
    whole, halted = f"file://{tmp_path}/whole", f"file://{tmp_path}/halted"
    grid.run_grid(spark, CELLS, *parts(spark, []), whole)
    with pytest.raises(Exception, match="broken"):
        grid.run_grid(spark, CELLS, *parts(spark, [], broken=CELLS[1]), halted)
    calls = []
    assert grid.run_grid(spark, CELLS, *parts(spark, calls), halted) == ["large_local", "large_hosted"]
    assert calls == CELLS[1:]
    want = [("large_hosted", 0.8, 1.0, 1.0, 11.67, 0.02, True), ("large_local", 0.8, 1.0, 1.0, 11.67, 0.0, True), ("small_local", 0.4, 1.0, 1.0, 11.67, 0.0, True)]
    assert outcome(spark, halted) == outcome(spark, whole) == (want, [("large", "local", 3)])
    assert grid.run_grid(spark, CELLS, *parts(spark, []), halted) == []
    assert grid.run_grid(spark, CELLS, *parts(spark, []), halted, again=[CELLS[0]]) == ["small_local"]


def test_places_without_a_judgement_make_no_finalist(spark, tmp_path):
    folder = f"file://{tmp_path}/gap"
    with pytest.raises(ValueError, match="no cell"):
        grid.results(spark, CELLS, cases(spark), folder)
    grid.run_grid(spark, CELLS, *parts(spark, [], gap=True), folder)
    rows, chosen = outcome(spark, folder)
    assert chosen == [] and not any(r[-1] for r in rows)
