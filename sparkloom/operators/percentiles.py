"""Percentiles of any number of values: exact ones by ranks over ranges of values, and sketches that add up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.workspace import written

SKETCH_K = 800  # the rank that a sketch answers for is off by less than 0.01 with a probability of 0.99


def exact(rows: DataFrame, value_col: str, ps: Sequence[float], by: Sequence[str] = (), parts: int | None = None, rank: Callable[[Column], Column] = F.ceil) -> DataFrame:
    """(by..., p, value): element max(1, ceil(p * n)) of each group's n values in order; `rank` may round otherwise.

    Equal values are counted first, so a hot value is one row.  The rest is dealt
    out by ranges of (group, value) and written once; a sum for each range tells
    which ranges hold the wanted ranks, and only those are put in order, each by
    a task of its own.  A group may be of any size.  Nulls are no values and NaN
    comes last; a group without values gives no rows, nor does an empty table;
    null groups are groups.
    """
    spark = rows.sparkSession
    group = F.struct(F.lit(1).alias("__all"), *(F.col(f"`{c}`") for c in by))
    values = rows.select(group.alias("key"), F.col(f"`{value_col}`").alias("value")).where("value IS NOT NULL")
    counted = values.groupBy("key", "value").agg(F.count("*").alias("n"))
    dealt = counted.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "value")
    placed = written(dealt.withColumn("part", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("key", "part").agg(F.sum("n").alias("here"))
    upto = F.sum("here").over(Window.partitionBy("key").orderBy("part"))
    sums = sums.withColumns({"before": upto - F.col("here"), "total": F.sum("here").over(Window.partitionBy("key"))})
    asked = sums.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in ps))))
    asked = asked.withColumn("rank", F.greatest(F.lit(1), rank(F.col("p") * F.col("total"))) - F.col("before")).where("rank BETWEEN 1 AND here")
    wanted = asked.groupBy("key", "part").agg(F.collect_list(F.struct("p", "rank")).alias("wanted"))
    reach = F.sum("n").over(Window.partitionBy("key", "part").orderBy("value"))
    met = placed.join(wanted, ["key", "part"]).withColumn("reach", reach)
    hit = F.filter("wanted", lambda x: x["rank"].between(F.col("reach") - F.col("n") + 1, F.col("reach")))
    found = met.withColumn("hit", F.explode(hit))
    return found.select(*(F.col(f"key.`{c}`") for c in by), F.col("hit.p").alias("p"), "value")


def columns(found: DataFrame, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The percentiles of each group side by side, as p50, p95 and so on; without groups one row, of nulls if there are no values."""
    names = {p: f"p{p * 100:g}".replace(".", "_") for p in ps}
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(name) for p, name in names.items()))


def sketches(rows: DataFrame, value_col: str, by: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """(by..., n, sketch): a sketch of some kilobytes for each group, to be kept in a table. Null values are left out."""
    value = F.col(f"`{value_col}`").cast("double")
    return rows.where(value.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(value, k).alias("sketch"))


def rolled_up(kept: DataFrame, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, p, value): percentiles of groups from the sketches of their parts, which merge without the values."""
    merged = kept.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")).where("n > 0")
    one = lambda p: F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value"))
    return merged.select(*by, "n", F.inline(F.array(*map(one, ps))))
