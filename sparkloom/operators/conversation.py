"""Conversation state as windows over turns (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import classify as C


def rolling_history(turns: DataFrame, max_turns: int = 6) -> DataFrame:
    """Each turn with the last 2 * max_turns messages before it, oldest first; system turns take no part."""
    said = turns.where(F.col("role").isin("user", "assistant"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2 * max_turns, -1)
    return said.withColumn("history", F.collect_list(F.struct("turn", "role", "text")).over(before))


def with_last_user(turns: DataFrame) -> DataFrame:
    """Each turn with the latest user text before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = turns.where(F.col("role").isin("user", "assistant"))
    return said.withColumns({"last_user": F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before), "n_before": F.count("*").over(before)})


def rewrite_questions(turns: DataFrame) -> DataFrame:
    """User turns rewritten for search."""
    asked = with_last_user(turns).where("role = 'user'")
    return asked.withColumn("rewritten", C.rewrite(F.col("text"), F.col("last_user"), F.col("n_before") > 0))


def model_history(turns: DataFrame) -> DataFrame:
    """Turns as providers name them: assistant becomes model, the newest turn of a conversation is left out."""
    newest = F.max("turn").over(Window.partitionBy("conv_id"))
    said = turns.where(F.col("role").isin("user", "assistant")).withColumn("__newest", newest)
    return said.where("turn < __newest").select("conv_id", "turn", F.when(F.col("role") == "assistant", "model").otherwise(F.col("role")).alias("role"), "text")
