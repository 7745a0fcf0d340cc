"""Turns of conversations in their order, numbered without a sort of one whole
conversation: counts per stretch of turn numbers give each stretch its offset, and
rows are ranked inside their stretch only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Turn numbers that share one stretch.
STRETCH = 256


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, role, text`` with ``pos`` from 0 in the order of ``turn``, null
    first; equal turns go by role and text, so the order is the same in every run.
    Null roles and texts become empty. A null conv_id is a conversation of its own.
    Needs ``conv_id, turn, role, text``; other columns are ignored. Rows that share one
    turn number are sorted by one task, which spills."""
    turn = F.col("turn").cast("long")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), F.floor(turn / STRETCH).alias("stretch"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    before = Window.partitionBy("conv_id").orderBy(F.col("stretch").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("conv_id", "stretch").agg(F.count("*").alias("n")).select(
        F.col("conv_id").alias("_c"), F.col("stretch").alias("_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    ranked = rows.withColumn("_rank", F.row_number().over(inside))
    joined = ranked.join(offsets, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("stretch").eqNullSafe(F.col("_s")))
    return joined.select("conv_id", (F.col("_before") + F.col("_rank") - 1).alias("pos"), "role", "text")
