"""Runs of neighbouring rows: gaps and islands with windows that are partitioned by a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, key: list[str], order: list[str], breaks: Column, name: str = "run") -> DataFrame:
    """``rows`` with the number of their run: a new one begins where ``breaks`` holds. ``breaks``
    may look at the row before through ``F.lag(..).over(window)`` of the same key and order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_new", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def stacks_by_gap(rows: DataFrame, key: str, time: str, gap: float, tie: str) -> DataFrame:
    """Groups of at least two rows of a key, each within ``gap`` seconds of the one before."""
    w = Window.partitionBy(key).orderBy(time, tie)
    found = islands(rows.where(F.col(time).isNotNull()), [key], [time, tie], F.col(time) - F.lag(time).over(w) > gap)
    size = F.count(F.lit(1)).over(Window.partitionBy(key, "run"))
    return found.withColumn("stack_size", size).where("stack_size >= 2")


def date_runs(rows: DataFrame, key: str, position: str, label: Column) -> DataFrame:
    """Consecutive rows with the same label: one row per run, with its first place and length."""
    w = Window.partitionBy(key).orderBy(position)
    marked = rows.withColumn("label_", F.coalesce(label, F.lit("")))
    found = islands(marked, [key], [position], F.lag("label_").over(w) != F.col("label_"))
    return found.groupBy(key, "run").agg(F.min(position).alias("first"), F.count(F.lit(1)).alias("n"), F.min("label_").alias("label"))


def arrange_stacks(rows: DataFrame, key: str, position: str, stack: str, collapsed: Column) -> DataFrame:
    """Members move to their stack's first place; a collapsed stack keeps its first member."""
    own = F.when(F.col(stack).isNull(), F.col(position)).otherwise(F.min(position).over(Window.partitionBy(key, stack)))
    nth = F.row_number().over(Window.partitionBy(key, stack).orderBy(position))
    placed = rows.withColumn("place", own).withColumn("nth", F.when(F.col(stack).isNull(), 1).otherwise(nth))
    return placed.where((F.col("nth") == 1) | ~collapsed)
