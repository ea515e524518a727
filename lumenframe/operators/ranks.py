"""Values at exact ranks of large groups, without sorting a group in one task.

A sketch of each group gives two values that enclose the rank sought. Rows below are only counted; rows between
are counted by value, and the few values left are walked in order. Sketches err by a known share, so the
ends are set wider than that; a group whose rank still lies outside is searched between its own ends.

Defined results: null values have no rank; of equal values any is the same; a group without values has no row; null
keys are a group; NaN is the greatest value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sketch errs by one in so many rows; ends are set three times as far.
ACCURACY = 10_000


def at_rank(rows: DataFrame, key: str, value: str, share: float, rank: Column) -> DataFrame:
    """``key, value, n``: the value at 0-based ``rank`` of each group; ``rank`` is a whole number from ``n``, near ``share * n``."""
    given = rows.select(F.col(key).alias("k"), F.col(value).alias("v")).where("v is not null")
    ends = [max(0.0, share - 3 / ACCURACY), min(1.0, share + 3 / ACCURACY)]
    sketch = given.groupBy("k").agg(F.percentile_approx("v", F.array(*map(F.lit, ends)), ACCURACY).alias("e"), F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    sketch = sketch.select(F.col("k").alias("g"), F.col("e")[0].alias("a"), F.col("e")[1].alias("b"), "n", "lo", "hi", rank.cast("long").alias("rank"))
    joined = given.join(sketch, F.col("k").eqNullSafe(F.col("g")))
    counts = joined.groupBy("g", "a", "b", "lo", "hi", "n", "rank").agg(F.count_if(F.col("v") < F.col("a")).alias("under"), F.count_if(F.col("v") <= F.col("b")).alias("upto"))
    missed = (F.col("rank") < F.col("under")) | (F.col("rank") >= F.col("upto"))
    ends_of = counts.select(F.col("g"), "n", "rank", F.when(missed, F.col("lo")).otherwise(F.col("a")).alias("a"), F.when(missed, F.col("hi")).otherwise(F.col("b")).alias("b"), F.when(missed, 0).otherwise(F.col("under")).alias("under"))
    inside = given.join(ends_of, F.col("k").eqNullSafe(F.col("g")) & F.col("v").between(F.col("a"), F.col("b"))).groupBy("g", "n", "rank", "under", "v").agg(F.count(F.lit(1)).alias("c"))
    so_far = F.col("under") + F.sum("c").over(Window.partitionBy("g").orderBy("v"))
    found = inside.withColumn("_to", so_far).where(F.col("_to") > F.col("rank")).groupBy("g").agg(F.min("v").alias("v"), F.first("n").alias("n"))
    return found.select(F.col("g").alias(key), F.col("v").alias(value), "n")


def quantile(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """``key, value``: the interpolated quantile of each group."""
    place = (F.col("n") - 1) * F.lit(share)
    low = at_rank(rows, key, value, share, F.floor(place)).select(F.col(key).alias("_k"), F.col(value).alias("_low"), "n")
    high = at_rank(rows, key, value, share, F.ceil(place)).select(key, F.col(value).alias("_high"))
    part = place - F.floor(place)
    return high.join(low, F.col(key).eqNullSafe(F.col("_k"))).select(key, (F.col("_low") + (F.col("_high") - F.col("_low")) * part).alias(value))
