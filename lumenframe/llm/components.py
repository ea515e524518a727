"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(u, v)`` edges -> ``(node, component)``: the smallest node that each node of an edge
    reaches. Alternates large-star and small-star steps, whose edges stay linear in number, until
    nothing changes. Minima are combined before each shuffle, so a hub meets no single task."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    pairs = scratch.keep(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v")
        pairs = scratch.keep(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        sign = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sign == before:
            break
        before = sign
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
