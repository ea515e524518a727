"""Vector expressions on array columns, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector or for vectors of different length."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (both == 0), F.lit(0.0)).otherwise(dot(a, b) / both)


def scored(rows: DataFrame, one: DataFrame, vector: str) -> DataFrame:
    """``rows`` with the cosine to the single query vector of ``one``, which is broadcast."""
    return rows.join(F.broadcast(one)).withColumn("score", cosine(F.col(vector), F.col("query"))).drop("query")


def top_k(rows: DataFrame, one: DataFrame, id_col: str, vector: str, k: int, floor: float | None = None) -> DataFrame:
    """The best ``k`` rows with their rank ``n``; each task keeps ``k`` rows at most."""
    found = scored(rows, one, vector)
    found = found if floor is None else found.where(F.col("score") >= floor)
    best = found.select(id_col, "score").orderBy(F.col("score").desc(), F.col(id_col)).limit(k)
    # The result has k rows, so collecting their order in one group is bounded.
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(id_col)))).alias("x"))
    return listed.select(F.posexplode("x").alias("n", "x")).select((F.col("n") + 1).alias("n"), F.col(f"x.{id_col}").alias(id_col), (-F.col("x.s")).alias("score"))
