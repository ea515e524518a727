"""Exact ranks against sorting."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumenframe.operators.ranks import at_rank, quantile


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_ranks_equal_sorting(spark, share):
    rnd = random.Random(3)
    rows = [("many", rnd.gauss(0, 1)) for _ in range(30_000)] + [("same", 5.0)] * 500 + [("two", 1.0), ("two", 3.0), (None, 2.0), ("none", None)] + [("steps", float(rnd.randint(0, 3))) for _ in range(999)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6).withColumn("n", F.lit(0)).withColumn("a", F.lit(1))
    groups: dict = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    got = {r.k: r.v for r in at_rank(df, "k", "v", share, F.least(F.floor(F.col("n") * share), F.col("n") - 1)).collect()}
    assert got == {k: sorted(v)[min(int(len(v) * share), len(v) - 1)] for k, v in groups.items()}
    for r in quantile(df, "k", "v", share).collect():
        v = sorted(groups[r.k])
        at = (len(v) - 1) * share
        assert abs(r.v - (v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at)))) < 1e-9
