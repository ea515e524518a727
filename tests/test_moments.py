"""Edge rows of dates, identifiers, folders and staged search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import moments, paths
from lumenframe.operators import mutations, search


def test_folders_and_ids_of_odd_rows(spark):
    rows = spark.createDataFrame([("/",), ("",), ("../../a",), ("C:\\x\\..\\..\\y",), (None,)], "p string")
    assert [r.k for r in rows.select(paths.folder_key(F.col("p")).alias("k")).collect()] == ["/", "", "../../a", "c:/y", None]
    ids = spark.createDataFrame([("short",), ("7ZZZZZZZZZ0123456789ABCDEF",), ("8ZZZZZZZZZ0123456789ABCDEF",), (None,)], "i string")
    assert [r.m for r in ids.select(moments.id_millis(F.col("i")).alias("m")).collect()] == [None, 2**48 - 1, None, None]


def test_times_without_length_or_scenes(spark):
    rows = spark.createDataFrame([(None, None), (0.0, [1.0]), (0.1, []), (65.0, [])], "d double, s array<double>")
    got = [r.t for r in rows.select(moments.frame_times(F.col("d"), F.coalesce("s", F.array().cast("array<double>"))).alias("t")).collect()]
    assert got == [[0.0], [0.0], [0.0], [0.5, 30.0, 60.0]]


def test_feed_dates(spark):
    rows = spark.createDataFrame([(None,), ("",), ("2024-02-30",), ("Mon, 1 Jan 2024 00:30:00 +0100",), ("2024-01-01",)], "t string")
    got = [r.t for r in rows.select(moments.iso_utc(F.col("t")).alias("t")).collect()]
    assert got == ["", "", "", "2023-12-31T23:30:00Z", "2024-01-01T00:00:00Z"]


def test_search_of_nothing_and_stacks_of_one(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert search.ladder(docs, "text", ["word"]).count() == 0
    members = spark.createDataFrame([(1, 5, 0), (2, 5, 1), (3, 6, 0)], "id long, stack long, pos long")
    asked = spark.createDataFrame([(1, 9, 0)], "id long, into long, pos long")
    assert sorted(tuple(r) for r in mutations.group_stacks(members, asked).collect()) == [(1, 9, 1), (2, 9, 2)]


def test_frame_times_compute_their_cuts_once(spark):
    rows = spark.range(1).select(moments.frame_times(F.lit(100.0) + F.col("id"), F.array(F.col("id") + 5.0)).alias("t"))
    assert rows._jdf.queryExecution().analyzed().toString().count("array_distinct") == 1
    assert rows.first().t == [0.5, 5.0, 30.0, 60.0, 90.0]
