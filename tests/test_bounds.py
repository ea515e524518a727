"""Steps whose memory or shuffles must not grow faster than their input."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from lumenframe.functions import extract, markdown
from lumenframe.llm import sharding
from lumenframe.operators import geo, ranking
from lumenframe.plans import extracts, files


def _sizes(texts: list[str], make, kinds: str) -> tuple[list[int], list[int], int]:
    """Rows and bytes of the batches that leave, and the rows read before the first did."""
    seen = []

    def counted(text):
        seen.append(text)
        return make(text)

    shape = pa.schema([("id", pa.int64()), *((f, {"s": pa.string(), "i": pa.int32()}[k]) for f, k in zip("abcd", kinds))])
    batches = extract.small_batches(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])]), make=counted, shape=shape, keys=1)
    first = next(batches)
    early = len(seen)
    rest = [first, *batches]
    assert sum(len(b) for b in rest) == sum(1 for t in texts for _ in make(t)) and len(seen) == len(texts)
    return [len(b) for b in rest], [b.nbytes for b in rest], early


def test_results_leave_in_small_batches():
    rows, size, early = _sizes(["x" * 10_000] * 3000, lambda t: [(t, t)], "ss")
    assert max(rows) <= extract.ROWS and max(size) < 2 * extract.CHARS and early < 100
    rows, size, early = _sizes(["y"] * 3000, lambda t: [(1,), (2,)], "i")
    assert max(rows) == extract.ROWS and early <= extract.ROWS
    # One text of many rows leaves in many batches.
    rows, size, early = _sizes(["a b " * 500_000], lambda t: ((i, a, b, t[a:b]) for i, (a, b) in enumerate(extract.chunk_spans(t))), "iiis")
    assert len(rows) > 4 and max(rows) <= extract.ROWS and max(size) < 2 * extract.CHARS


def test_text_queries_run_once_a_row_without_wide_batches(spark):
    """No result of a whole Arrow batch is held as Python lists, and Markdown is made once."""
    d = "/root/testdata/sf0.001"
    for made, stages in ((extracts.to_markdown, 1), (extracts.chunk_text, 1), (extracts.chunk_markdown, 1), (extracts.split_pages, 1), (extracts.readable, 1), (files.metadata, 2)):
        plan = made(spark, d)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == stages and "ArrowEvalPython" not in plan and "MapInPandas" not in plan
    odd = spark.createDataFrame([(1, None), (None, "t"), (2, "")], "id long, text string")
    assert extract.chunk_text(odd).collect() == [(None, 0, 0, 1, "t")]
    pages = odd.selectExpr("id", "text AS html", "CAST(NULL AS string) AS url")
    assert sorted((r.id or 0, r.markdown, r.text) for r in markdown.both_of(pages).collect()) == [(0, "t", "t"), (1, "", ""), (2, "", "")]


def test_points_of_one_spot_are_asked_for_once(spark):
    cities = spark.createDataFrame([(None, 1.0, 1.0), (7, 1.0, 1.0), (8, 1.0, 1.0), (9, 1.2, 1.0)], "city long, clat double, clon double")
    points = spark.createDataFrame([(i, 1.0, 1.0 + i % 2) for i in range(200)] + [(0, 1.2, 1.0), (5, 1.2, 1.0), (300, 50.0, 1.0), (301, None, 1.0)], "id long, lat double, lon double")
    found = {r.id: (r.city, round(r.km, 3)) for r in geo.nearest(points, cities, 300.0).collect()}
    assert len(found) == 200 and found[0] == (7, 0.0) and found[2] == (7, 0.0) and found[5] == (9, 0.0) and found[3] == (7, 111.178)
    plan = geo.nearest(points, cities, 300.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [lat" in plan and "Aggregate [clat" in plan


def test_stems_are_counted_in_their_rows(spark):
    docs = spark.createDataFrame([(1, "lamp lamps a"), (2, "lamp"), (2, "lamps b"), (None, "lamp c"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, ranking.frequencies(docs, "doc_id", "text").collect())) == [("a", 1, 1), ("b", 1, 1), ("c", 0, 1), ("lamp", 2, 5)]
    once = docs.where("doc_id is null or doc_id <> 2")
    assert sorted(map(tuple, ranking.frequencies(once, "doc_id", "text").collect())) == [("a", 1, 1), ("c", 0, 1), ("lamp", 1, 3)]


def test_files_of_about_the_target_are_not_merged_again(spark, tmp_path):
    table = sharding.Table(spark, f"file://{tmp_path}/t")
    # Runs of 64 x 300 bytes: a file that begins late holds ten of them and falls short of the target of 10.5.
    sharding.append(table, spark.range(0, 64 * 168, 1, 1).selectExpr("id AS doc_id", "repeat('x', 300) AS text"), arrival=64)
    target = 64 * 300 * 21 // 2
    assert sharding.compact(table, target=target) and table.runs().where(F.col("n_bytes") < target).count() >= 4
    assert not sharding.compact(table, target=target) and table.rows().count() == 64 * 168
