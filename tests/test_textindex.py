"""The stored text index against plain counting, with added and replaced documents."""

from __future__ import annotations

import math
import random
import re
import unicodedata

import pytest

from lumenframe.operators.textindex import TextIndex

SHAPE = "id long, text string"


def _tokens(text):
    folded = "".join(unicodedata.normalize("NFD", c)[0] for c in text or "").lower()
    return re.findall(r"[^\W_]+", folded)


def _stem(w):
    return w[:-2] if len(w) > 5 and w.endswith("es") else w[:-1] if len(w) > 4 and w.endswith("s") else w


def _bm25(docs, terms):
    stems = {i: [_stem(w) for w in _tokens(t)] for i, t in docs.items()}
    held = [s for s in stems.values() if s]
    n, avg = len(held), sum(map(len, held)) / max(1, len(held))
    out = {}
    for i, s in stems.items():
        score = 0
        for t in terms:
            df = sum(t in x for x in held)
            tf = s.count(t)
            score += max(0.1, math.log(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(s) / avg)) if tf else 0
        if score:
            out[i] = round(score, 9)
    return out


def _same(spark, index, docs, terms):
    want = _bm25(docs, terms)
    assert {r.id: round(r.score, 9) for r in index.scores(terms).collect()} == want
    for k in (1, 3, 1000):
        assert [r.id for r in index.top(terms, k).collect()] == sorted(want, key=lambda i: (-want[i], (i is not None, i or 0)))[:k]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rnd = random.Random(6)
    text = lambda: " ".join(rnd.choice(["the", "houses", "house", "Réd", "tries", "of", "sea", "a1", "—"]) for _ in range(rnd.randint(1, 30)))
    docs = {i: text() for i in range(2500)} | {9000: None, 9001: "", 9002: " .. "}
    df = spark.createDataFrame(list(docs.items()), SHAPE).selectExpr("id", "text", "1 AS dl", "2 AS term")
    return TextIndex(spark, f"file://{tmp_path_factory.mktemp('index')}").add(df, "id", "text"), docs, text


def test_scores_and_early_end_equal_plain_counting(spark, built):
    index, docs, _ = built
    _same(spark, index, docs, ["house", "red"])
    _same(spark, index, docs, ["sea"])
    assert index.top(["nothing"], 5).isEmpty() and TextIndex(spark, "file:///none").scores(["x"]).isEmpty()


def test_only_blocks_with_a_chance_are_scored(spark, tmp_path):
    docs = [(i, "plain words here" + (" rare" * 9 if i == 77 else " rare and many more words that make it long" if i % 50 == 0 else "")) for i in range(5000)]
    index = TextIndex(spark, f"file://{tmp_path}/i").add(spark.createDataFrame(docs, SHAPE), "id", "text")
    assert index.postings(["rare"]).count() > 3
    assert index.top(["rare"], 1).first().id == 77


def test_reads_name_the_files_and_filter_of_a_stem(spark, built):
    plan = built[0].postings(["house"])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(term,house)" in plan or "In(term" in plan
    assert len(built[0].postings(["house"]).inputFiles()) < len(spark.read.parquet(built[0].segments[0] + "/postings").inputFiles())


def test_added_and_replaced_documents(spark, built):
    index, docs, text = built
    for _ in range(2):
        new = {5: "houses houses sea", 9000: "red sea", 10_000: "the red house", 10_001: None, 7: None}
        index = index.add(spark.createDataFrame(list(new.items()), SHAPE), "id", "text")
        docs = docs | new
    _same(spark, index, docs, ["house", "red"])
    phrase = {r.id: r.n for r in index.phrase(["the", "red"]).collect()}
    want = {i: n for i, t in docs.items() if (n := sum(p == ("the", "red") for p in zip(_tokens(t), _tokens(t)[1:])))}
    assert phrase == want


def test_ladder(spark, built):
    index, docs, _ = built
    words = {i: set(_tokens(t)) for i, t in docs.items()}
    assert {(r.id, r.tier) for r in index.ladder(["house", "red"]).collect()} == {(i, 0) for i, w in words.items() if {"house", "red"} <= w}
    begun = {(i, 1) for i, w in words.items() if any(x.startswith("hou") for x in w) and any(x.startswith("re") and x == "re" or x.startswith("sea") for x in w)}
    assert {(r.id, r.tier) for r in index.ladder(["hou", "sea", "sea"]).collect()} == begun
    assert {(r.id, r.tier) for r in index.ladder(["zzz", "a1"]).collect()} == {(i, 2) for i, w in words.items() if "a1" in w}
    assert index.ladder([]).isEmpty()


def test_words_are_grouped_before_they_are_shuffled(spark, tmp_path):
    """A row of postings for a stem and block, made in pieces when a block's texts are long; stems as Spark's."""
    from pyspark.sql import functions as F

    from lumenframe.operators.ranking import plain_stem, stem

    words = ["as", "gases", "boxes", "trees", "class", "es", "ñandues", "𝒳𝒳es", ""]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == {w: plain_stem(w) for w in words}
    # 300,000 different pairs of words and documents would be as many shuffled rows; one block shuffles one a stem.
    docs = spark.range(600).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("text"))
    index = TextIndex(spark, f"file://{tmp_path}/one").add(docs, "id", "text")
    made = spark.read.parquet(*_made(spark))
    assert made.where("term is not null").count() == 500 and made.where("term is not null").agg(F.max("n")).first()[0] == 600
    assert index.phrase(["w7", "w8"]).count() == 600
    # Texts longer than a slice of words make several rows of one stem and block.
    long = spark.range(3).select("id", F.repeat(F.lit("so it goes "), 400_000).alias("text"))
    index = TextIndex(spark, f"file://{tmp_path}/long").add(long, "id", "text")
    assert index.postings(["so"]).count() == 3
    assert {(r.id, r.n) for r in index.phrase(["it", "goes"]).collect()} == {(i, 400_000) for i in range(3)}


def _made(spark):
    """The newest stored postings of this session."""
    import glob
    import os

    from lumenframe.operators.checkpoints import shared_folder

    return [max(glob.glob(f"{shared_folder(spark).removeprefix('file://')}/text-postings-*"), key=os.path.getmtime)]
