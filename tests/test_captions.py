"""Caption cleaning: batch and stream agree with each other and with a plain version of the rules."""

from __future__ import annotations

import difflib
import random
import re

import pytest

from lumenframe.streaming import captions as ca

SHAPE = "c long, i int, start double, end double, text string, no_speech double, log_probability double, compression double"


def _rolling(lines):
    out = []
    for start, end, text, *_ in lines:
        text = text or ""
        again = [x for x in out[-3:] if x[2] == text]
        if again:
            if end is not None and (again[0][1] is None or end > again[0][1]):
                again[0][1] = end
        elif out and text.startswith(out[-1][2] + " "):
            out[-1][2] = text
            out[-1][1] = out[-1][1] if end is None else end
        else:
            out.append([start, end, text])
    return [tuple(x) for x in out]


def _segments(lines):
    out = []
    for start, end, text, quiet, sure, packed in lines:
        text = (text or "").strip()
        if not text or (quiet is not None and quiet > 0.6) or (sure is not None and sure < -1) or (packed is not None and packed > 2.4):
            continue
        text = _unlooped(text).strip()
        if ca.is_invented(text):
            continue
        a, b = (ca.plain(x) for x in (out[-1][2] if out else "", text))
        if out and (a == b or (a and b and difflib.SequenceMatcher(None, a, b).ratio() >= 0.88)):
            out[-1][1] = out[-1][1] if end is None else end
        else:
            out.append([start, end, text])
    return [tuple(x) for x in out]


def _unlooped(text):
    words = text.split()
    low = [w.lower().strip(".,!?;:") for w in words]
    out, i, found = [], 0, False
    while i < len(words):
        for n in (4, 3, 2, 1):
            times = 1
            while low[i : i + n] == low[i + n * times : i + n * times + n] and len(low[i : i + n]) == n:
                times += 1
            if times >= 4 and any(low[i : i + n]):
                out, i, found = out + words[i : i + n], i + n * times, True
                break
        else:
            out, i = [*out, words[i]], i + 1
    return " ".join(out) if found else text


@pytest.fixture(scope="module")
def lines():
    rnd = random.Random(9)
    pool = ["hell", "hello world", "hello", "hello world again", "", None, "Thank you for watching!", "♪ ♪", "[Music]", "the the the the the end", "so", "a b a b a b a b c", "no no no", "Hello, world", "hello world!"]
    rows = {}
    for c in (1, 2, None):
        rows[c] = [(c, i, float(i), rnd.choice([i + 1.5, None]), rnd.choice(pool), *(rnd.choice([None, None, None, x]) for x in (0.7, -1.5, 3.0))) for i in range(120)]
    return rows


@pytest.mark.parametrize("how,rule", [("rolling", _rolling), ("segments", _segments)])
def test_batch_and_stream_equal_plain_rules(spark, lines, tmp_path, how, rule):
    want = {(c, n, *x) for c, rows in lines.items() for n, x in enumerate(rule([r[2:] for r in rows]))}
    rows = [r for x in lines.values() for r in x]
    batch = ca.cleaned(spark.createDataFrame(rows, SHAPE).repartition(7), how, "c", "i")
    assert {tuple(r) for r in batch.collect()} == want
    source = str(tmp_path / "in")
    for k in range(3):  # three files, read one at a time
        part = [r for r in rows if k * 40 <= r[1] < k * 40 + 40]
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(source)
    got: dict = {}

    def take(df, _):
        for r in df.collect():
            got[r.c, r.n] = tuple(r)

    query = ca.cleaned_stream(stream, how, "c", "i").writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert set(got.values()) == want


def test_loops_and_invented_phrases():
    assert ca.without_loops("the the the the the") == ("the", 4) and ca.without_loops("no no no") == ("no no no", 0)
    rnd = random.Random(1)
    for _ in range(500):
        text = " ".join(rnd.choice(["a", "b", "A,", "c", "."]) for _ in range(rnd.randint(0, 30)))
        assert ca.without_loops(text)[0] == _unlooped(text), text
    assert all(map(ca.is_invented, ["", " ♪♫ ", "[Música]", "Subtitles by someone", "you", "see AMARA.org now"])) and not any(map(ca.is_invented, ["music box", "you there", "so so"]))


def test_edges(spark, lines):
    assert ca.cleaned(spark.createDataFrame([], SHAPE), "rolling", "c", "i").isEmpty()
    keep = spark.createDataFrame([(1, 0, "hell"), (1, 1, "hello world"), (2, 0, ""), (2, 1, "x"), (2, 2, "")], "c long, i int, text string").selectExpr("*", "0D start", "1D end", "'a' key", "5 place")
    got = {(r.c, r.n, r.text) for r in ca.cleaned(keep, "rolling", "c", "i").collect()}
    assert got == {(1, 0, "hell"), (1, 1, "hello world"), (2, 0, ""), (2, 1, "x")}
    assert re.search("MapInPandas", ca.cleaned(keep, "rolling", "c", "i")._jdf.queryExecution().toString())
