"""Rules, functions and streams in small cases."""

from __future__ import annotations

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import extract
from lumenframe.operators import dedupe, filters, rules
from lumenframe.streaming import events as stream


def _verdicts(spark, rows, schema, predicate):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(predicate.alias("p")).collect()]


def test_rolling_captions_keep_whole_turns(spark, tmp_path):
    from lumenframe.plans import registry

    turns = [(1, 0, "user", "a" * 50 + " one"), (1, 1, "user", "a" * 50 + " two")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.queries()["W05_G08_rolling_captions"](spark, str(tmp_path)).orderBy("n").collect()
    assert [r.text for r in got] == [t[3] for t in turns]


def test_hamming_join_takes_large_ids(spark, tmp_path):
    from lumenframe.plans import registry

    docs = [(10**8 + k, "one two three four five six seven", "en", "a", 33) for k in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.queries()["J08_hamming_join"](spark, str(tmp_path)).count() == 3


def test_account_numbers_with_check_digits_that_are_never_given(spark, tmp_path):
    import duckdb

    from lumenframe.plans import registry

    # Every remainder of the body with every pair of digits of its own, 01 among them.
    spark.range(98 * 97).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()["N07_valid_shares"]).fetchall()[0][0]
    assert registry.queries()["N07_valid_shares"](spark, str(tmp_path)).first().n == want == 96


def test_empty_rule_sets(spark):
    found = {m: _verdicts(spark, [(1,)], "x int", rules.compile_rules({"match": m, "rules": []}))[0] for m in ("all", "any", "none")}
    assert found == {"all": True, "any": False, "none": True}


def test_contains_and_not_contains_are_no_complements(spark):
    has = rules.compile_rules({"rules": [{"field": "name", "op": "contains", "value": "a b"}]})
    lacks = rules.compile_rules({"rules": [{"field": "name", "op": "notContains", "value": "a b"}]})
    rows = [("a b",), ("a",), ("c",), (None,)]
    assert _verdicts(spark, rows, "name string", has) == [True, False, False, False]
    assert _verdicts(spark, rows, "name string", lacks) == [False, False, True, True]


def test_null_numbers_and_dates(spark):
    rows = [(None, None)]
    for field, op, value, want in [("iso", "isNot", 3, True), ("iso", "lt", 3, False), ("captured", "notInLast", 3, True), ("captured", "isNot", "1999", False)]:
        assert _verdicts(spark, rows, "iso int, captured string", rules.compile_rules({"rules": [{"field": field, "op": op, "value": value}]})) == [want]


def test_problems_and_unknown_filters():
    assert rules.problems({"rules": [{"field": "x", "op": "is"}, {"rules": [{"field": "iso", "op": "contains"}]}]}) == ["unknown field x", "iso: unknown operator contains"]
    for bad in ({"shape": 1}, {"orientation": "square"}, {"month": 13}):
        with pytest.raises(filters.FilterError):
            filters.library_predicates(bad)


def test_hamming_join_is_exact(spark):
    rnd = random.Random(42)
    bits = [rnd.getrandbits(63) for _ in range(300)]
    bits += [b ^ sum(1 << p for p in rnd.sample(range(60), rnd.randint(1, 7))) for b in bits[:60]]
    rows = spark.createDataFrame(list(enumerate(bits)), "id long, bits long")
    got = {(r.id_a, r.id_b) for r in dedupe.hamming_pairs(rows, "id", "bits", 6).collect()}
    assert got == {(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if (bits[i] ^ bits[j]).bit_count() <= 6}


def test_blocks_of_alike_hashes_are_counted_and_joined_without_pairs(spark, monkeypatch):
    rnd = random.Random(3)
    bits = [rnd.getrandbits(59) for _ in range(40)]
    # A crowd of which most are near one another, and one far from it.
    bits += [bits[0] ^ sum(1 << p for p in rnd.sample(range(12), rnd.randint(0, 5))) for _ in range(260)]
    bits = sorted(set(bits))
    monkeypatch.setattr(dedupe, "BLOCK", 50)
    rows = spark.createDataFrame(list(enumerate(bits)), "id long, bits long")
    near = {i: {j for j, y in enumerate(bits) if i != j and (x ^ y).bit_count() <= 6} for i, x in enumerate(bits)}
    assert {r.id: r.n for r in dedupe.near_counts(rows, 6).collect()} == {i: len(n) for i, n in near.items() if n}
    forest = dedupe.near_forest(rows, 6)
    cells = (-(-len(bits) // 50)) ** 2
    assert forest.count() < cells * 50 < sum(map(len, near.values())) / 2
    joined = {r.node: r.component for r in dedupe.components(forest, "id_a", "id_b").collect()}
    want = {}
    for i in near:
        todo = [i] if i not in want and near[i] else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = i
                todo += near[x]
    assert joined == want
    members = spark.createDataFrame([(c, bits[i]) for i, c in joined.items()], "component long, bits long")
    assert {r.component: r.max_distance for r in dedupe.widest(members, "component").collect()} == {c: max((bits[i] ^ bits[j]).bit_count() for i in want for j in want if want[i] == want[j] == c) for c in want.values()}


def _chained(bits, most):
    """The smallest place that chains of near ones join each place to, of those that have any near one."""
    found, want = {i: [j for j, y in enumerate(bits) if i != j and (x ^ y).bit_count() <= most] for i, x in enumerate(bits)}, {}
    for i in found:
        todo = [i] if i not in want and found[i] else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = i
                todo += found[x]
    return want


@pytest.mark.parametrize("most", [0, 3, 6, 9])
def test_groups_around_a_core_and_the_rest_are_joined_exactly(spark, monkeypatch, most):
    """Two crowds, a chain that joins one to a third, hashes near a crowd's rim and lone ones, with 64 bits."""
    monkeypatch.setattr(dedupe, "BLOCK", 90)
    monkeypatch.setattr(dedupe, "FEW", 5)
    rnd = random.Random(most)
    flip = lambda b, n: b ^ sum(1 << p for p in rnd.sample(range(64), n))
    centres = [rnd.getrandbits(64) for _ in range(3)]
    bits = [flip(c, rnd.randint(0, most)) for c, n in zip(centres, (200, 120, 60)) for _ in range(n)] + [flip(c, most + 2) for c in centres for _ in range(20)] + [rnd.getrandbits(64) for _ in range(30)]
    apart = [p for p in range(64) if (centres[0] ^ centres[1]) >> p & 1]
    bits += [centres[0] ^ sum(1 << p for p in apart[:n]) for n in range(0, len(apart), max(1, most))]
    bits = [b - (1 << 64) if b >> 63 else b for b in dict.fromkeys(bits)]
    rnd.shuffle(bits)
    rows = spark.createDataFrame([*enumerate(bits), (None, bits[0] ^ 1)], "id long, bits long").repartition(3)
    want = _chained([b % (1 << 64) for b in bits], most)
    joined = [(r.node, r.component) for r in dedupe.near_components(rows, most).collect()]
    assert dict(joined) == want and len(joined) == len(want)
    forest = dedupe.near_forest(rows, most)
    assert {r.node: r.component for r in dedupe.components(forest, "id_a", "id_b").collect()} == want
    members = spark.createDataFrame([(c, bits[i]) for i, c in want.items()], "component long, bits long")
    groups = {}
    for i, c in want.items():
        groups.setdefault(c, []).append(bits[i] % (1 << 64))
    assert {r.component: r.max_distance for r in dedupe.widest(members, "component").collect()} == {c: max((x ^ y).bit_count() for x in g for y in g) for c, g in groups.items()}


def test_crowds_are_joined_without_comparing_their_members(spark):
    """A crowd around one hash meets no bucket of its own; the links that leave cells do not grow with it."""
    rnd = random.Random(8)
    crowd = list({sum(1 << p for p in rnd.sample(range(60), rnd.randint(0, 3))) for _ in range(3000)})
    far = [(1 << 60) - 1, (1 << 60) - 2, (1 << 30) - 1]
    rows = spark.createDataFrame(list(enumerate(crowd + far)), "id long, bits long")
    labelled = dedupe._labelled(rows, 6).cache()
    assert labelled.where("core = 0").count() == len(crowd) and dedupe._buckets(labelled.where("core = 0"), 6).isEmpty()
    assert [(r.id_a, r.id_b) for r in dedupe._label_links(labelled, 6).distinct().collect()] == [(len(crowd), len(crowd) + 1)]


def test_simhash_sums_words_where_they_are(spark):
    """Texts of up to a thousand words, ties, repeated and null ids, rows without words; the plan has no shuffle."""
    rnd = random.Random(5)
    words = [[f"w{rnd.randint(0, 40)}é" for _ in range(n)] for n in (1, 2, 254, 255, 256, 510, 511, 1000)] + [["a"] * 600, [], None, ["b", "b", "c", "d"]]
    docs = spark.createDataFrame([(i if i != 3 else None, w) for i, w in enumerate(words)] + [(0, ["z"])], "doc long, words array<string>")
    for bits in (60, 32):
        digests = lambda w: [int(hashlib.md5(x.encode()).hexdigest()[: bits // 4], 16) for x in w]
        voted = lambda w: sum(1 << k for k in range(bits) if sum((d >> k & 1) * 2 - 1 for d in digests(w)) > 0)
        found = dedupe.simhash(docs, "doc", F.col("words"), bits)
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(str((r.doc, voted(r.words))) for r in docs.collect() if r.words)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in dedupe.components(pairs, "a", "b").collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 100: 100, 101: 100}


def test_chunks_are_slices():
    text = " ".join(f"word{i}." if i % 9 == 0 else f"word{i}" for i in range(900)) + "\n\nend"
    spans = extract.chunk_spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= extract.SIZE + extract.MIN_TAIL and c <= b for (a, b), (c, _) in zip(spans, spans[1:]))


def test_small_extractors():
    assert extract.dates_in("on 2024-02-30, 3 de mayo de 1997 and 01/02/2020") == ["1997-05-03", "2020-02-01"]
    moves = extract.settle({"a": 50, "b": -20, "c": -30})
    assert sum(n for _, _, n in moves) == 50 and {p for p, _, _ in moves} == {"b", "c"}
    page = extract.read_html("<title>T</title><nav>menu</nav><p>one<p>two<script>x</script><div hidden>no</div>")
    assert page["title"] == "T" and page["text"].split() == ["one", "two"]


def test_settling_many_takes_largest_first_and_little_time():
    def plain(left):
        out = []
        while any(v > 0 for v in left.values()) and any(v < 0 for v in left.values()):
            to, by = max(sorted(left), key=left.get), min(sorted(left), key=left.get)
            n = min(left[to], -left[by])
            out.append((by, to, n))
            left = {**left, to: left[to] - n, by: left[by] + n}
        return out

    rnd = random.Random(7)
    few = {f"p{i}": rnd.randint(-9, 9) for i in range(60)}
    for case in (few, {**few, "p0": few["p0"] - sum(few.values())}, {}, {"a": 0, "b": 5}):
        assert extract.settle(case) == plain(case)
    # As many as a nation has at 60 times sf0.1; choosing among all for each transfer takes many minutes.
    many = {f"p{i:05d}": (i * 7919) % 99991 - 49995 for i in range(36_000)}
    began = time.process_time()
    moves = extract.settle(many)
    assert time.process_time() - began < 20
    credit, debt = (sum(v for v in many.values() if v > 0), -sum(v for v in many.values() if v < 0))
    assert sum(n for *_, n in moves) == min(credit, debt)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:{i % 60:02d}:00", i % 3, float(i)) for i in range(200)]
    table = spark.createDataFrame(rows, "event_id long, ts string, kind int, value double").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("kind").cast("string").alias("event_type"), "value")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    live = stream.read_files(spark, str(tmp_path / "in"), table.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), 3)
    q = stream.apply_batches(live, str(tmp_path / "out"), str(tmp_path / "check"), "event_type", "event_id")
    q.awaitTermination(120)
    got = {r.event_type: r.event_id for r in spark.read.parquet(str(tmp_path / "out" / "v0")).collect()}
    assert got == {"0": 198, "1": 199, "2": 197}
    counts = stream.windowed_counts(live).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    counts.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, stream.windowed_counts(table).collect()))
