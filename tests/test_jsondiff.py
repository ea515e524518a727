"""JSON comparison against a recursive walk of parsed documents."""

from __future__ import annotations

import json
import random

from lumenframe.operators.jsondiff import MISSING, first_difference


def _walk(a, b, path=""):
    if isinstance(a, dict) and len(a) == 1 and set(a) <= {"$approx", "$range", "$oneof"}:
        (how, spec), number = next(iter(a.items())), lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
        ok = any(type(x) is type(b) and x == b for x in spec) if how == "$oneof" else number(b) and abs(b - spec[0]) <= spec[1] if how == "$approx" else bool(b) and all(number(x) and spec[0] <= x <= spec[1] for x in b) if isinstance(b, list) else number(b) and spec[0] <= b <= spec[1]
        return None if ok else path or "$"
    if type(a) is not type(b):
        return path or "$"
    if isinstance(a, (dict, list)):
        keys = sorted(set(a) | set(b)) if isinstance(a, dict) else range(max(len(a), len(b)))
        for k in keys:
            at = f"{path}.{k}" if isinstance(a, dict) else f"{path}[{k}]"
            there = (k in a, k in b) if isinstance(a, dict) else (k < len(a), k < len(b))
            found = at if not all(there) else _walk(a[k], b[k], at)
            if found:
                return found
        return None
    return None if a == b else path or "$"


def _random(rnd, depth=0):
    kind = rnd.random()
    if depth < 3 and kind < 0.3:
        return {rnd.choice("abcd"): _random(rnd, depth + 1) for _ in range(rnd.randint(0, 3))}
    if depth < 3 and kind < 0.55:
        return [_random(rnd, depth + 1) for _ in range(rnd.randint(0, 12 if depth == 1 else 3))]
    return rnd.choice([1, 1.0, 2.5, True, False, None, "x", "é", 10**20])


def _changed(rnd, x):
    if rnd.random() < 0.15:
        return _random(rnd, 2)
    if isinstance(x, dict):
        return {k: _changed(rnd, v) for k, v in x.items() if rnd.random() < 0.95}
    return [_changed(rnd, v) for v in x] if isinstance(x, list) else x


def test_equals_a_recursive_walk(spark):
    rnd = random.Random(7)
    pairs = [(x, _changed(rnd, x)) for x in (_random(rnd) for _ in range(400))]
    specs = [({"$approx": [1, 0.5]}, 1.4), ({"$approx": [1, 0.5]}, 1.6), ({"$approx": [1, 1]}, True), ({"$range": [0, 3]}, [1, 2.5]), ({"$range": [0, 3]}, [1, 9]), ({"$range": [0, 3]}, []), ({"$range": [0, 3]}, 2), ({"$oneof": [1, "a"]}, "a"), ({"$oneof": [1, "a"]}, 1.0), ({"k": {"$oneof": [None]}}, {"k": None}), ({"$approx": [1, 1], "x": 2}, {"$approx": [1, 1], "x": 3})]
    pairs += specs + [([1, {"a": [5]}], [1, {"a": [5.0]}]), ([1, 2.0], [1.0, 2])]
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)]
    got = {r.i: r.path for r in first_difference(spark.createDataFrame(rows, "i int, a string, b string"), "i", "a", "b").collect()}
    assert got == {i: p for i, (a, b) in enumerate(pairs) if (p := _walk(a, b))}


def test_odd_documents(spark):
    rows = [(1, None, None), (2, None, "1"), (3, "{", "{"), (4, "", "null"), (5, "[]", "{}"), (6, '{"b":1,"a":1}', '{"a":1,"b":1}'), (7, "[1]", "[1,2]")]
    df = spark.createDataFrame(rows, "i int, a string, b string").selectExpr("i", "a AS path", "b AS place")
    got = {r.i: (r.path, r.expected, r.actual) for r in first_difference(df, "i", "path", "place").collect()}
    assert got == {2: ("$", MISSING, "1"), 4: ("$", MISSING, "null"), 5: ("$", "[]", "{}"), 7: ("[1]", MISSING, "2")}
    assert first_difference(spark.createDataFrame([], "i int, a string, b string"), "i", "a", "b").isEmpty()
