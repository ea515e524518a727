"""Album operations against the same log walked one operation at a time."""

from __future__ import annotations

import random

import pytest

from lumenframe.operators import albums as al

ALBUMS = "id long, parent long, name string, folder boolean, smart boolean, filled boolean"
OPS = "seq long, op string, id long, parent long, name string, folder boolean, smart boolean, filled boolean"


def _plain(albums, ops):
    tree = {a[0]: list(a) for a in albums}
    said = {}
    for seq, op, id_, parent, name, folder, smart, filled in sorted(ops):
        into = parent is None or (parent in tree and bool(tree[parent][3]))
        problem = None
        if op == "add":
            problem = "no id" if id_ is None else "album exists" if id_ in tree else "parent must be an existing folder" if not into else "a smart album holds rules, not photos" if smart and (folder or filled) else None
            if not problem:
                tree[id_] = [id_, parent, name, folder, smart, filled]
        elif op == "remove":
            problem = "folder is not empty" if id_ is not None and any(a[1] == id_ for a in tree.values()) else None if id_ in tree else "no such album"
            if not problem:
                del tree[id_]
        elif op == "rename":
            problem = None if id_ in tree else "no such album"
            if not problem:
                tree[id_][2] = name
        elif op == "move":
            climb, loop = parent, False
            while climb is not None and climb in tree:
                loop, climb = loop or climb == id_, tree[climb][1]
            problem = "parent must be another folder" if not into or (parent is not None and parent == id_) else "cannot move a folder into itself" if loop else None if id_ in tree else "no such album"
            if not problem:
                tree[id_][1] = parent
        else:
            problem = "unknown operation"
        said[seq] = problem
    return {tuple(a) for a in tree.values()}, said


def _run(spark, albums, ops):
    a, o = spark.createDataFrame(albums, ALBUMS), spark.createDataFrame(ops, OPS)
    after, judged, back = al.apply(a, o)
    tree, said = _plain(albums, ops)
    assert {tuple(r) for r in after.collect()} == tree
    assert {r.seq: r.problem for r in judged.collect()} == said
    return after, back, said


def test_moves_and_rules(spark):
    albums = [(1, None, "trips", True, False, False), (2, 1, "italy", True, False, False), (3, 2, "rome", False, False, True), (4, None, "best", False, True, False)]
    none = (None, None, None, None)
    ops = [
        (1, "move", 1, 2, *none), (2, "move", 1, 3, *none), (3, "move", 1, 1, *none), (4, "move", 2, None, *none), (5, "move", 1, 2, *none), (6, "remove", 2, None, *none), (7, "add", 5, 2, "smart", False, True, True),
        (8, "add", 5, 4, "x", False, False, False), (9, "add", 5, 2, "x", True, False, False), (10, "rename", 5, None, "y", None, None, None), (11, "remove", 3, None, *none), (12, "rename", 3, None, "z", None, None, None), (13, "burn", 1, None, *none), (14, "add", None, None, "n", *none[:3]),
    ]
    after, back, said = _run(spark, albums, ops)
    assert said[1] == "cannot move a folder into itself" and said[2] == said[3] == "parent must be another folder" and said[4] is None and said[5] is None
    undone, judged, _ = al.apply(after, back)
    assert {tuple(r) for r in undone.collect()} == set(albums) and judged.where("problem is not null").isEmpty()
    assert {r.id: r.path for r in al.paths(after).collect()} == {2: "italy", 1: "italy/trips", 5: "italy/y", 4: "best"}


@pytest.mark.parametrize("seed", range(2))
def test_logs_equal_walking(spark, seed):
    rnd = random.Random(seed)
    albums = [(i, rnd.choice([None, *[j for j in range(i) if j % 3]]), f"a{i}", bool(i % 3), False, False) for i in range(12)]
    ops = [(k, rnd.choice(["move", "move", "add", "remove", "rename"]), rnd.randint(0, 16), rnd.choice([None, *range(14)]), f"n{k}", rnd.random() < 0.6, rnd.random() < 0.2, rnd.random() < 0.2) for k in range(25)]
    _run(spark, albums, ops)


def test_empty(spark):
    albums = [(1, None, "a", True, False, False), (1, None, "a", True, False, False)]
    after, judged, back = al.apply(spark.createDataFrame(albums, ALBUMS), spark.createDataFrame([], OPS))
    assert [tuple(r) for r in after.collect()] == albums[:1] and judged.isEmpty() and back.isEmpty()
    assert al.paths(spark.createDataFrame([], ALBUMS)).isEmpty()


def test_circles_of_a_false_supposition(spark):
    """Two refused moves, once supposed, put folders into each other; a later move climbs into that circle."""
    none = ("n", None, None, None)
    albums = [(i, None, f"a{i}", True, False, False) for i in range(1, 6)]
    ops = [(1, "move", 2, 1, *none), (2, "move", 1, 2, *none), (3, "move", 3, 1, *none), (4, "move", 4, 3, *none), (5, "move", 1, 4, *none), (6, "move", 5, 4, *none)]
    _, _, said = _run(spark, albums, ops)
    assert [said[k] is None for k in range(1, 7)] == [True, False, True, True, False, True]


def test_paths_of_what_the_root_reaches(spark):
    rows = [(1, None, "a", True, False, False), (2, 1, "b", True, False, False), (3, 9, "lost", True, False, False), (4, 5, "c", True, False, False), (5, 4, "d", True, False, False)]
    assert {tuple(r) for r in al.paths(spark.createDataFrame(rows, ALBUMS)).collect()} == {(1, 1, "a"), (2, 2, "a/b")}
