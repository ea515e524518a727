"""Relinking against the same choices made one record at a time."""

from __future__ import annotations

import random

import pytest

from lumenframe.operators.relink import relink, relink_classes

RECORDS, FILES = "id long, name string, size long, hash string", "file string, name string, size long, hash string"


def _plain(records, files):
    used, out = set(), set()
    files = sorted({f[0]: f for f in files}.values())
    for id_, name, size, hash_ in sorted(records):
        size = size or 0
        free = [f for f in files if f[0] not in used]
        named = [f for f in free if name is not None and f[1] is not None and f[1].lower() == name.lower() and (size == 0 or f[2] == size)]
        same = [f for f in named if hash_ is not None and f[3] == hash_]
        tier, hit = (1, same[0][0]) if same else (2, None)
        if not hit and hash_ is not None and size > 0:
            hit = next((f[0] for f in free if f[2] == size and f[3] == hash_), None)
        if not hit and len(named) == 1:
            tier, hit = 3, named[0][0]
        if hit:
            used.add(hit)
            out.add((id_, hit, tier, None))
        elif named:
            out.add((id_, None, None, tuple(f[0] for f in named)))
    return out


def _got(spark, records, files):
    rows = relink(spark.createDataFrame(records, RECORDS), spark.createDataFrame(files, FILES)).collect()
    return {(r.id, r.file, r.tier, tuple(r.ambiguous) if r.ambiguous else None) for r in rows}


def test_loser_takes_its_second_choice_and_doubt_is_reported(spark):
    records = [(1, "a.jpg", 5, "h"), (2, "a.jpg", 5, "h"), (3, "b.jpg", 7, None), (4, "c.jpg", 9, "old"), (5, None, None, None), (6, "d.jpg", 0, None)]
    files = [("/1", "A.JPG", 5, "h"), ("/2", "z.jpg", 5, "h"), ("/3", "b.jpg", 7, "x"), ("/4", "b.jpg", 7, "y"), ("/5", "c.jpg", 9, "new"), ("/6", "d.jpg", 11, None), ("/7", None, 3, None)]
    want = {(1, "/1", 1, None), (2, "/2", 2, None), (3, None, None, ("/3", "/4")), (4, "/5", 3, None), (6, "/6", 3, None)}
    assert _got(spark, records, files) == want == _plain(records, files)


@pytest.mark.parametrize("seed", range(3))
def test_rounds_give_what_the_order_gives(spark, seed):
    rnd = random.Random(seed)
    pick = lambda n: (rnd.choice(["a", "A", "b", "c", None]), rnd.choice([1, 1, 2, 0, None]), rnd.choice(["h1", "h1", "h2", None]))
    records = [(i, *pick(0)) for i in range(40)]
    files = [(f"/{i:02d}", *pick(0)) for i in range(30)]
    assert _got(spark, records, files) == _plain(records, files)


def test_copies_and_empty_tables(spark):
    records, files = [(i, f"r{i % 3}", 4, "same") for i in range(60)], [(f"/{i:02d}", f"r{i % 4}", 4, "same") for i in range(50)]
    assert _got(spark, records, files) == _plain(records, files)
    assert _got(spark, [], files) == _got(spark, records, []) == set()


def test_records_in_doubt_share_a_class(spark):
    # Without classes the lists of these hold 300 x 400 files.
    records, files = [(i, "a", 5, "h" if i % 50 == 0 else None) for i in range(300)], [(f"/{i:03d}", "A", 5, "h" if i % 40 == 0 else "x") for i in range(400)]
    found, members = relink_classes(spark.createDataFrame(records, RECORDS), spark.createDataFrame(files, FILES))
    holder = {r.file: r.holder for r in members.collect()}
    assert len(holder) == 400 and {r.doubt for r in members.collect()} == {"named:/000"}
    got = set()
    for r in found.collect():
        free = tuple(sorted(f for f, h in holder.items() if h is None or h >= r.id)) if r.doubt else None
        assert r.doubt is None or (r.doubt, r.n_doubt) == ("named:/000", len(free))
        got.add((r.id, r.file, r.tier, free))
    assert got == _plain(records, files)
