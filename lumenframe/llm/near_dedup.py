"""Near-duplicate groups through an LSH forest.

Each text is the set of its word shingles. Equal sets become one class first, so copies never
multiply. A class has 128 MinHash values: 16 trees of 8. In each tree the classes stand in the
order of their eight values; those with the same first 4 values form a region, at every size, and
neighbours in the order, which share the longest prefixes, are candidates: where a region is
dense, its order goes as deep as the values do. Regions of more than ``REGION`` rows are dealt out
for ordering.

Three searches follow one another, and classes that a search links count as one for the next:
neighbours in each order; in regions that still hold several components, the classes with the most
links so far, which finds hubs whose copies differ from one another; then every pair of different
components within such regions that the threshold may link. The last one is exact: two sets share
the threshold only if they share one of their rarest shingles early enough in both. Pairs are tried
best first, and those whose classes meet meanwhile are left out, so a group that is joined makes no
more of them. A pair at the threshold shares 4 values in at least one of 16 trees with a
probability above 0.9997, and nearer pairs sooner; 2-bit fingerprints of all 128 values drop
candidates only when they are 5 standard deviations below the threshold. Links are confirmed on
the full sets.

Defined results: a text that is null, empty or without words has no shingles and stands alone;
so does a row with a null id, whose component is null and which is kept. Rows that repeat fall
into one class. An empty table gives an empty result. Other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import Scratch, pieces, sifted, store
from lumenframe.llm.components import components
from lumenframe.llm.shingles import shingle_sets

TREES, DEPTH = 16, 8
HASHES = TREES * DEPTH
#: Classes of a region that are put in order together; neighbours on each side in an order.
REGION, NEIGHBOURS = 5_000, 2
#: Classes of a region, each the one with the most links in its share, that all others are compared with.
PIVOTS = 2
#: Pairs of one class, and rows of one shingle, that meet in one place; more are dealt out.
SPLIT = 256
#: Counters of shingles, by their last bits, that tell rare ones; any counts find all pairs.
COUNTERS = 1 << 18

_RNG = np.random.default_rng(7)
_A, _B = (_RNG.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
BITS = ["b0", "b1", "b2", "b3"]
_SKETCH = "doc_id long, n long, h1 long, h2 long, trees binary, b0 long, b1 long, b2 long, b3 long"


def signature(shingles: np.ndarray) -> np.ndarray:
    """The ``HASHES`` MinHash values of a set of 64-bit hashes."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 2048):
        value = low[i : i + 2048, None] * _A + high[i : i + 2048, None] * _B
        np.minimum(best, (value ^ (value >> np.uint32(15))).min(axis=0), out=best)
    return best


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            n, h1, h2, trees, bits = [], [], [], [], []
            for s in shingle_sets(_texts(batch.column(1)), width):
                n.append(len(s))
                h1.append(s.sum(dtype=np.uint64))
                h2.append(np.bitwise_xor.reduce(s * (s | np.uint64(1)), initial=np.uint64(0)))
                sig = signature(s)
                trees.append(sig.astype(">u4").tobytes() if len(s) else None)
                two = ((sig & np.uint32(3)).astype(np.uint64).reshape(4, 32) << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                bits.append(two.view(np.int64))
            bits = np.array(bits, np.int64).reshape(-1, 4)
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            columns = [batch.column(0), pa.array(n, pa.int64()), as_long(h1), as_long(h2), pa.array(trees, pa.binary())]
            columns += [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "h1", "h2", "trees", "b0", "b1", "b2", "b3"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            sets = list(shingle_sets(_texts(batch.column(1)), width))
            asked = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            right = [i for i, s in enumerate(sets) if s.sum(dtype=np.uint64) == asked[i]]
            at = np.cumsum([0] + [len(sets[i]) for i in right])
            flat = np.concatenate([sets[i] for i in right]).view(np.int64) if right else np.empty(0, np.int64)
            column = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right, pa.int64())), column], ["node", "shingles"])

    return run


def _differ(a: str, b: str) -> Column:
    """How many of the 128 values differ in their last two bits."""
    odd = 0x5555555555555555
    total = F.lit(0)
    for k in range(4):
        x = F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}"))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(odd)))
    return total


def _most_differ(percent: int) -> int:
    """Differing values that a pair at the threshold exceeds by chance in less than one of a million."""
    p = 0.75 * (1 - percent / 100)
    return int(np.ceil(HASHES * p + 5 * np.sqrt(HASHES * p * (1 - p))))


def _regions(classes: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A row for each class and tree, with the region it stands in; regions of one are left out.

    Only keys are counted in full: rows whose key is surely nobody else's are left out before anything is shuffled."""
    label = f"substring(trees, tree * {4 * DEPTH} + 1, {{}})"
    rows = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).withColumn("r4", F.xxhash64("tree", F.expr(label.format(16))))
    shared = rows.groupBy("r4").agg(F.count(F.lit(1)).alias("r4_n"))
    shared = keep(shared.where("r4_n > 1"))
    rows = rows.select("node", "n", *BITS, F.expr(f"substring(trees, tree * {4 * DEPTH} + 17, {4 * DEPTH - 16})").alias("label"), "r4")
    rows = sifted(rows, F.col("r4"), shared.select("r4")).where("_hit").drop("_hit").join(shared, "r4")
    deals = F.ceil(F.col("r4_n") / REGION).cast("int")
    return rows.select("node", "n", *BITS, "label", "r4", deals.alias("deals"), F.pmod(F.xxhash64("node", "r4"), deals).cast("int").alias("deal"))


def _first_rows(sketches: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``sketches`` that ``classes`` are named after. Rows that no copy can be take no part in the join."""
    valid = sketches.where("n > 0 and doc_id is not null")
    copies = scratch.keep(valid.select("node").join(classes.select("node"), "node", "left_anti"))
    rows = sifted(valid, F.xxhash64("node"), copies.select(F.xxhash64("node")))
    asked = rows.where("_hit").join(classes.select("node"), "node", "left_semi").select(rows.columns)
    return rows.where("not _hit").unionByName(asked).drop("_hit")


def _state(links: DataFrame) -> DataFrame:
    """``node, component, degree`` of linked classes, as far as three steps along links show. A
    component may still be named in parts, which costs comparisons and loses none."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    state = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select(F.col("u").alias("node"), F.least("u", "m").alias("component"), "degree")
    for _ in range(2):
        far = both.join(state.select(F.col("node").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("m"))
        state = state.join(far, F.col("node") == F.col("u")).select("node", F.least("component", "m").alias("component"), "degree")
    return state


def _every_deal(rows: DataFrame) -> DataFrame:
    """A row for each deal of its region: what all rows of a large region meet is dealt out too."""
    return rows.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")


def _still_open(regions: DataFrame, state: DataFrame) -> DataFrame:
    """The rows of regions whose classes are not all joined yet, with their present components."""
    rows = regions.join(state, "node", "left")
    rows = rows.withColumn("component", F.coalesce("component", "node")).withColumn("degree", F.coalesce("degree", F.lit(0)))
    ends = rows.groupBy("r4").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.first("deals").alias("deals"))
    return rows.join(_every_deal(ends.where("low != high").select("r4", "deals")), ["r4", "deal"])


def _likely(found: DataFrame, percent: int) -> DataFrame:
    """Pairs of structs ``a, b`` as ``u, v, far``, without those that sizes or fingerprints rule out."""
    far = _differ("a", "b")
    sizes = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    found = found.where(sizes & (far <= _most_differ(percent)))
    return found.groupBy(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).agg(F.min(far).alias("far"))


def _neighbours(regions: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that are next to one another in an order."""
    order = Window.partitionBy("r4", "deal").orderBy("label", "n", "node")
    near = regions.select("r4", "deal", "label", "n", "node", F.struct("node", "n", *BITS).alias("a"))
    near = near.select("a", F.array_compact(F.array(*[F.lead("a", k).over(order) for k in range(1, NEIGHBOURS + 1)])).alias("next"))
    return _likely(near.select("a", F.explode("next").alias("b")), percent)


def _hubs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes and their region's pivots, in different components."""
    me = F.struct("node", "n", "component", *BITS)
    rank = F.struct(F.col("degree").alias("d"), F.col("copies").alias("c"), F.col("node").alias("k"), me.alias("b"))
    top = rows.groupBy("r4", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("share")).agg(F.max(rank).alias("top"), F.first("deals").alias("deals"))
    pivots = _every_deal(top.select("r4", "deals", F.col("top.b").alias("b")))
    found = rows.select("r4", "deal", me.alias("a")).join(pivots, ["r4", "deal"]).where("a.component != b.component")
    return _likely(found, percent)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shingles -> (slot, c): how many fall on each counter."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        total += np.bincount(flat & (COUNTERS - 1), minlength=COUNTERS)
    slot = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "c"])


def _rarest(counts, percent: int):
    """(node, shingles) -> a row for each of a set's rarest shingles. Two sets that share
    ``percent`` hundredths of their union share as much of each, so in any common order of shingles
    the first ``n - ceil(n * percent / 100) + 1`` of both have one in common. ``ahead`` counts the
    set's shingles from this one on: no later ones can be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column(1)
            flat, ends = sets.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *sets.value_lengths().to_numpy(zero_copy_only=False)])
            often = counts.value[flat & (COUNTERS - 1)]
            found = []
            for lo, hi in zip(ends[:-1], ends[1:]):
                first = (hi - lo) - -(-(hi - lo) * percent // 100) + 1
                found.append(lo + np.lexsort((flat[lo:hi], often[lo:hi]))[:first])
            at = np.concatenate(found) if found else np.empty(0, np.int64)
            ahead = np.concatenate([hi - lo - np.arange(len(x)) for lo, hi, x in zip(ends[:-1], ends[1:], found)]) if found else at
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(flat[at]), pa.array(ahead.astype(np.int64))], ["node", "shingle", "ahead"])

    return run


def _rest(open_rows: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """All pairs of classes of ``open_rows``, in different components, that the threshold may link:
    ``u, v``, their components ``cu, cv``, and ``far``.

    The shorter set of a linked pair shares one of fewer first shingles than the longer one, for
    what both share is more of it. Rows of a frequent shingle are dealt out, and those of shorter
    sets meet each deal."""
    classes = scratch.keep(open_rows.groupBy("node").agg(F.first("n").alias("n"), F.first("component").alias("component"), *[F.first(b).alias(b) for b in BITS]))
    known = sets.join(classes.select("node"), "node", "left_semi").select("node", "shingles")
    tally = known.select("shingles").mapInArrow(_tally, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()  # at most COUNTERS rows
    counts = np.zeros(COUNTERS, np.int64)
    counts[tally.column("slot").to_numpy()] = tally.column("c").to_numpy()
    rarest = _rarest(open_rows.sparkSession.sparkContext.broadcast(counts), percent)
    rows = known.mapInArrow(rarest, "node long, shingle long, ahead long").join(classes, "node")
    several = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    rows = scratch.keep(rows.join(several.select("shingle", F.ceil(F.col("k") / SPLIT).cast("int").alias("deals")), "shingle"))
    me = F.struct("node", "n", "component", "ahead", *BITS)
    # A set shares (na + nb) * p / (100 + p) with one as long or longer, so this much of its own.
    short = rows.where(F.col("ahead") * (100 + percent) >= 2 * F.col("n") * percent)
    a = _every_deal(short.select("shingle", "deals", me.alias("a")))
    b = rows.select("shingle", F.pmod(F.xxhash64("node"), "deals").cast("int").alias("deal"), me.alias("b"))
    ordered = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.node") < F.col("b.node")))
    enough = F.least("a.ahead", "b.ahead") * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent
    sizes = F.col("a.n") * 100 >= F.col("b.n") * percent
    far = _differ("a", "b")
    found = a.join(b, ["shingle", "deal"]).where((F.col("a.component") != F.col("b.component")) & ordered & enough & sizes & (far <= _most_differ(percent)))
    first = F.col("a.node") < F.col("b.node")
    pick = lambda x, name: F.when(first if x else ~first, F.col(f"a.{name}")).otherwise(F.col(f"b.{name}"))
    return found.select(pick(1, "node").alias("u"), pick(0, "node").alias("v"), pick(1, "component").alias("cu"), pick(0, "component").alias("cv"), far.alias("far")).distinct()


def _apart(pairs: DataFrame, merged: DataFrame) -> DataFrame:
    """``pairs`` whose components are still different ones after ``merged``."""
    found = pairs
    for end in ("cu", "cv"):
        found = found.join(merged.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left")
    return found.where(F.coalesce("_cu", "cu") != F.coalesce("_cv", "cv")).select(*pairs.columns)


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str, other: str, name: str) -> DataFrame:
    """``pairs`` with the set of one end. A class of more than ``SPLIT`` pairs is dealt out."""
    own = sets.select(F.col("node").alias(end), F.col("shingles").alias(name))
    hubs = pairs.groupBy(end).agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("deals")).where("deals > 1")
    if hubs.isEmpty():
        return pairs.join(own, end)
    hubs = F.broadcast(hubs)  # a row for SPLIT pairs at most; the sets move once
    pairs = pairs.join(hubs, end, "left").withColumn("deal", F.pmod(F.xxhash64(other), F.coalesce("deals", F.lit(1))).cast("int")).drop("deals")
    own = own.join(hubs, end, "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
    return pairs.join(_every_deal(own), [end, "deal"]).drop("deal")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs``, a stored table, whose full sets are as similar as asked for."""
    both = F.size(F.array_intersect("su", "sv"))
    linked = both * 100 >= (F.size("su") + F.size("sv") - both) * percent
    asked = sets.join(pairs.select(F.col("v").alias("node")).distinct(), "node", "left_semi")
    right = _with_sets(pairs.select("u", "v"), asked, "v", "u", "sv")
    asked = sets.join(pairs.select(F.col("u").alias("node")).distinct(), "node", "left_semi")
    return _with_sets(right, asked, "u", "v", "su").where(linked).select("u", "v")


def _best(pairs: DataFrame, most: int) -> DataFrame:
    """The ``most`` likely pairs of each class; the others are left for later searches."""
    ends = pairs.select(F.col("u").alias("node"), "u", "v", "far").unionByName(pairs.select(F.col("v").alias("node"), "u", "v", "far"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("far", "u", "v"))
    return ends.withColumn("rank", rank).where(F.col("rank") <= most).select("u", "v").distinct()


def _links(regions: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``node, component, degree`` by verified links, which join all classes that links between classes
    of one region join."""
    tested = scratch.keep(_best(_neighbours(regions, percent), 2))
    links = scratch.keep(_verified(tested, sets, percent))
    hubs = _hubs(scratch.keep(_still_open(regions, _state(links))), percent)
    hubs = scratch.keep(_best(hubs.join(tested, ["u", "v"], "left_anti"), 2))
    tested = tested.unionByName(hubs)
    links = links.unionByName(scratch.keep(_verified(hubs, sets, percent)))
    state = components(links, scratch)
    # What neighbours and hubs were not tried is among these pairs, too.
    rest = _rest(scratch.keep(_still_open(regions, state.withColumn("degree", F.lit(0)))), sets, percent, scratch)
    rest = scratch.keep(rest.join(tested, ["u", "v"], "left_anti"))
    most, seams, merged = 4, None, None
    while not rest.isEmpty():
        best = scratch.keep(_best(rest, most))
        new = scratch.keep(_verified(best, sets, percent))
        rest, most, all_rest = rest.join(best, ["u", "v"], "left_anti"), most * 8, rest
        if not new.isEmpty():
            links = links.unionByName(new)
            seam = all_rest.join(new, ["u", "v"]).select(F.col("cu").alias("u"), F.col("cv").alias("v"))
            seams = scratch.keep((seam if seams is None else seams.unionByName(seam)).distinct())
            merged = components(seams, scratch)  # of components, few as they are
            rest = _apart(rest, merged)
        rest = scratch.keep(rest)
    if merged is not None:
        alone = merged.join(state.select("node"), "node", "left_anti")
        root = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
        state = state.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component")).unionByName(alone)
    ends = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node")))
    return state.join(ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "node")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept, class_size, n_links``.

    Texts are linked when their shingle sets have a Jaccard similarity of at least ``percent``
    hundredths; ``component_id`` is the smallest id that links reach, ``kept`` whether it is the
    row's own; ``n_links`` counts the verified links of its class that joined components."""
    scratch, first = Scratch(docs.sparkSession, "near", free=True), Scratch(docs.sparkSession, "near-sketches", free=True)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = first.keep(plain.mapInArrow(_sketches(width), _SKETCH).withColumn("node", F.monotonically_increasing_id()))
    key = ["h1", "h2", "n"]
    base = scratch.keep(sketches.select("doc_id", *key, "node"))
    classes = base.where("n > 0 and doc_id is not null").groupBy(*key)
    classes = scratch.keep(classes.agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("class_size"), F.min("node").alias("node")))
    regions = _regions(_first_rows(sketches, classes, first), first.keep)
    regions = scratch.keep(regions.join(classes.select("node", F.col("class_size").alias("copies")), "node"))
    first.clear()  # the values of all rows are the largest table, and regions hold what is left to compare
    # A repeated id may stand for several texts: only the one with the class's digest gives its set.
    asked = scratch.keep(regions.select("node").distinct().join(classes.select("node", "h1", F.col("first_id").alias("doc_id")), "node"))
    texts = sifted(plain, F.xxhash64("doc_id"), asked.select(F.xxhash64("doc_id"))).where("_hit").drop("_hit").join(asked, "doc_id").select("node", "text", "h1")
    sets = scratch.keep(texts.mapInArrow(_sets(width), "node long, shingles array<long>"))
    if sets.count() > asked.count():  # rows repeat both id and text
        sets = scratch.keep(sets.dropDuplicates(["node"]))
    joined = scratch.keep(_links(regions, sets, percent, scratch))
    top = classes.select("node", "first_id").join(joined, "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    top = joined.join(top, "component").select("node", "component_id", "degree")
    known = classes.select(*key, "node", "first_id", "class_size").join(top, "node", "left")
    known = known.select(*key, F.coalesce("component_id", "first_id").alias("_c"), "class_size", F.coalesce("degree", F.lit(0)).alias("n_links"))
    rows = base.select("doc_id", *key).withColumn("_alone", F.col("doc_id").isNull() | (F.col("n") == 0))
    linked = rows.where("not _alone").join(known, key).select("doc_id", "n", F.col("_c").alias("component_id"), "class_size", "n_links")
    alone = rows.where("_alone").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    found = linked.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_size", "n_links"
    )
    found = store(found, "near-groups")
    scratch.clear()
    return found


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all its columns as they are."""
    verdict = near_groups(docs, id_col, text_col, width, percent).where("doc_id is not null")
    gone = verdict.groupBy("doc_id").agg(F.max("kept").alias("any")).where("not any").select(F.col("doc_id").alias("gone"))
    gone = store(gone, "near-gone")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    # Texts whose id no verdict can concern take no part in the join.
    rows = sifted(rows, F.xxhash64("id"), gone.select(F.xxhash64("gone")))
    asked = rows.where("_hit").join(gone, F.col("id") == F.col("gone"), "left_anti")
    return rows.where("not _hit").select("row.*").unionByName(asked.select("row.*"))
