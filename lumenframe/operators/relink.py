"""Records whose file is gone, matched one to one with files found elsewhere.

A record takes, of the files that records before it have left: one with its name and content, else one with
its size and content, else the only one with its name and size. Several of the latter are ambiguous: they are reported and
none is taken. Records choose in the order of their ids.

The order is not walked row by row. Every round lets each record choose among the files that no record before it holds
by the round before; rounds go on until nobody changes. The first record is right after one round, so
what is stable is what the order gives. Records that would choose alike begin with different files,
so copies do not wait for one another, and rounds are few.

No pairs are made. A record and a file meet under a key (name, size and content; size and content; name and size);
within a key files sorted by who holds them, the latest first, and records sorted among them by id tell by a running minimum
and a running count what is free for each record. So work grows with records and files, whatever they share.

Defined results: a null name, or a null hash, equals nothing; a null or zero size is unknown: its record is
matched by name, and by content only under its name; records and files that repeat an id or a path are
one; empty tables match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.checkpoints import stored

_FREE = (1 << 63) - 1


def _keys(*kinds: tuple[str, int, list[str]]) -> Column:
    """``key, tier`` of each kind whose fields are all there."""
    key = lambda kind, fields: F.struct(F.lit(kind).alias("kind"), *[F.col(c).cast(t).alias(c) if c in fields else F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("size", "long"), ("hash", "string"))])
    there = lambda fields: F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in (*fields, fields[0])]) == 0, True)
    found = F.array(*[F.when(there(fields), F.struct(key(kind, fields).alias("key"), F.lit(tier).alias("tier"))) for kind, tier, fields in kinds])
    return F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")


_KNOWN = [("all", 1, ["name", "size", "hash"]), ("content", 2, ["size", "hash"]), ("named", 3, ["name", "size"])]
_UNKNOWN = [("any size", 1, ["name", "hash"]), ("name", 3, ["name"])]


def _met(records: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``k, tier, id`` and ``k, kind, tier, file``: the keys that records and files share."""
    r = records.select("id", F.lower("name").alias("name"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), "hash").dropDuplicates(["id"])
    f = files.select("file", F.lower("name").alias("name"), F.col("size").cast("long").alias("size"), "hash").dropDuplicates(["file"])
    asked = r.where("size > 0").select("id", _keys(*_KNOWN)).unionByName(r.where("size <= 0").select("id", _keys(*_UNKNOWN)))
    asked, offered = stored(asked.select("id", "x.*"), "relink-asked"), stored(f.select("file", _keys(*_KNOWN, *_UNKNOWN)).select("file", "x.*"), "relink-offered")
    shared = stored(asked.select("key").distinct().join(offered.select("key").distinct(), "key").withColumn("k", F.monotonically_increasing_id()), "relink-keys")
    return stored(asked.join(shared, "key").select("k", "tier", "id"), "relink-asked"), stored(offered.join(shared, "key").select("k", "key.kind", "tier", "file"), "relink-offered")


def _first(asked: DataFrame, offered: DataFrame) -> DataFrame:
    """``id, file``: within a key the nth record begins with the nth file; who finds none begins so by content."""
    nth = lambda df, c: df.withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy(c)))
    meet = lambda a, o: nth(a, "id").join(nth(o, "file"), ["k", "nth"]).select("id", "file")
    one = stored(meet(asked.where("tier = 1"), offered.where("tier = 1").select("k", "file")), "relink-choice")
    two = meet(asked.where("tier = 2").join(one, "id", "left_anti"), offered.where("tier = 2").select("k", "file").join(one, "file", "left_anti"))
    return one.unionByName(two)


def _free(asked: DataFrame, offered: DataFrame, choice: DataFrame) -> DataFrame:
    """``k, tier, id, n, least``: how many files of a key no record before ``id`` holds, and the first of them."""
    holders = choice.where("file is not null").groupBy("file").agg(F.min("id").alias("holder"))
    files = offered.join(holders, "file", "left").select("k", F.lit(None).cast("int").alias("tier"), F.coalesce("holder", F.lit(_FREE)).alias("at"), "file")
    rows = files.unionByName(asked.select("k", "tier", F.col("id").alias("at"), F.lit(None).cast("string").alias("file")))
    # The file that a record holds itself is free for it: files come before the record.
    before = Window.partitionBy("k").orderBy(F.col("at").desc(), F.col("file").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("k", "tier", "at", F.count("file").over(before).alias("n"), F.min("file").over(before).alias("least"))
    return rows.where("tier is not null").withColumnRenamed("at", "id")


def relink_classes(records: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``records`` (``id, name, size, hash``) and ``files`` (``file, name, size, hash``) -> ``id, file, tier, doubt, n_doubt``: the
    file of each record that gets one, with the tier (1 to 3), and, for a record in doubt, the class of files of its name
    and size (of its name, if its size is unknown), called by that and its first file, and how many of them are free at its turn; and ``doubt, file, holder``: the members of those
    classes and who took them. Free at a record's turn is what nobody, or only a record after it, took."""
    asked, offered = _met(records, files)
    choice, before = stored(_first(asked, offered), "relink-choice"), None
    while True:
        best = F.min(F.when((F.col("tier") < 3) & (F.col("n") > 0), F.struct("tier", F.col("least").alias("file"))))
        alone = F.min(F.when((F.col("tier") == 3) & (F.col("n") == 1), F.struct("tier", F.col("least").alias("file"))))
        doubt = F.min(F.when((F.col("tier") == 3) & (F.col("n") > 1), F.struct("k", "n")))
        chosen = _free(asked, offered, choice).groupBy("id").agg(best.alias("best"), alone.alias("alone"), doubt.alias("doubt"))
        chosen = chosen.select("id", F.coalesce("best", "alone").alias("x"), F.when(F.col("best").isNull(), F.col("doubt")).alias("doubt"))
        last, choice = choice, stored(chosen.select("id", "x.file", "x.tier", F.col("doubt.k").alias("k"), F.col("doubt.n").alias("n_doubt")), "relink-choice")
        sign = choice.agg(F.count("file"), F.sum(F.xxhash64("id", "file").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    holders = last.where("file is not null").groupBy("file").agg(F.min("id").alias("holder"))
    classes = offered.join(choice.where("k is not null").select("k").distinct(), "k", "left_semi")
    named = classes.groupBy("k", "kind").agg(F.min("file").alias("doubt")).select("k", F.concat_ws(":", "kind", "doubt").alias("doubt"))
    members = classes.join(named, "k").join(holders, "file", "left").select("doubt", "file", "holder")
    found = choice.where("file is not null or k is not null").join(named, "k", "left").select("id", "file", "tier", "doubt", "n_doubt")
    return found, members


def relink(records: DataFrame, files: DataFrame) -> DataFrame:
    """``id, file, tier, ambiguous``: what ``relink_classes`` finds, with the files among which a record is in doubt
    listed for each record. Records of one name and size have as many lists as there are of them."""
    found, members = relink_classes(records, files)
    free = (F.col("d.doubt") == F.col("m.doubt")) & (F.col("m.holder").isNull() | (F.col("m.holder") >= F.col("d.id")))
    lists = found.where("doubt is not null").alias("d").join(members.alias("m"), free).groupBy("d.id").agg(F.sort_array(F.collect_list("m.file")).alias("ambiguous"))
    return found.join(lists, "id", "left").select("id", "file", "tier", "ambiguous")
