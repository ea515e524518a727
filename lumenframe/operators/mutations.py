"""Changes of a catalog as pure transforms: each takes tables and returns the next version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def good_prefix(log: DataFrame, key: str, seq: str, crc: str, payload: str) -> DataFrame:
    """Records up to the first of each log whose checksum is wrong."""
    bad = F.when(F.crc32(payload) != F.col(crc), F.col(seq))
    first = F.min(bad).over(Window.partitionBy(key))
    return log.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(seq) < F.col("_first"))).drop("_first")


def replay(base: DataFrame, log: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """``base`` after ``log`` (id, seq, field, value): the last write of each field wins. Field
    types are given by name; a value of null clears the field."""
    last = [F.max(F.when(F.col("field") == f, F.struct("seq", "value"))).alias(f"_{f}") for f in fields]
    latest = log.groupBy(id_col).agg(*last)
    rows = base.join(latest, id_col, "left")
    for f, kind in fields.items():
        rows = rows.withColumn(f, F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value").cast(kind)).otherwise(F.col(f)))
    return rows.drop(*[f"_{f}" for f in fields])


def inverse(base: DataFrame, log: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """The log that takes the replayed table back to ``base``."""
    touched = log.where(F.col("field").isin(fields)).select(id_col, "field").distinct()
    old = base.select(id_col, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("o"))
    old = old.select(id_col, "o.field", "o.value")
    return touched.join(old, [id_col, "field"]).withColumn("seq", F.lit(0).cast("long"))


def keep_last(history: DataFrame, key: str, seq: str, most: int) -> DataFrame:
    """The last ``most`` entries of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.col(seq).desc()))
    return history.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def delete_everywhere(gone: DataFrame, tables: dict[str, DataFrame], id_col: str) -> dict[str, DataFrame]:
    """Each table without the rows of deleted ids."""
    return {n: t.join(gone.select(id_col), id_col, "left_anti") for n, t in tables.items()}


def advance_cursors(cursors: DataFrame, reads: DataFrame, key: str, at: str) -> DataFrame:
    """Read cursors only move on."""
    return cursors.unionByName(reads).groupBy(key).agg(F.max(at).alias(at))


def guarded_update(rows: DataFrame, changes: DataFrame, id_col: str) -> DataFrame:
    """``rows`` (id, revision, value) after ``changes`` (id, expected, value): a change counts only
    if it expects the present revision."""
    c = changes.select(id_col, "expected", F.col("value").alias("_value"))
    hit = F.col("expected") == F.col("revision")
    rows = rows.join(c, id_col, "left")
    return rows.select(id_col, F.when(hit, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), F.when(hit, F.col("_value")).otherwise(F.col("value")).alias("value"), F.coalesce(hit, F.lit(False)).alias("changed"))


def group_stacks(members: DataFrame, asked: DataFrame) -> DataFrame:
    """``id, stack, place`` after grouping. ``members``: ``id, stack, pos``; ``asked``: ``id, into, pos``,
    where ``into`` names the new stack and a stack is touched by one of them at most. The asked records come
    first, then the others of the stacks they were in; a stack of one record is none."""
    touched = asked.select("id", "into").join(members.select("id", "stack"), "id").select("into", "stack").distinct()
    rest = members.join(touched, "stack").join(asked.select("id"), "id", "left_anti")
    kept = members.join(touched.select("stack"), "stack", "left_anti").join(asked.select("id"), "id", "left_anti")
    rows = asked.select("id", F.col("into").alias("stack"), F.lit(0).alias("_later"), "pos")
    rows = rows.union(rest.select("id", "into", F.lit(1), "pos")).union(kept.select("id", "stack", F.lit(1), "pos"))
    own = Window.partitionBy("stack")
    placed = rows.withColumn("place", F.row_number().over(own.orderBy("_later", "pos", "id"))).withColumn("_n", F.count(F.lit(1)).over(own))
    return placed.where("_n >= 2").select("id", "stack", "place")


def with_undone(journal: DataFrame) -> DataFrame:
    """``id, undone`` of the writes of a journal (``id, kind, ok, undoes``): whether an undo that succeeded names them."""
    named = journal.where((F.col("kind") == "undo") & F.col("ok") & F.col("undoes").isNotNull()).select(F.col("undoes").alias("id")).distinct().withColumn("undone", F.lit(True))
    return journal.where("kind = 'write'").select("id").join(named, "id", "left").withColumn("undone", F.coalesce("undone", F.lit(False)))


def retention(local: DataFrame, browsed: DataFrame, references: list[DataFrame], now: str, days: int) -> DataFrame:
    """``id, verdict`` of browsed records (``id, folder, touched``): ``recent`` if their folder was visited (``browsed``:
    ``folder, at``) less than ``days`` ago or never noted, ``in use`` if a row of ``references`` (``id``) or no folder holds
    them, ``touched`` if changed, else ``evict``. No days, or times that cannot be read, evict nothing."""
    used = reduce(DataFrame.unionByName, references).where("id is not null").distinct().withColumn("_used", F.lit(True))
    age = F.unix_timestamp(F.try_to_timestamp(F.lit(now))) - F.unix_timestamp(F.try_to_timestamp("at"))
    old = F.coalesce(F.lit(days > 0) & (age >= days * 86400), F.lit(False))
    rows = local.join(browsed, "folder", "left").join(used, "id", "left")
    verdict = F.when(F.col("folder").isNull(), "in use").when(~old, "recent").when(F.col("_used"), "in use").when(F.coalesce("touched", F.lit(False)), "touched").otherwise("evict")
    return rows.select("id", verdict.alias("verdict"))
