"""Exact de-duplication with a heavy-hitter split.

A digest of the normalised text stands for each row. Misra-Gries counters (Spark's
``freqItems``) name at most ``1 / support`` digests that may be frequent; one exact count
verifies them. Their winners are broadcast, so rows of frequent texts get their verdict on the
map side and never meet in one task. The remaining digests hold at most a share ``support`` of
the rows each and take an ordinary shuffle.

Defined results: a null text is an empty one; rows with a null id lose to rows with an id; of
rows that repeat both id and text, one is kept; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import SPACE, cut, sifted, store, whole

#: Digests with more than this share of the rows are split off; 1 / SUPPORT bounds the broadcast.
SUPPORT = 0.001


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text with each run of white space made one space."""
    return F.sha2(F.regexp_replace(whole(text), SPACE, " ").cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            text_digest(F.col(text_col)).alias("text_sha256"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    stats = [F.min(order).alias("_first"), F.count(F.lit(1)).alias("group_size")]

    candidates = rows.select("text_sha256").stat.freqItems(["text_sha256"], support)
    candidates = candidates.select(F.explode(F.col("text_sha256_freqItems")).alias("text_sha256"))
    heavy = rows.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(*stats)
    heavy = cut(heavy.where("group_size > 1"))

    decided = rows.join(F.broadcast(heavy), "text_sha256")
    rest = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    rest = rest.join(rest.groupBy("text_sha256").agg(*stats), "text_sha256")
    return decided.unionByName(rest).select(
        "doc_id",
        F.col("_first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_first._row")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns as they are."""
    found = exact_dedup(docs, id_col, text_col, support).where("group_size > 1")
    # Rows are told apart by id and digest; one that stays may have repeats of both.
    marks = found.groupBy(F.col("doc_id").alias("m_id"), F.col("text_sha256").alias("m_sha")).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    marks = store(marks.where("not stays or n > 1").select("m_id", "m_sha", "stays"), "exact-marks")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("sha"))
    rows = sifted(rows, F.xxhash64("id", "sha"), marks.select(F.xxhash64("m_id", "m_sha")))
    # Texts that no mark can concern take no part in the join.
    asked = rows.where("_hit").join(marks, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("sha") == F.col("m_sha")), "left")
    asked = asked.where(F.coalesce("stays", F.lit(True))).dropDuplicates(["id", "sha"])
    return rows.where("not _hit").select("row.*").unionByName(asked.select("row.*"))
