"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

A document longer than a bin is cut into full bins and a rest. Pieces are dealt to packing groups
by a hash, so that a group stays bounded however the input grows and whatever its sources weigh.
Within a group, pieces are placed in descending length. Open bins are ordered by residual and
carry bitmaps of the sources and duplicate clusters they hold; from the tightest bin that the
piece fits in, the search goes on to the successor until a bin without the piece's source and
cluster is found, and opens a new bin only if there is none. Full bins leave the order.

Defined results: a null length counts as 0, and a piece of length 0 is placed as any other;
null sources or clusters conflict with nothing; rows that repeat are cut and placed one by one; a
null id is carried; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import store, words
from lumenframe.llm.exact_dedup import text_digest

#: Tokens of a bin, and rows that a packing group has on average.
CAPACITY, GROUP = 2048, 4096
SCHEMA = "bin_id long, doc_id long, piece long, start long, length long, source string, cluster long, bin_fill long, bin_pieces long"


def pack(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each piece, for pieces in the order of placing; -1 stands for no source or cluster."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    held_sources: list[int] = []
    held_clusters: list[int] = []
    where = []
    for n, source, cluster in zip(lengths, sources, clusters):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(order, (n, -1))
        while at < len(order) and (held_sources[order[at][1]] & s or held_clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[b] |= s
        held_clusters[b] |= c
        if left > n:
            insort(order, (left - n, b))
        where.append(b)
    return where


def _pack_group(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        codes = lambda c: pd.factorize(c)[0].tolist()  # noqa: E731  nulls get -1
        bins = np.array(pack(rows["length"].tolist(), codes(rows["source"]), codes(rows["cluster"]), capacity), np.int64)
        rows = rows.assign(bin_id=(int(key[0]) << 32) + bins)
        by = rows.groupby("bin_id")["length"]
        rows = rows.assign(bin_fill=by.transform("sum"), bin_pieces=by.transform("size"))
        return rows[["bin_id", "doc_id", "piece", "start", "length", "source", "cluster", "bin_fill", "bin_pieces"]]

    return run


def best_fit(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``doc_id, length, source, cluster`` -> one row per piece, with its bin. Ids of bins are
    unique over all groups; ``bin_fill`` and ``bin_pieces`` are those of the bin."""
    rows = items.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("length"), F.lit(0)).cast("long").alias("length"), F.col("source").cast("string").alias("source"),
        F.col("cluster").cast("long").alias("cluster"), F.monotonically_increasing_id().alias("row"),
    )
    rows = store(rows, "packing-items")
    n = rows.agg(F.count(F.lit(1)), F.sum(F.ceil(F.greatest("length", F.lit(1)) / capacity))).first()
    groups = max(1, -(-int(n[1] or 0) // group))
    last = F.greatest(F.ceil(F.col("length") / capacity).cast("long") - 1, F.lit(0))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("start", F.col("piece") * capacity)
    rows = rows.withColumn("length", F.least(F.col("length") - F.col("start"), F.lit(capacity)).cast("long"))
    # The pieces of one document are dealt out too, so a very long one fills no group.
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("long"))
    return dealt.groupBy("group").applyInPandas(_pack_group(capacity), SCHEMA)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Packs whole texts. A text's length is its number of words and one end. ``cluster`` names
    groups of duplicates; by default texts that are equal but for white space."""
    own = F.conv(F.substring(text_digest(F.col(text_col)), 1, 15), 16, 10).cast("long")
    items = docs.select(
        F.col(id_col).alias("doc_id"), (F.size(words(F.col(text_col))) + 1).alias("length"), F.col(source_col).alias("source"), (own if cluster is None else cluster).alias("cluster")
    )
    return best_fit(items, capacity, group)
