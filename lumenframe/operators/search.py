"""Search by stages, and rankings of several engines merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.ranking import stem, tokens


def _any_prefix(beginning: Column):
    return lambda w: F.startswith(w, beginning)


def ladder(docs: DataFrame, text_col: str, terms: list[str], most: int = 12, prefix_from: int = 3) -> DataFrame:
    """Rows of the first stage that finds any, with ``tier``: 0 every term a whole word, 1 every
    term the beginning of a word by its stem, 2 any term so. Terms of fewer than ``prefix_from``
    letters stay whole words."""
    words = tokens(F.col(text_col))
    terms = list(dict.fromkeys(terms))[:most]
    whole = [F.array_contains(words, t) for t in terms]
    begun = [F.exists(words, _any_prefix(stem(F.lit(t)))) if len(t) >= prefix_from else w for t, w in zip(terms, whole)]
    every = lambda parts: reduce(lambda x, y: x & y, parts)
    tier = F.when(every(whole), 0).when(every(begun), 1).when(reduce(lambda x, y: x | y, begun), 2)
    found = docs.withColumn("tier", tier).where("tier is not null")
    return found.join(F.broadcast(found.agg(F.min("tier").alias("tier"))), "tier", "left_semi")


def merge_rankings(hits: DataFrame, key: str, engine: str, rank: str, k: int = 60) -> DataFrame:
    """``key, score, engines``: the sum of 1 / (k + rank) over all hits, and the engines in the
    order of their best ranks, joined by ``+``."""
    each = hits.groupBy(key, engine).agg(F.sum(1.0 / (k + F.col(rank))).alias("s"), F.min(rank).alias("first"))
    # One entry an engine, so the lists are as short as the list of engines.
    named = F.array_sort(F.collect_list(F.struct("first", F.col(engine).alias("name"))))
    return each.groupBy(key).agg(F.round(F.sum("s"), 6).alias("score"), F.array_join(F.transform(named, lambda x: x["name"]), "+").alias("engines"))
