"""Queries of named entities. The entities are benchmark items: their first words are the English
name, the next the other language's, and two more an alias."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import entities
from lumenframe.plans.registry import query
from lumenframe.plans.views import table

KINDS = ["title", "place", "thing"]


def entity_table(spark: SparkSession, d: str) -> DataFrame:
    w = F.split(F.regexp_replace("text", "[^\\p{L} ]", ""), " +")
    words = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("item_id") % 3 + 1).cast("int"))
    return table(spark, d, "benchmark").select(
        kind.alias("kind"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("id"), words(1, 3).alias("en"), words(4, 3).alias("es"), F.array(words(7, 2)).alias("aliases")
    )


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Names whole, begun, turned round and misspelt, and the first words of every document."""
    e = entity_table(spark, d)
    w = F.split("en", " ")
    miss = F.concat(F.substring("en", 1, 2), F.substring("en", F.lit(4), F.length("en")))
    forms = F.array("es", miss, F.substring("en", 1, 6), F.array_join(F.reverse(w), " "), F.element_at("aliases", 1))
    docs = table(spark, d, "documents").select(F.array_join(F.slice(F.split("text", "\\s+", 4), 1, 3), " ").alias("query"))
    return e.select(F.explode(forms).alias("query")).union(docs).where("query is not null").distinct()


def index(spark: SparkSession, d: str) -> entities.EntityIndex:
    return entities.EntityIndex.build(entity_table(spark, d), KINDS)


@query("R14_entity_lookup")
def lookup(spark, d):
    """The five best entities of every query, by equal, begun, worded and like names."""
    return entities.lookup(asked(spark, d), index(spark, d))


@query("R15_annotate")
def annotate(spark, d):
    """Entities named in every document."""
    found = entities.mentions(table(spark, d, "documents"), index(spark, d), "doc_id", "text")
    return found.select("doc_id", "start", "end", "key", F.transform("matches", lambda m: m["id"]).alias("ids"), "ambiguous")


@query("R15_expand")
def expand(spark, d):
    """Every query with the other language's names in it."""
    both = entity_table(spark, d).select(F.concat("en", F.lit(" near "), "es").alias("query"))
    return entities.expand(asked(spark, d).union(both), index(spark, d))


@query("R15_translate")
def translated(spark, d):
    return entities.translate(asked(spark, d), index(spark, d))
