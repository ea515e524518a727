"""Documents to packed training bins, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept. All
but the last return the columns of ``documents``. ``run`` stores each stage's rows as Parquet in
the shared folder and rereads them, so a lost executor repeats a part of one stage at most.

Defined results: null texts have no words and fail the first stage; a null id, source or language
is carried; rows that repeat leave one row after exact dedup; an empty table gives no bins; extra
columns are carried up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm.common import store
from lumenframe.llm.exact_dedup import drop_copies
from lumenframe.llm.near_dedup import drop_near_copies
from lumenframe.llm.packing import pack_documents
from lumenframe.llm.pii import mask_personal
from lumenframe.llm.quality_rules import keep_passing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the threshold table rejects."""
    return keep_passing(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of equal texts."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: five words, a similarity of 0.8."""
    return drop_near_copies(docs, width=5, percent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return mask_personal(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents in bins; the pieces with their bins are the result."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("best_fit_packing", packed)]

#: The tagger and best fit have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
