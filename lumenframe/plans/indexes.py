"""Indexes that several queries share, built when first asked for and kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lumenframe.operators.checkpoints import new_folder
from lumenframe.operators.textindex import TextIndex
from lumenframe.plans.views import table

_BUILT: dict[tuple, TextIndex] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """What changes when the files below ``path`` do."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime()


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def of_documents(spark: SparkSession, d: str) -> TextIndex:
    """The text index of ``documents``."""
    path = f"{d}/documents.parquet"
    key = (spark.sparkContext.applicationId, path, _state(spark, path))
    if key not in _BUILT or not all(_there(spark, f"{s}/stats") for s in _BUILT[key].segments):
        _BUILT[key] = TextIndex(spark, new_folder(spark, "text-index")).add(table(spark, d, "documents"), "doc_id", "text")
    return _BUILT[key]
