"""Structured Streaming over events and changing pages, and the same logic in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type, for a stream with a watermark or for a table."""
    found = events.withWatermark("ts", late) if events.isStreaming else events
    return found.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events at most ``gap`` apart."""
    found = events.withWatermark("ts", late) if events.isStreaming else events
    return found.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, id_col: str, late: str = "10 minutes") -> DataFrame:
    """Each id once; a stream forgets ids behind its watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([id_col])
    return events.dropDuplicates([id_col])


def changes(pages: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """Versions whose content differs from the one before; the first is the baseline and reports
    nothing."""
    w = Window.partitionBy(key).orderBy(order)
    rows = pages.withColumn("_hash", F.sha2(content, 256)).withColumn("_before", F.lag("_hash").over(w))
    return rows.where(F.col("_before").isNotNull() & (F.col("_before") != F.col("_hash"))).drop("_hash", "_before")


def watched(pages: DataFrame, key: str, content: str) -> DataFrame:
    """``changes`` for a stream: the state of a page is the digest of its last content."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import hashlib

        last, found = (state.get[0] if state.exists else None), []
        for rows in batches:
            for text in rows[content]:
                digest = hashlib.sha256((text or "").encode()).hexdigest()
                if last is not None and digest != last:
                    found.append(text)
                last = digest
        state.update((last,))
        if found:
            yield pd.DataFrame({key: [k[0]] * len(found), content: found})

    schema = f"{key} long, {content} string"
    return pages.groupBy(key).applyInPandasWithState(run, schema, "digest string", "append", "NoTimeout")


def apply_batches(stream: DataFrame, target: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Keeps the latest row of each key in versioned Parquet folders below ``target``. Each batch
    reads the last version and writes the next, so a repeated batch gives the same folder."""

    def step(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        merged = rows
        if number:
            merged = merged.unionByName(spark.read.schema(rows.schema).parquet(f"{target}/v{number - 1}"))
        latest = merged.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns]), order).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{target}/v{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_files(spark: SparkSession, folder: str, schema: str, per_batch: int = 1) -> DataFrame:
    """A file stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
