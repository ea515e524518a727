"""Small helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts, for Java's and Python's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a
    new temporary folder takes its place on one machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = found or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='lumenframe-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, with its lineage cut; lost executors cost no
    recomputation. The files go with the folder, or with Spark's cleaner where it is set to."""
    spark = df.sparkSession
    shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def store(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: as ``cut``, but compressed."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job, below one folder of the shared ones, which is given back as a whole. With ``free``
    the shuffle files of a table go as soon as it is written, not when the driver collects its garbage."""

    FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, what: str, free: bool = False):
        self.spark, self.root, self.n, self.free = spark, new_dir(spark, what), 0, free

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read back, with its lineage cut."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(self.FREE, "false")
        self.spark.conf.set(self.FREE, str(self.free or before == "true").lower())
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(self.FREE, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Deletes all of its tables; nothing may read them any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sifted(rows: DataFrame, hashed: Column, keys: DataFrame) -> DataFrame:
    """``rows`` with ``_hit``: false only where ``hashed`` is not among ``keys``, a column of 64-bit
    hashes. The keys set bits of 2048 bitmaps of 4 KB, which are broadcast: their size never grows, and
    many keys let more rows through."""
    place = lambda c: F.pmod(c, F.lit(1 << 26))
    found = keys.toDF("_key").select(place(F.col("_key")).alias("_at"))
    bits = found.groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bitmap"))
    byte = "conv(hex(substring(_bitmap, cast(bitmap_bit_position(_at) div 8 as int) + 1, 1)), 16, 10)"
    hit = F.coalesce(F.expr(f"getbit(cast({byte} as bigint), cast(bitmap_bit_position(_at) % 8 as int))") == 1, F.lit(False))
    joined = rows.withColumn("_at", place(hashed)).join(F.broadcast(bits), F.bitmap_bucket_number("_at") == F.col("_bucket"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], hit.alias("_hit"))


def blocks(docs: DataFrame, rows: int = 2048) -> DataFrame:
    """``docs`` with ``block``: a number for each run of so many rows of a scanned partition. Two
    reads of one table give the same numbers; other inputs need a stored copy first."""
    return docs.withColumn("block", F.shiftright(F.monotonically_increasing_id(), rows.bit_length() - 1))


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices with about ``most`` bytes of texts in a column, so that what a task makes of
    texts follows no batch's size. No row is cut."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
        for lo, hi in zip([0, *ends], [*ends, len(batch)]):
            yield batch.slice(lo, hi - lo)


def whole(text: Column) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than white space; an array, empty for no words."""
    return F.array_remove(F.split(whole(text), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)
