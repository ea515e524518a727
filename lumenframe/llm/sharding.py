"""Size-tiered compaction of shards under a versioned manifest.

Arrivals are appended as small immutable Parquet shards. Runs are tiered by the logarithm of
their size; where a tier holds ``FAN`` runs or more, neighbouring runs are merged into files of
about the target size. The merges of all tiers are Spark jobs of at most ``WAVE`` files each: every run
is looked up in the plan, a table of runs, and rows are dealt to their merged run, one task and one
file for each. Every step writes new files only and then commits a manifest: a new version, written
beside the others under a temporary name and renamed into place, which fails if that version exists
(the file system's rename must not replace files, as HDFS's does not). A reader takes the files of
the newest version, or of any it asks for, so it sees a step whole or not at all, and a failed job
leaves the last version as it was. Old versions keep their data until ``expire`` is called.

Rows are stored as one struct beside the number of their run, so no column name can clash.

Defined results: null texts count as 0 bytes and are kept; null ids arrive as any others; rows
that repeat are kept as often; an empty table gives a manifest without runs; extra columns travel
along, whatever their names, but for ``_run``, which names the run in what is read, and is refused.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import cut, new_dir, store

#: Rows of an arriving shard (a power of two); bytes of text in a merged file; runs that make a
#: tier worth merging; merged files of one job.
ARRIVAL, TARGET, FAN, WAVE = 512, 64 << 20, 4, 10_000
#: The run of a row, in what is read.
RUN = "_run"


class Table:
    """A sharded table below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{root}/manifest"))

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max(self.versions(), default=0)

    def versions(self) -> list[int]:
        """All committed versions that are not expired, in order."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """``{"version", "parts": folders of data, "runs": folder of the run table}``."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "parts": [], "runs": None}
        text = self.spark.read.text(f"{self.root}/manifest/v{version:09d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def commit(self, parts: list[str], runs: str, version: int) -> None:
        """Makes ``version`` visible, or fails if another writer made it first."""
        temporary = self._path(f"{self.root}/manifest/_{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(json.dumps({"version": version, "parts": parts, "runs": runs}).encode()))
        stream.close()
        target = self._path(f"{self.root}/manifest/v{version:09d}.json")
        if self._fs.exists(target) or not self._fs.rename(temporary, target):
            self._fs.delete(temporary, False)
            raise RuntimeError(f"version {version} was committed by another writer")

    def expire(self, older_than: int) -> list[str]:
        """Forgets the versions before ``older_than`` and deletes the folders that only they name."""
        old = [self.manifest(v) for v in self.versions() if v < min(older_than, self.version())]
        live = {p for v in self.versions() if v >= older_than or v == self.version() for p in [*self.manifest(v)["parts"], self.manifest(v)["runs"]]}
        gone = sorted({p for m in old for p in [*m["parts"], m["runs"]]} - live)
        for m in old:
            self._fs.delete(self._path(f"{self.root}/manifest/v{m['version']:09d}.json"), False)
        for p in gone:
            self._fs.delete(self._path(p), True)
        return gone

    def runs(self, version: int | None = None) -> DataFrame:
        """``run, part, tier, n_rows, n_bytes``: live runs and the folder that holds each."""
        return self.spark.read.parquet(self.manifest(version)["runs"])

    def stored(self, version: int | None = None) -> DataFrame:
        """``run, row``: the live rows as structs. Folders of which all runs are live are read as they are."""
        found, runs = self.manifest(version), self.runs(version)
        held = {r["part"]: r["n"] for r in runs.groupBy("part").agg(F.sum("n_rows").alias("n")).collect()}  # one row for each folder
        parts = []
        for p in found["parts"]:
            part = self.spark.read.parquet(p)
            if part.count() != held.get(p, 0):
                part = part.join(runs.where(F.col("part") == p).select("run"), "run", "left_semi")
            parts.append(part)
        return reduce(DataFrame.unionByName, parts)

    def rows(self, version: int | None = None) -> DataFrame:
        """The live rows, with their run."""
        return self.stored(version).select("row.*", F.col("run").alias(RUN))


def _tier(n_bytes: Column) -> Column:
    """Runs within a factor of 4 share a tier."""
    return F.greatest(F.floor(F.log2(F.greatest(n_bytes, F.lit(1)) / F.lit(1024.0)) / 2), F.lit(0)).cast("long")


def _write(table: Table, rows: DataFrame, text_col: str, per_file: int = 0) -> tuple[str, DataFrame]:
    """Writes ``run, row``, at most ``per_file`` rows to a file, and returns the folder and its
    run table."""
    part = f"{table.root}/data/{uuid.uuid4().hex}"
    rows.write.option("maxRecordsPerFile", per_file).option("compression", "zstd").parquet(part)
    size = F.coalesce(F.octet_length(F.col("row")[text_col]), F.lit(0)).cast("long")
    runs = table.spark.read.parquet(part).groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("n_bytes"))
    return part, runs.select("run", F.lit(part).alias("part"), _tier(F.col("n_bytes")).alias("tier"), "n_rows", "n_bytes")


def append(table: Table, rows: DataFrame, text_col: str = "text", arrival: int = ARRIVAL) -> None:
    """Appends rows as they arrive, without a shuffle, in shards of ``arrival`` rows: each file
    that a task writes is one run. Then commits."""
    if RUN in rows.columns:
        raise ValueError(f"{RUN} names the run in what is read")
    before = table.manifest()
    first = 0
    if before["runs"]:
        first = (table.runs().agg(F.max("run")).first()[0] or 0) + 1
    run = F.shiftright(F.monotonically_increasing_id(), arrival.bit_length() - 1) + first
    part, runs = _write(table, rows.select(run.alias("run"), F.struct("*").alias("row")), text_col, arrival)
    all_runs = runs if not before["runs"] else table.runs().unionByName(runs)
    _commit(table, all_runs, [*before["parts"], part], before["version"] + 1)


def _commit(table: Table, runs: DataFrame, parts: list[str], version: int) -> None:
    path = f"{table.root}/runs/{uuid.uuid4().hex}"
    runs.write.parquet(path)
    live = {r["part"] for r in table.spark.read.parquet(path).select("part").distinct().collect()}  # one row for each folder
    table.commit([p for p in parts if p in live], path, version)


def plan(runs: DataFrame, target: int = TARGET, fan: int = FAN) -> DataFrame:
    """``run, into``: the runs to merge and the merge that each goes to, named by its first run.
    Runs of a tier merge in the order of their number, as many as reach the target; runs of the
    target size or more stay. Runs are ranked within their tier, whatever partition or arrival they
    came from; sums run over slices of a thousand ranks, so no task holds a tier."""
    small = runs.where(F.col("n_bytes") < target)
    full = small.groupBy("tier").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= fan).select("tier")
    small = small.join(F.broadcast(full), "tier").select("run", "tier", "n_bytes")
    small = cut(small.repartitionByRange("tier", "run").sortWithinPartitions("tier", "run").withColumn("_id", F.monotonically_increasing_id()))
    # One row for each partition; a row's rank is its place in the partition and what lies before.
    small = small.withColumn("_part", F.shiftright("_id", 33))
    sizes = small.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = small.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    small = small.withColumn("_rank", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    first = small.groupBy("tier").agg(F.min("_rank").alias("_first"))
    small = small.join(F.broadcast(first), "tier").withColumn("_slice", F.floor((F.col("_rank") - F.col("_first")) / 1000))
    order = Window.partitionBy("tier", "_slice").orderBy("run")
    ahead = F.coalesce(F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = small.withColumn("_bin", F.floor(ahead / target))
    return small.withColumn("into", F.min("run").over(Window.partitionBy("tier", "_slice", "_bin"))).select("run", "into")


def compact(table: Table, text_col: str = "text", target: int = TARGET, fan: int = FAN, wave: int = WAVE) -> bool:
    """Merges similarly sized runs into at most ``wave`` files and commits; whether there was
    anything to merge. What a wave leaves, the next one takes."""
    before = table.manifest()
    if not before["runs"]:
        return False
    runs = table.runs()
    # A merged file may fall short of the target by less than one of its runs; half the target is enough to stay.
    merges = store(plan(runs.where(F.col("n_bytes") < target // 2), target, fan), "shard-plan")
    shared = merges.groupBy("into").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").orderBy("into").limit(wave).select("into")
    shared = store(shared.withColumn("task", (F.row_number().over(Window.orderBy("into")) - 1).cast("int")), "shard-wave")  # at most ``wave`` rows
    n = shared.count()
    if not n:
        return False
    # A table of known size: small plans are broadcast, and larger ones shuffled.
    merges = store(merges.join(F.broadcast(shared), "into"), "shard-merges")
    top = runs.agg(F.max("run")).first()[0] + 1
    moved = table.stored().join(merges, "run").select((F.col("into") + top).alias("run"), "row", "task")
    part, merged = _write(table, moved.repartitionById(n, "task").select("run", "row"), text_col)
    kept = runs.join(merges.select("run"), "run", "left_anti").select(*merged.columns)
    _commit(table, kept.unionByName(merged), [*before["parts"], part], before["version"] + 1)
    return True


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrivals: int = 2) -> Table:
    """Appends ``docs`` in ``arrivals`` batches by a hash of the id, each followed by compaction
    until nothing is left to merge."""
    table = Table(docs.sparkSession, new_dir(docs.sparkSession, "shards"))
    for k in range(arrivals):
        append(table, docs.where(F.pmod(F.xxhash64(id_col), F.lit(arrivals)) == k), text_col)
        while compact(table, text_col):
            pass
    return table
