"""A stored inverted index: positional postings of word stems, in sorted files that a search reads by stem.

A segment holds a row for each stem and block of documents, or several for a block of long ones: who has it, how often, in which
forms and where, and the greatest frequency and least length among them. Blocks are the same documents for
every stem, by a hash of the id, about ``BLOCK`` of them, so a frequent stem is many rows. Files are ranges
of stems; a list of their first and last stems tells a search which to open, and Parquet's own
statistics which parts of them. New documents make a new segment; an id that is added again hides its
earlier entries, which stay untouched.

The best ``k`` are found early: frequency and length bound the score of a block's documents. The
blocks with the highest bounds are scored first; their ``k``-th score ends the search for all blocks
that cannot reach it. No block with a chance is left out, so the result is that of scoring all.

Defined results: null and empty texts have no postings and count for no average; ids must be
unique within one batch, and a null id is an id; equal scores are ordered by id; an empty index finds
nothing; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.checkpoints import stored
from lumenframe.operators.ranking import plain_stem, stem, tokens

BLOCK = 1024
#: Words of text for each file of a segment, about.
FILE_WORDS = 5_000_000
#: Documents of a task that groups words; words that it groups at a time, about.
TASK, _SLICE = 16 * BLOCK, 1 << 20
K1, B = 1.2, 0.75


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _less(n: int):
    return lambda place: place - n


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, id, w``, ordered by block -> rows of postings, each of some documents of one block, and rows without a stem
    that tell the documents' lengths. Words are grouped where their documents stand, so that only groups are shuffled."""
    for batch in batches:
        blocks, words, first = batch.column(0).to_numpy(), batch.column(2), 0
        ends = words.offsets.to_numpy()
        while first < len(batch):
            same, few = np.searchsorted(blocks, blocks[first], "right"), np.searchsorted(ends, ends[first] + _SLICE, "right") - 1
            last = max(first + 1, int(min(same, few)))
            flat = words.values.slice(ends[first], ends[last] - ends[first])
            yield from _grouped(int(blocks[first]), batch.column(1).slice(first, last - first), flat, np.diff(ends[first : last + 1]))
            first = last


def _starts(changes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, changes))


def _lists(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _grouped(block: int, ids: pa.Array, words: pa.Array, dl: np.ndarray) -> Iterator[pa.RecordBatch]:
    shape = ["id", "dl", "tf", "forms"]
    names = ["term", "block", "n", "max_tf", "min_dl", "docs"]
    none = pa.nulls(len(ids), pa.list_(pa.struct([("word", pa.string()), ("at", pa.list_(pa.int32()))])))
    lengths = pa.StructArray.from_arrays([ids, pa.array(dl, pa.int32()), pa.nulls(len(ids), pa.int32()), none], shape)
    null = pa.nulls(1, pa.int32())
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([block], pa.int32()), pa.nulls(1, pa.int64()), null, null, _lists(np.array([0]), lengths)], names)
    if not len(words):
        return
    coded = words.dictionary_encode()
    stems = pa.array([plain_stem(w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
    word = coded.indices.to_numpy()
    term = stems.indices.to_numpy()[word]
    doc = np.repeat(np.arange(len(dl)), dl)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(dl) - dl, dl)
    order = np.lexsort((word, doc, term))  # keeps the order of equal ones
    doc, term, word, at = doc[order], term[order], word[order], at[order]
    other_term = term[1:] != term[:-1]
    other_doc = other_term | (doc[1:] != doc[:-1])
    rows, entries, forms = _starts(other_term), _starts(other_doc), _starts(other_doc | (word[1:] != word[:-1]))
    each = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(word[forms])), _lists(forms, pa.array(at, pa.int32()))], ["word", "at"])
    tf, own = np.diff(np.append(entries, len(doc))), doc[entries]
    found = pa.StructArray.from_arrays([ids.take(pa.array(own)), pa.array(dl[own], pa.int32()), pa.array(tf, pa.int32()), _lists(np.searchsorted(forms, entries), each)], shape)
    held = np.searchsorted(entries, rows)
    counts = np.diff(np.append(held, len(entries)))
    most, least = np.maximum.reduceat(tf, held), np.minimum.reduceat(dl[own], held)
    columns = [stems.dictionary.take(pa.array(term[rows])), pa.array(np.full(len(rows), block), pa.int32()), pa.array(counts, pa.int64()), pa.array(most, pa.int32()), pa.array(least, pa.int32()), _lists(held, found)]
    yield pa.RecordBatch.from_arrays(columns, names)


class TextIndex:
    """The segments of an index, oldest first, each a folder."""

    def __init__(self, spark: SparkSession, folder: str, segments: list[str] | None = None):
        self.spark, self.folder, self.segments = spark, folder, segments or []

    def add(self, docs: DataFrame, id_col: str, text_col: str) -> TextIndex:
        """The index with the documents as another segment."""
        path = f"{self.folder}/{len(self.segments):06d}-{uuid.uuid4().hex[:8]}"
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        kind, count, shuffled = rows.schema["id"].dataType.simpleString(), rows.count(), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-count // BLOCK)))).cast("int")
        tasks = max(shuffled, -(-count // TASK))
        dealt = rows.withColumn("block", block).repartitionById(tasks, F.col("block") % tasks).sortWithinPartitions("block")
        words = dealt.select("block", "id", tokens(F.coalesce("text", F.lit(""))).alias("w"))
        shape = f"term string, block int, n long, max_tf int, min_dl int, docs array<struct<id:{kind},dl:int,tf:int,forms:array<struct<word:string,at:array<int>>>>>"
        made = stored(words.mapInArrow(_postings, shape), "text-postings")
        lengths = _written(made.where("term IS NULL").select(F.explode("docs").alias("d")).select("d.id", "d.dl"), f"{path}/docs")
        filled, total = lengths.agg(F.count_if(F.col("dl") > 0), F.coalesce(F.sum("dl"), F.lit(0))).first()
        parts = max(shuffled, -(-total // FILE_WORDS))
        postings = _written(made.where("term IS NOT NULL").repartitionByRange(parts, "term", "block").sortWithinPartitions("term", "block"), f"{path}/postings")
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        postings.select("term", name.alias("file")).groupBy("file").agg(F.min("term").alias("first"), F.max("term").alias("last")).coalesce(1).write.parquet(f"{path}/files")
        # Entries of earlier segments that the new documents replace.
        gone = self._read("docs").join(lengths.select(F.col("id").alias("_id")), F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("id", "segment", "dl") if self.segments else None
        if gone is not None and self._hidden() is not None:
            gone = gone.join(self._hidden().select(F.col("id").alias("_id"), F.col("segment").alias("_segment")), F.col("id").eqNullSafe(F.col("_id")) & (F.col("segment") == F.col("_segment")), "left_anti")
        lost, hidden, hidden_total = (0, 0, 0) if gone is None else _written(gone, f"{path}/hidden").agg(F.count(F.lit(1)), F.count_if(F.col("dl") > 0), F.coalesce(F.sum("dl"), F.lit(0))).first()
        stats = [(int(filled) - int(hidden), int(total) - int(hidden_total), int(lost))]
        self.spark.createDataFrame(stats, "n long, total long, lost long").coalesce(1).write.parquet(f"{path}/stats")
        return TextIndex(self.spark, self.folder, [*self.segments, path])

    def _read(self, what: str, schema: str | None = None) -> DataFrame:
        parts = [self.spark.read.parquet(f"{s}/{what}").withColumn("segment", F.lit(i)) for i, s in enumerate(self.segments)]
        return reduce(DataFrame.unionByName, parts)

    def _hidden(self) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{s}/hidden") for s in self.segments[1:]]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def stats(self) -> tuple[int, float, int]:
        """Documents with words, their mean length, and hidden entries."""
        n, total, lost = self._read("stats").agg(F.sum("n"), F.sum("total"), F.sum("lost")).first()
        return n, total / n if n else 0.0, lost

    def postings(self, terms: list[str], begun: bool = False) -> DataFrame:
        """Rows of these stems, or of stems that they begin; only files that may hold some are read."""
        parts = []
        for i, s in enumerate(self.segments):
            spans = [(F.col("first") <= t + ("\U0010ffff" if begun else "")) & (F.col("last") >= t) for t in terms]
            files = [f"{s}/postings/{r.file}" for r in self.spark.read.parquet(f"{s}/files").where(reduce(Column.__or__, spans)).collect()]
            read = self.spark.read.parquet(*files) if files else self.spark.read.parquet(f"{s}/postings").limit(0)
            wanted = reduce(Column.__or__, [F.col("term").startswith(t) for t in terms]) if begun else F.col("term").isin(terms)
            parts.append(read.where(wanted).withColumn("segment", F.lit(i)))
        return reduce(DataFrame.unionByName, parts)

    def entries(self, rows: DataFrame, lost: int) -> DataFrame:
        """One row for each document of ``postings`` rows, without replaced ones."""
        found = rows.select("segment", "block", "term", F.explode("docs").alias("d")).select("segment", "block", "term", "d.*")
        if not lost:
            return found
        gone = self._hidden().select(F.col("id").alias("_id"), F.col("segment").alias("_segment"))
        return found.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("segment") == F.col("_segment")), "left_anti")

    def _parts(self, terms: list[str], counts: dict[str, int], n: int, avgdl: float, tf: str, dl: str) -> list[Column]:
        """What each term adds to a score, or to the bound of one."""
        out = []
        for t in terms:
            df = counts.get(t, 0)
            idf = F.greatest(F.lit(0.1), F.ln(F.lit(1 + (n - df + 0.5) / (df + 0.5))))
            out.append(F.when(F.col("term") == t, idf * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / avgdl))))
        return out

    def _ready(self, terms: list[str]) -> tuple[DataFrame, dict[str, int], int, float, int] | None:
        n, avgdl, lost = self.stats() if self.segments else (0, 0.0, 0)
        if not n or not terms:
            return None
        rows = self.postings(terms)
        counted = self.entries(rows, lost).groupBy("term").agg(F.count(F.lit(1)).alias("n")) if lost else rows.groupBy("term").agg(F.sum("n").alias("n"))
        return rows, {r.term: r.n for r in counted.collect()}, n, avgdl, lost  # a row a term

    def _scored(self, rows: DataFrame, terms: list[str], counts: dict[str, int], n: int, avgdl: float, lost: int) -> DataFrame:
        parts = self._parts(terms, counts, n, avgdl, "tf", "dl")
        each = self.entries(rows, lost).groupBy("segment", "block", "id").agg(*[F.max(p).alias(f"p{i}") for i, p in enumerate(parts)])
        return each.select("id", reduce(Column.__add__, [F.coalesce(f"p{i}", F.lit(0.0)) for i in range(len(parts))]).alias("score"))

    def scores(self, terms: list[str]) -> DataFrame:
        """``id, score`` of all documents with a term (stems)."""
        ready = self._ready(terms)
        return self._scored(ready[0], terms, *ready[1:]) if ready else self._nothing()

    def top(self, terms: list[str], k: int) -> DataFrame:
        """``id, score`` of the best ``k``, without reading the entries of blocks that cannot reach them."""
        ready = self._ready(terms)
        if not ready:
            return self._nothing()
        rows, counts, n, avgdl, lost = ready
        parts = self._parts(terms, counts, n, avgdl, "max_tf", "min_dl")
        bounds = rows.groupBy("segment", "block").agg(*[F.max(p).alias(f"p{i}") for i, p in enumerate(parts)])
        bounds = bounds.select("segment", "block", reduce(Column.__add__, [F.coalesce(f"p{i}", F.lit(0.0)) for i in range(len(parts))]).alias("bound"))
        first = bounds.orderBy(F.col("bound").desc()).limit(1 + 2 * k // BLOCK).collect()
        best = self._scored(rows.where(reduce(Column.__or__, [(F.col("segment") == r.segment) & (F.col("block") == r.block) for r in first], F.lit(False))), terms, counts, n, avgdl, lost)
        least = [r.score for r in best.orderBy(F.col("score").desc()).limit(k).collect()]
        floor = least[-1] if len(least) == k else 0.0
        # A hair below, for bounds that are sums in another order.
        going = rows.join(bounds.where(F.col("bound") >= floor * (1 - 1e-12)), ["segment", "block"], "left_semi")
        return self._scored(going, terms, counts, n, avgdl, lost).orderBy(F.col("score").desc(), "id").limit(k)

    def _nothing(self) -> DataFrame:
        kind = self._read("docs").schema["id"].dataType.simpleString() if self.segments else "long"
        return self.spark.createDataFrame([], f"id {kind}, score double")

    def ladder(self, terms: list[str], most: int = 12, prefix_from: int = 3) -> DataFrame:
        """``id, tier`` of the first stage that finds any: 0 every term a word, 1 every term the beginning of a
        word by its stem, 2 any term so; short terms stay words. Only stems that a term may begin are read."""
        lost = self.stats()[2] if self.segments else 0
        terms = list(dict.fromkeys(terms))[:most]
        if not self.segments or not terms:
            return self._nothing().select("id", F.lit(0).alias("tier")).limit(0)
        short = self.spark.range(1).select(*[stem(F.lit(t)).alias(f"s{i}") for i, t in enumerate(terms)]).first()
        # A stem is at most two letters shorter than its word.
        heads = sorted({s[: max(1, len(s) - 2)] for s in short})
        rows = self.entries(self.postings(heads, begun=True), lost).select("segment", "id", F.explode("forms.word").alias("word"))
        whole = [F.max(F.col("word") == t).alias(f"w{i}") for i, t in enumerate(terms)]
        begun = [F.max(F.col("word").startswith(s) if len(t) >= prefix_from else F.col("word") == t).alias(f"b{i}") for i, (t, s) in enumerate(zip(terms, short))]
        found = rows.groupBy("segment", "id").agg(*whole, *begun)
        each = lambda c, op: reduce(op, [F.col(f"{c}{i}") for i in range(len(terms))])
        tier = F.when(each("w", Column.__and__), 0).when(each("b", Column.__and__), 1).when(each("b", Column.__or__), 2)
        found = found.select("id", tier.alias("tier")).where("tier is not null")
        return found.join(F.broadcast(found.agg(F.min("tier").alias("tier"))), "tier", "left_semi").select("id", "tier")

    def phrase(self, words: list[str]) -> DataFrame:
        """``id, n``: documents with the folded words one after another, and how often."""
        if not self.segments or not words:
            return self._nothing().select("id", F.lit(0).cast("long").alias("n")).limit(0)
        lost = self.stats()[2]
        stems = list(self.spark.range(1).select(*[stem(F.lit(w)).alias(f"s{i}") for i, w in enumerate(words)]).first())
        rows = self.entries(self.postings(list(dict.fromkeys(stems))), lost).select("segment", "block", "id", F.explode("forms").alias("f")).select("segment", "block", "id", "f.*")
        # Where a phrase would begin if the word were its i-th.
        begins = [F.first(F.when(F.col("word") == w, F.transform("at", _less(i))), ignorenulls=True).alias(f"b{i}") for i, w in enumerate(words)]
        found = rows.groupBy("segment", "block", "id").agg(*begins)
        every = reduce(F.array_intersect, [F.col(f"b{i}") for i in range(len(words))])
        return found.select("id", F.size(every).cast("long").alias("n")).where("n > 0")
