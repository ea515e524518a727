"""Vectors as short codes: each of their equal parts is named by the nearest entry of a small
codebook for that part, found by a partial-distance search.

The search takes a part's positions in descending variance of the codebook and adds up integer
distances of all vectors of a batch to all entries at once. The entry that is nearest at the first
position gives every vector a complete distance; a mask drops each entry whose sum so far strictly
exceeds the best complete distance, so only what may still win or tie is carried on. Equal
distances go to the lower entry, so nothing that ties may be dropped.

Codebooks are trained on all vectors. A round sends at most ``PARTS * ENTRIES`` sums from each task,
which Spark adds up; the driver gets one row for each entry, whatever the number of vectors. All
arithmetic is on integers, so the order of rows, tasks and retries changes nothing.

Defined results: rows whose vector is null or holds a null, an infinity or NaN are left out; the
number of components is that of the vector with the smallest id, and must be a multiple of
``PARTS``; a vector of another length keeps its row, with null code and error, and trains nothing.
Of rows that repeat an id, each counts; null ids come last. With fewer vectors than entries the
codebooks are that short; an empty table gives an empty result. Null labels are one label. Components
must stay within 2**27 after scaling (32,768 before), so that sums of squares fit 64 bits: others are an
error. Columns besides id, vector and label are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest size of a scaled component.
MOST = 1 << 27
#: Vectors that are searched at a time.
SLICE = 4096

Codebooks = list[np.ndarray]


def scaled(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, x array<long>``: the rows that count, with each component times ``scale``, floored."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    step = F.transform("v", lambda c: F.coalesce(F.when(F.abs(c) * scale < MOST, F.floor(c * scale)), F.raise_error(F.lit("a component is too large for exact sums")).cast("long")))
    return rows.where(F.col("v").isNotNull() & good).select("vec_id", "label", step.alias("x"))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the index of the nearest row of ``book`` and the squared distance."""
    n, entries = len(x), len(book)
    if not n or not x.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    first = np.abs(x[:, :1] - book[None, :, 0])
    guess = first.argmin(axis=1)
    best = ((x - book[guess]) ** 2).sum(axis=1)
    # Live pairs of a vector and an entry, vector by vector, entries ascending.
    total = (first**2).ravel()
    row, entry = np.repeat(np.arange(n), entries), np.tile(np.arange(entries), n)
    for k in range(1, x.shape[1] + 1):
        live = total <= best[row]
        row, entry, total = row[live], entry[live], total[live]
        if k < x.shape[1]:
            total = total + (x[row, k] - book[entry, k]) ** 2
    # All sums are complete now: the smallest of each vector, the lower entry first.
    by = np.lexsort((entry, total, row))
    row, entry, total = row[by], entry[by], total[by]
    lead = np.flatnonzero(np.diff(row, prepend=-1))
    return entry[lead], total[lead]


def _parts(column: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``dims`` components as rows, and which of the column's rows those are."""
    size = np.diff(column.offsets.to_numpy())
    fits = size == dims
    values = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    return values[np.repeat(fits, size)].reshape(-1, dims), np.flatnonzero(fits)


def _sums(rows: DataFrame, books: Codebooks, dims: int) -> DataFrame:
    """``part, entry, at, n, total``: how many parts chose each entry, and their sums by position."""
    width = dims // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros((len(b), width), np.int64) for b in books]
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            x, _ = _parts(batch.column(0), dims)
            for p, book in enumerate(books):
                own = x[:, p * width : (p + 1) * width]
                entry, _ = nearest(own, book)
                count[p] += np.bincount(entry, minlength=len(book))
                np.add.at(total[p], entry, own)
        out = [(p, e, i, int(count[p][e]), int(total[p][e, i])) for p in range(len(books)) for e in range(len(books[p])) if count[p][e] for i in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, [pa.int32()] * 3 + [pa.int64()] * 2)], ["part", "entry", "at", "n", "total"])

    found = rows.select("x").mapInArrow(run, "part int, entry int, at int, n long, total long")
    return found.groupBy("part", "entry", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def train_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``rows`` (``vec_id, x``): they start as the parts of the smallest ids' vectors, and
    each round puts every entry at the floored mean of the parts nearest to it."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("x").asc()]
    top = rows.select("vec_id", "x").orderBy(*order).limit(1).first()
    if not top:
        return [np.zeros((0, 0), np.int64)] * parts
    dims = len(top.x)
    if dims % parts:
        raise ValueError(f"{dims} components are not {parts} equal parts")
    width = dims // parts
    start = np.array([r.x for r in rows.where(F.size("x") == dims).select("vec_id", "x").orderBy(*order).limit(entries).collect()], np.int64)
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds if width else 0):
        for r in _sums(rows, books, dims).collect():  # at most parts * entries * width rows
            books[r.part][r.entry, r.at] = int(r.total) // int(r.n)
    return books


def codebooks_digest(books: Codebooks) -> str:
    """Lower-case hex SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(c) for book in books for c in book.ravel().tolist()).encode()).hexdigest()


def encode_vectors(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` (``vec_id, label, x``) -> ``vec_id, label, code, error``."""
    width = books[0].shape[1]
    dims = width * len(books)
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            x, at = _parts(batch.column(2), dims)
            found = [nearest(x[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)]
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            for i, code, error in zip(at.tolist(), np.stack([digits[e] for e, _ in found], axis=1).tolist(), sum(d for _, d in found).tolist()):
                codes[i], errors[i] = "".join(code), error
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("vec_id", "label", "x").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode_vectors(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``vec_id, code`` -> ``vec_id, vector array<double>``: the entries that a code names."""
    flat = [[(book[e] / scale).tolist() for e in range(len(book))] for book in books]
    table = F.array(*[F.array(*[F.array(*map(F.lit, entry)) for entry in book]) for book in flat])
    digit = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.select("vec_id", F.flatten(F.array(*[table[p][digit(p)] for p in range(len(books))])).alias("vector"))


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256``: codebooks trained on all vectors,
    each vector's code and error, and the error of all vectors of its label."""
    scratch = Scratch(vectors.sparkSession, "vector-codes")
    rows = scratch.keep(scaled(vectors, id_col, vector_col, label_col))
    books = train_codebooks(rows, parts, entries, rounds)
    found = scratch.keep(encode_vectors(rows, books))
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = found.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return joined.withColumn("codebooks_sha256", F.lit(codebooks_digest(books)))
