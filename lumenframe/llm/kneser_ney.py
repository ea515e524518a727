"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of characters.

The model is trained on all trusted rows but one in ``HELD``, by a hash of their id, that never trains it; given ``most``, only on
the first so many in the order of that hash. Counts, continuation counts,
context totals and their back-off weights are tables keyed by n-gram; the distinct 4-grams of each
block of rows are joined with these tables order by order, and each block gets the probabilities of
its own n-grams back to score its rows, which travel as compressed chunks. A row is kept if its perplexity is at most the given quantile of
its language's trusted rows that the model was not trained on; a language with fewer than ``few`` of
those takes the quantile of them all. So few rows in all show no such quantile themselves; then it is
that of a normal distribution with the mean and spread of their log perplexities.

Characters are lower-cased for A-Z; those beyond the basic plane count as U+FFFD, and so do the two
control characters that serve as marks. Three start marks precede a text and one end mark follows.
An n-gram that begins with a start mark has no other left neighbours, so it keeps its raw count.

Defined results: a null text is an empty one, of which only the end is predicted; a null language
is a language of its own; without held-out trusted rows every row is kept; rows that repeat are scored one
by one; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import blocks, store

ORDER = 4
START, END, OTHER = 2, 3, 0xFFFD
#: One in so many trusted rows is held out of training.
HELD = 5
#: Ids of trusted rows that are broadcast rather than joined by a shuffle of the texts.
BROADCAST_IDS = 8_000_000
_MASK = {k: (1 << 16 * k) - 1 for k in (1, 2, 3)}


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All 4-grams as four 16-bit characters in 64 bits, and the number of them in each text."""
    joined, sizes = [], []
    for t in texts:
        x = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4")
        x = np.where((x > 0xFFFF) | (x == START) | (x == END), OTHER, x).astype(np.uint64)
        x = np.where((x >= 65) & (x <= 90), x + np.uint64(32), x)
        joined += [[START] * 3, x, [END]]
        sizes.append(len(x) + 1)
    flat = np.concatenate([np.asarray(x, np.uint64) for x in joined]) if joined else np.empty(0, np.uint64)
    sizes = np.array(sizes, np.int64)
    code = (flat[:-3] << np.uint64(48)) | (flat[1:-2] << np.uint64(32)) | (flat[2:-1] << np.uint64(16)) | flat[3:]
    # Windows that begin among the last three characters of a text reach into the next one.
    last = np.cumsum(sizes + 3)[:-1]
    keep = np.ones(len(code), bool)
    for k in (1, 2, 3):
        keep[last - k] = False
    return code[keep], sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> (gram, c), summed for each batch."""
    for batch in batches:
        code, n = np.unique(grams(batch.column(0).to_pylist())[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "c"])


def _block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, text) -> the distinct 4-grams of each block."""

    def rows(block: int, found: list[np.ndarray]) -> pa.RecordBatch:
        code = np.unique(np.concatenate(found)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), block)), pa.array(code)], ["block", "gram"])

    now, found, size = None, [], 0
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for at in range(0, len(ids), 256):
            for block in np.unique(ids[at : at + 256]):
                part = [t for b, t in zip(ids[at : at + 256], texts[at : at + 256]) if b == block]
                if block != now and found:
                    yield rows(now, found)
                    found = []
                now = block
                found.append(np.unique(grams(part)[0]))
    if found:
        yield rows(now, found)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, doc_id, lang, text) -> (block, chunk): up to 256 rows of a block as one compressed stream."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        ends = np.union1d(np.flatnonzero(np.diff(ids)) + 1, np.arange(256, len(ids), 256))
        for first, end in zip([0, *ends], [*ends, len(ids)]):
            if first == end:
                continue
            part, sink = batch.slice(first, end - first).select(["doc_id", "lang", "text"]), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[first])]), pa.array([sink.getvalue().to_pybytes()])], ["block", "chunk"])


def _levels(g4: DataFrame) -> dict[int, DataFrame]:
    """``(gram, c)`` of each order: counts at the highest; below, distinct left neighbours, or the
    raw count after a start mark."""
    tables = {4: g4}
    for k in (3, 2, 1):
        own = F.col("gram").bitwiseAND(F.lit(_MASK[k])).alias("gram")
        first = F.shiftrightunsigned("gram", 16 * (k - 1))
        sums = tables[k + 1].groupBy(own).agg(F.sum("c").alias("_sum"), F.count(F.lit(1)).alias("_kinds"))
        tables[k] = sums.select("gram", F.when(first == START, F.col("_sum")).otherwise(F.col("_kinds")).alias("c"))
    return tables


def _discounts(table: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams that occur one to four times."""
    n = table.agg(*[F.count(F.when(F.col("c") == k, 1)) for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(x) for x in n)
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    clip = lambda x, most: min(max(x, 0.05), most)
    return clip(1 - 2 * y * n2 / n1, 1.0), clip(2 - 3 * y * n3 / n2, 2.0), clip(3 - 4 * y * n4 / n3, 3.0)


def _discount(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c == 1, F.lit(d[0])).when(c == 2, F.lit(d[1])).otherwise(F.lit(d[2]))


def probabilities(asked: DataFrame, trusted: DataFrame) -> DataFrame:
    """``gram`` rows -> ``gram, lp``: log10 of the last character's probability after the others,
    learnt from ``trusted``'s ``text``."""
    g4 = trusted.select("text").mapInArrow(_count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    tables = _levels(store(g4, "kn-counts"))
    n_kinds = tables[1].count() + 1
    p = F.lit(1.0 / n_kinds)
    found = asked
    for k in (1, 2, 3, 4):
        d = _discounts(tables[k])
        own = F.col("gram") if k == 4 else F.col("gram").bitwiseAND(F.lit(_MASK[k]))
        context = F.shiftrightunsigned("gram", 16)
        context = context if k == 4 else context.bitwiseAND(F.lit(_MASK[k - 1] if k > 1 else 0))
        counts = tables[k].select(F.col("gram").alias(f"_g{k}"), F.col("c").alias(f"_c{k}"))
        freed = _discount(F.col("c"), d)
        stats = tables[k].groupBy((F.shiftrightunsigned("gram", 16)).alias(f"_h{k}")).agg(F.sum("c").alias(f"_t{k}"), F.sum(freed).alias(f"_f{k}"))
        found = found.join(counts, own == F.col(f"_g{k}"), "left").join(stats, context == F.col(f"_h{k}"), "left")
        c, total = F.coalesce(f"_c{k}", F.lit(0)), F.col(f"_t{k}")
        seen = F.when(c > 0, F.greatest(c - _discount(c, d), F.lit(0.0))).otherwise(F.lit(0.0))
        p = F.when(total.isNull(), p).otherwise(seen / total + F.col(f"_f{k}") / total * p)
    return found.select("gram", F.log10(p).alias("lp"))


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", is_table: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, lang, n_chars, log10_prob, perplexity``."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = blocks(plain if is_table else store(plain, "kn-docs"), 4096)
    asked = store(rows.select("block", "text").mapInArrow(_block_grams, "block long, gram long"), "kn-grams")
    table = asked.join(probabilities(asked.select("gram").distinct(), trusted), "gram").select("block", "gram", "lp")

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, lp = known[order], right.column("lp").to_numpy()[order]
        total, n, own = [], [], []
        for chunk in left.column("chunk"):
            part = pa.ipc.open_stream(chunk.as_buffer()).read_all()
            code, sizes = grams(part.column("text").to_pylist())
            total.append(np.add.reduceat(lp[np.searchsorted(known, code)], np.cumsum([0, *sizes[:-1]])))
            n.append(sizes)
            own.append(part.select(["doc_id", "lang"]))
        own = pa.concat_tables(own)
        total, n = np.concatenate(total), np.concatenate(n)
        columns = [own.column("doc_id"), own.column("lang"), pa.array(n), pa.array(total), pa.array(10 ** (-total / n))]
        return pa.Table.from_arrays(columns, names=["doc_id", "lang", "n_chars", "log10_prob", "perplexity"])

    schema = "doc_id long, lang string, n_chars long, log10_prob double, perplexity double"
    packed = rows.select("block", "doc_id", "lang", "text").mapInArrow(_packed, "block long, chunk binary")
    return packed.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(judge, schema)


def quality_by_perplexity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    most: int | None = None, quantile: float = 0.995, few: int = 30, is_table: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, lang, n_chars, log10_prob, perplexity, threshold, kept``.
    ``labels``: ids and ``quality``; 1 marks the trusted rows. One in ``HELD`` of them sets the thresholds, all
    others train the model, or the first ``most`` of them where that is given."""
    ids = labels.where("quality = 1").select(F.col(id_col).cast("long").alias("_id")).where("_id is not null").distinct()
    every = store(ids, "kn-labelled")
    order = F.xxhash64("_id")
    ids = every.where(F.pmod(order, F.lit(HELD)) != 0)
    ids = store(ids if most is None else ids.orderBy(order, "_id").limit(most), "kn-trusted")
    # Ids alone fit a broadcast up to this many, which saves moving the texts; more are joined by a shuffle.
    near = F.broadcast if ids.count() <= BROADCAST_IDS else (lambda df: df)
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    trusted = own.join(near(ids), "_id", "left_semi")
    scored = store(perplexities(docs, trusted, id_col, text_col, lang_col, is_table), "kn-scores")
    unseen = every.join(near(ids), "_id", "left_anti")
    sample = scored.join(unseen, scored["doc_id"] == unseen["_id"], "left_semi")
    cut_at = F.percentile_approx("perplexity", quantile, 10_000)
    by_lang = sample.groupBy("lang").agg(cut_at.alias("_own"), F.count(F.lit(1)).alias("_n")).select(F.col("lang").alias("_lang"), "_own", "_n")
    of_all, n, mean, spread = sample.agg(cut_at, F.count(F.lit(1)), F.avg(F.log10("perplexity")), F.stddev(F.log10("perplexity"))).first()
    overall = of_all if n >= few or not n else 10 ** (mean + NormalDist().inv_cdf(quantile) * (spread or 0.0))
    found = scored.join(by_lang, scored["lang"].eqNullSafe(F.col("_lang")), "left")
    threshold = F.when(F.col("_n") >= few, F.col("_own")).otherwise(F.lit(overall).cast("double"))
    return found.select("doc_id", "lang", "n_chars", "log10_prob", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("kept"))
