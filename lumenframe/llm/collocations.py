"""Collocations: frequent phrases of each language whose parts seldom stand without each other.

Apriori, a pass over the texts for each length. A pass counts phrases of ``k`` words only where both
phrases of ``k - 1`` words inside are frequent. Those are broadcast as the bits of their hashes,
in a bitmap whose size follows their number and ends at ``MOST_BITS``. The passes between count hashes,
which are numbers and need no texts; only the last makes texts, of the phrases of all lengths whose bits are
set, and counts them as such. A bit or a hash that other phrases share only lets a rare phrase be counted,
which its own count then drops, so results never depend on hashes. A slice of texts is counted
with numpy on word numbers; what tasks send is one row for each phrase and slice, which Spark adds up
before and after its shuffle.

Each frequent phrase of two words or more is cut at every place, and the counts of both parts come from the
level tables: every part of a frequent phrase is frequent. The lowest score of the cuts is the phrase's.

Defined results: a null language is ``und`` and a null text is empty; phrases stay within pieces
between punctuation; scores are exact whole numbers; equal scores are ordered by count, then by the
phrase's bytes; rows that repeat count each; an empty table gives an empty result; texts of any
length are counted whole, some pieces at a time; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import Scratch

SUPPORT, LONGEST, TOP, CONTAINED = 30, 4, 2000, 80
#: Bytes of text that are counted at a time.
SLICE = 8_000_000
#: Bits of a bitmap for each phrase, and at most (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Groups that a language is ranked in before its best phrases meet.
SALTS = 32

#: A-Z in lower case, a line feed for what ends a piece, and a space for a tab.
_TABLE = bytes(ord("\n") if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Numbered(dict):
    """Words numbered as they are first met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Bitmap:
    """Which hashes may be among those of a table."""

    def __init__(self, bits: int, found: np.ndarray):
        self.mask, self.bytes = bits - 1, found

    @staticmethod
    def of(hashes: DataFrame, count: int) -> Bitmap:
        """The bitmap of a column of 64-bit hashes: rows of 4 KB, as many as the bits ask for."""
        bits = 1 << 15
        while bits < min(count * BITS_EACH, MOST_BITS):
            bits *= 2
        at = hashes.toDF("hash").select((F.col("hash").bitwiseAND(F.lit(bits - 1)) + 1).alias("at"))  # Spark counts from 1
        rows = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
        found = np.zeros(bits // 8, np.uint8)
        for r in rows.toLocalIterator():
            found[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bitmap, np.uint8)
        return Bitmap(bits, found)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.mask)
        return (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def word_hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    """As Spark's ``xxhash64`` of the language, a zero byte and the word."""
    head = lang + b"\0"
    return np.fromiter((xxhash.xxh64_intdigest(head + w, 42) for w in words), np.uint64, len(words))


def _longer(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase, from that of its beginning and its last word's."""
    h = before * np.uint64(0x9E3779B97F4A7C15) + word
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _words(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of pieces as numbers, 1 where a piece ends, and the words from 2 on."""
    numbers = _Numbered({b"": 0, b"\n": 1})
    split = data.replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(numbers.__getitem__, split), np.int64, len(split))
    return ids[ids > 0], list(numbers)


def _phrases(lang: bytes, data: bytes, level: int, frequent: list[Bitmap], named: bool) -> Iterator[tuple[list[bytes] | np.ndarray, np.ndarray]]:
    """Phrases of ``level`` words that may be frequent and their counts: as hashes, or as texts (``named``), then
    with those of all lengths from 2."""
    ids, words = _words(data)
    if len(ids) < level:
        return
    hashes = np.append(np.zeros(2, np.uint64), word_hashes(lang, words[2:]))
    held = frequent[0].holds(hashes)
    held[:2] = False
    # The number of the phrase that begins at each place, or -1; the phrases' hashes and texts.
    begins, own, texts = np.where(held[ids], ids, -1), hashes, words
    for k in range(2, level + 1):
        both = np.flatnonzero((begins[:-1] >= 0) & (begins[1:] >= 0))
        key, where, counts = np.unique(begins[both] * len(words) + ids[both + k - 1], return_inverse=True, return_counts=True)
        first, last = key // len(words), key % len(words)
        own = _longer(own[first], hashes[last])
        held = frequent[k - 1].holds(own) if k < level else np.ones(len(own), bool)
        if named:
            at = np.flatnonzero(held)
            found = [texts[a] + b" " + words[b] for a, b in zip(first[at].tolist(), last[at].tolist())]
            yield found, counts[at]
        elif k == level:
            yield own, counts
        if k < level:
            # Phrases that may not be frequent are numbered no more.
            number = np.where(held, np.cumsum(held) - 1, -1)
            begins = np.full(len(begins) - 1, -1)
            begins[both] = number[where]
            own = own[held]
            texts = found if named else texts


def _pieces(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[tuple[bytes, bytes]]:
    """Whole pieces of one language, about a slice at a time."""
    waiting: dict[bytes, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).cast(pa.binary()), batch.column(1).cast(pa.large_binary())):
            data, lang = (text.as_py() or b"").translate(_TABLE), lang.as_py()
            at = 0
            while at < len(data):
                end = len(data) if len(data) - at <= slice_bytes else data.find(b"\n", at + slice_bytes)
                end = len(data) if end < 0 else end
                waiting.setdefault(lang, []).append(data[at:end])
                size += end - at
                at = end + 1
                if size >= slice_bytes:
                    yield from ((k, b"\n".join(v)) for k, v in waiting.items())
                    waiting, size = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in waiting.items())


def count_words(docs: DataFrame, slice_bytes: int = SLICE) -> DataFrame:
    """``lang, phrase, n`` of ``docs`` (``lang, text``) for each slice of texts; the number of all words is the row
    without a phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _pieces(batches, slice_bytes):
            ids, words = _words(data)
            counts = np.bincount(ids, minlength=len(words))[2:]
            yield from _named(lang, [*words[2:], None], np.append(counts, counts.sum()))

    return docs.mapInArrow(run, "lang string, phrase string, n long")


def _named(lang: bytes, phrases: list[bytes | None], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(phrases), 100_000):
        found = pa.array(phrases[k : k + 100_000], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(found), pa.string()), found, pa.array(counts[k : k + 100_000], pa.int64())], ["lang", "phrase", "n"])


def count_hashes(docs: DataFrame, level: int, frequent: list[Bitmap], slice_bytes: int = SLICE) -> DataFrame:
    """``hash, n`` of the phrases of ``level`` words whose parts are frequent, for each slice of texts."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _pieces(batches, slice_bytes):
            for hashes, counts in _phrases(lang, data, level, sent.value, named=False):
                for k in range(0, len(counts), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[k : k + 100_000].view(np.int64)), pa.array(counts[k : k + 100_000], pa.int64())], ["hash", "n"])

    return docs.mapInArrow(run, "hash long, n long")


def count_phrases(docs: DataFrame, longest: int, frequent: list[Bitmap], slice_bytes: int = SLICE) -> DataFrame:
    """``lang, phrase, n`` of the phrases of 2 to ``longest`` words that may be frequent, for each slice of texts."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in _pieces(batches, slice_bytes):
            for phrases, counts in _phrases(lang, data, longest, sent.value, named=True):
                yield from _named(lang, phrases, counts)

    return docs.mapInArrow(run, "lang string, phrase string, n long")


def frequent_phrases(docs: DataFrame, scratch: Scratch, support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, f`` of phrases of 1 to ``longest`` words that occur ``support`` times or more, and
    ``lang, n``: how many words a language has."""
    added = lambda df, keys: df.groupBy(*keys).agg(F.sum("n").alias("f"))
    words = scratch.keep(added(count_words(docs), ["lang", "phrase"]).where(f"f >= {support} or phrase is null"))
    totals, words = words.where("phrase is null").select("lang", F.col("f").alias("n")), words.where("phrase is not null")
    hashed = F.xxhash64(F.concat("lang", F.lit("\0"), "phrase").cast("binary"))
    bitmaps = [Bitmap.of(words.select(hashed), words.count())]
    for level in range(2, longest):
        hashes = scratch.keep(added(count_hashes(docs, level, bitmaps), ["hash"]).where(f"f >= {support}").select("hash"))
        bitmaps.append(Bitmap.of(hashes, hashes.count()))
    several = scratch.keep(added(count_phrases(docs, longest, bitmaps), ["lang", "phrase"]).where(f"f >= {support}"))
    return words.unionByName(several), totals


def _joined(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """``candidates`` (``lang, phrase, f``) -> ``lang, phrase, a, l, r, score`` of the lowest cut."""
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("w"), F.lit(1), F.col("k")).alias("first"), _joined(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    low = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("low")
    return cuts.groupBy("lang", "phrase", "a").agg(low).select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def _uncontained(scored: DataFrame, longer: DataFrame, percent: int) -> DataFrame:
    """``scored`` without the phrases that some longer one holds, at ``percent`` of their count or more."""
    words = F.split("phrase", " ")
    spans = longer.select("lang", "f", words.alias("w"), F.explode(F.sequence(F.lit(2), F.size(words) - 1)).alias("size"))
    spans = spans.select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    most = spans.groupBy("lang", _joined(F.col("w"), F.col("at"), F.col("size")).alias("phrase")).agg(F.max("f").alias("_longer"))
    kept = scored.join(most, ["lang", "phrase"], "left")
    return kept.where(F.col("_longer").isNull() | (100 * F.col("_longer") < percent * F.col("a"))).drop("_longer")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, contained: int = CONTAINED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of each language."""
    scratch = Scratch(docs.sparkSession, "collocations")
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counts, totals = frequent_phrases(rows, scratch, support, longest)
    several = counts.where(F.instr("phrase", " ") > 0)
    kept = _uncontained(_scored(several, counts), several.where(F.size(F.split("phrase", " ")) > 2), contained)
    # A language's best meet only after the best of parts of it are found.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_place") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
