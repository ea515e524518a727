"""Collocations, vector codes and tree concatenation against brute force, the library and odd rows."""

from __future__ import annotations

import hashlib
import io
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm import collocations as co
from lumenframe.llm import vector_codes as vc
from lumenframe.llm.chunks import matched
from lumenframe.llm.sstable import ShardReader, ShardWriter, id_width
from lumenframe.llm.word_bpe import WordBpe, word_bpe_decode, word_bpe_encode, word_bpe_round_trip

WORDS = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string"
ODD = [
    (1, None, "en", "a"), (2, "", None, "a"), (None, "some words here", None, None), (3, " \t\n", "fr", "b"), (4, "x" * 5000, "en", "b"), (5, "same text twice", "en", "b"),
    (5, "same text twice", "en", "b"), (6, "It's ÉÉ ΣΑΣ, <|endoftext|>x \U0001f600\U0001f600 é 1234 it'LL", "de", "c"), (8, " ".join(f"w{i % 700}" for i in range(6000)), "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.select("*", *[F.lit("x").alias(c) for c in ("n", "phrase", "row", "seq", "word", "data", "a", "k", "rank")])


def _collocations(rows, support, top, longest=4, contained=80):
    """The contract, phrase by phrase."""
    count, total = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\v\f\r":
            lowered = lowered.replace(c, "\n")
        for piece in lowered.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    frequent = {x: f for x, f in count.items() if f >= support and len(x[1]) > 1}
    out = []
    for (lang, p), a in frequent.items():
        inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(m == lang and len(q) > len(p) and inside(q) and 100 * f >= contained * a for (m, q), f in frequent.items()):
            continue
        cuts = [(2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, count[lang, p[:k]], count[lang, p[k:]], total[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(best)]
    return sorted(ranked)


def _rows(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("top", [7, 2000])
def test_collocations_equal_brute_force(spark, top):
    rnd = random.Random(3)
    draw = lambda n: "".join(rnd.choice(["the", "The", "sea", "of", "Été", "red", "a\tb", "x"]) + rnd.choice([" ", " ", "  ", ", ", "\n", ". "]) for _ in range(n))
    rows = [(i, draw(rnd.randint(0, 60)), rnd.choice(["en", "en", "fr", None]), "s") for i in range(120)] + [(500, "one two three four five " * 40, "de", None)]
    got = co.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), support=6, top=top)
    assert _rows(got) == _collocations(rows, 6, top)


def test_collocations_of_odd_rows_and_small_slices(spark, odd):
    assert _rows(co.collocations(odd, support=2)) == _collocations(ODD, 2, 2000)
    assert co.collocations(spark.createDataFrame([], SCHEMA)).isEmpty()
    # Slices end between pieces, in the middle of texts.
    docs = spark.createDataFrame([("en", "one two, three four. " * 30), ("fr", "un deux\n" * 20), ("en", None)], "lang string, text string")
    every = [co.Bitmap(1, np.full(1, 255, np.uint8))] * 3
    for count in (lambda n: co.count_words(docs, n), lambda n: co.count_phrases(docs, 4, every, n)):
        whole, cut = (count(n).groupBy("lang", "phrase").agg(F.sum("n")) for n in (co.SLICE, 25))
        assert sorted(whole.collect(), key=str) == sorted(cut.collect(), key=str) and whole.count() >= 3


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    big = 4_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big - 1), ("en", "a b", big - 7)], "lang string, phrase string, f long")
    row = co._scored(counts.where("phrase = 'a b'"), counts).first()
    assert row.score == 2_000_000 * (big - 7) // (2 * big - 1)


def test_bitmap_holds_all_and_little_else(spark):
    inside, outside = ([f"{c}{i}é".encode() for i in range(3000)] for c in "wy")
    table = spark.createDataFrame([("en", w.decode()) for w in inside], "lang string, phrase string")
    bits = co.Bitmap.of(table.select(F.xxhash64(F.concat("lang", F.lit("\0"), "phrase").cast("binary"))), 3000)
    assert bits.holds(co.word_hashes(b"en", inside)).all() and bits.holds(co.word_hashes(b"en", outside)).mean() < 0.1


def _nearest(x, book):
    d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("seed", range(6))
def test_partial_distance_search_is_exact(seed):
    rnd = np.random.default_rng(seed)
    x = rnd.integers(-3 if seed % 2 else -4000, 4 if seed % 2 else 4000, (500, 8))
    book = x[rnd.integers(0, 500, rnd.integers(1, 17))]
    for got, want in zip(vc.nearest(x, book), _nearest(x, book)):
        assert (got == want).all()


def _vector_codes(rows):
    kept = [(i, np.floor(4096 * np.array(v, np.float32).astype(float)).astype(np.int64), label) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.array([r[1] for r in kept])
    w = x.shape[1] // 8
    books = [x[:16, p * w : (p + 1) * w].copy() for p in range(8)]
    for _ in range(6):
        for p in range(8):
            own = x[:, p * w : (p + 1) * w]
            e, _ = _nearest(own, books[p])
            for j in set(e.tolist()):
                books[p][j] = [sum(own[e == j][:, c].tolist()) // int((e == j).sum()) for c in range(w)]
    found = [_nearest(x[:, p * w : (p + 1) * w], books[p]) for p in range(8)]
    error = sum(d for _, d in found)
    by_label = Counter()
    for r, e in zip(kept, error.tolist()):
        by_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    return Counter((r[0], "".join(f"{found[p][0][i]:02x}" for p in range(8)), int(error[i]), by_label[r[2]], sha) for i, r in enumerate(kept))


@pytest.mark.parametrize("n", [5, 300])
def test_vector_codes_equal_brute_force(spark, n):
    rnd = random.Random(n)
    rows = [(i * 3, [float(np.float32(rnd.gauss(0, 0.3))) for _ in range(16)], rnd.choice([1, 2, None])) for i in range(n)]
    rows += [(1, None, 1), (2, [None] * 16, 1), (4, [float("nan")] * 16, 1), (5, [float("inf")] * 16, 2), (9, rows[0][1], 2), (None, rows[1][1], None), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("x", F.lit("clash")).withColumn("error", F.lit(1)).repartition(4)
    got = vc.compress_vectors(df)
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == _vector_codes(rows)


def test_vector_codes_of_odd_tables(spark):
    shape = "vec_id long, embedding array<float>, label int"
    assert vc.compress_vectors(spark.createDataFrame([], shape)).isEmpty()
    mixed = vc.compress_vectors(spark.createDataFrame([(1, [0.5] * 8, 1), (2, [0.25] * 16, 1), (3, [], None)], shape)).collect()
    assert {r.vec_id: (r.code, r.error) for r in mixed} == {1: ("00" * 8, 0), 2: (None, None), 3: (None, None)}
    with pytest.raises(ValueError):
        vc.compress_vectors(spark.createDataFrame([(1, [0.5] * 9, 1)], shape))


def test_vector_codes_decode_to_their_entries(spark):
    rows = vc.scaled(spark.createDataFrame([(i, [i / 8.0] * 8, 0) for i in range(40)], "vec_id long, embedding array<float>, label int"), "vec_id", "embedding", "label")
    books = vc.train_codebooks(rows)
    for r in vc.decode_vectors(vc.encode_vectors(rows, books), books).join(vc.encode_vectors(rows, books), "vec_id").collect():
        assert sum((int(4096 * a) - int(4096 * r.vec_id / 8)) ** 2 for a in r.vector) == r.error


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_tree_concatenation_equals_plain_merging():
    bpe, rnd = WordBpe(WORDS), random.Random(8)
    for alphabet in ("a", "ab", "theinr", "abcdefghij", "é日"):
        for n in (1, 16, 17, 33, 100, 700):
            symbols = bpe.symbols_of("".join(rnd.choice(alphabet) for _ in range(n)))
            want = bpe.merge(symbols)
            assert bpe.encode(symbols) == want
            for k in (1, n // 3, n // 2):
                if 0 < k < n:
                    assert bpe.join(bpe.merge(symbols[:k]), bpe.merge(symbols[k:])) == want


@pytest.mark.parametrize("piece", [16_384, 300])
def test_tree_bpe_equals_library(spark, odd, library, piece):
    rnd = random.Random(2)
    longer = [(100 + i, "".join(rnd.choice(x) for _ in range(3000)) + " tail's", "en", "a") for i, x in enumerate(["ab", "theinr", "-=", "日本é", "a", "éa<|endoftext|>"])]
    docs = odd.unionByName(spark.createDataFrame(longer, SCHEMA), allowMissingColumns=True)
    encoded = word_bpe_encode(docs, WORDS, piece=piece)
    want = Counter()
    for i, t, *_ in ODD + longer:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, word_bpe_round_trip(encoded, WORDS).collect())) == want
    texts = Counter((r.doc_id, r.text) for r in word_bpe_decode(encoded, WORDS).collect())
    assert texts == Counter((i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t, *_ in ODD + longer)


def test_tree_bpe_of_an_empty_table(spark):
    assert word_bpe_encode(spark.createDataFrame([], SCHEMA), WORDS).isEmpty()


def test_chunks_with_equal_hashes_are_told_apart():
    data = b"aa bb aa bb cc"
    at = np.array([0, 2, 5, 8, 11, 14])
    size = np.diff(at)
    for key in (np.zeros(5, np.uint64), np.array([1, 2, 3, 2, 1], np.uint64), np.array([0, 1, 2, 1, 3], np.uint64)):
        first, where = matched(data, at, size, key)
        assert [data[at[first[w]] : at[first[w]] + size[first[w]]] for w in where] == [b"aa", b" bb", b" aa", b" bb", b" cc"]


def test_ids_of_a_large_vocabulary_are_not_cut():
    assert id_width(65_536) == 2 and id_width(70_000) == 4
    for width in (2, 4):
        out = io.BytesIO()
        writer = ShardWriter(out, width)
        if width == 2:
            with pytest.raises(ValueError):
                writer.add(b"k", np.array([69_999], np.uint32))
        else:
            writer.add(b"k", np.array([69_999, 3], np.uint32))
            writer.finish()
            assert [(k, v.tolist()) for k, v in ShardReader(pa.BufferReader(out.getvalue())).entries(0)] == [(b"k", [69_999, 3])]
