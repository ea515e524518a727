"""Language-model scoring by subword lattices.

Each word is a lattice of all its segmentations into the pieces of an existing vocabulary. The
vocabulary's scores weight the segmentations: a score of a merge vocabulary is minus a piece's rank, which
Zipf's law makes a probability. Under these weights the forward and backward recursions give each
piece's expected count over all segmentations of the training words; the vocabulary's weights, as
``PRIOR`` counts, smooth them. The forward recursion in log space then sums all segmentations
under the fitted weights, so a word's score is its marginal probability, and a text's is that of its
words and its end. Characters without a piece are spelled in byte pieces. Words of about the same
length go through the recursions together, a position of all of them at a time.

Words are counted by block: rows of one scanned block become its distinct words, these are joined
with the corpus counts, and each block gets its own small dictionary back. Neither the corpus
vocabulary nor the pairs of texts and words ever meet in one place.

Defined results: a null text is an empty one, with the end as its only token; a null id counts as
training data under the text ``null``; rows that repeat count and are scored one by one; an empty
table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import blocks, store

#: Rows whose crc32 leaves this remainder are held out.
FOLDS, HELD_OUT = 7, 2
#: Counts that the vocabulary's own weights stand for, and those of the end.
PRIOR, PRIOR_END = 3_200.0, 0.1
#: Characters of words that go through the recursions together; longer words go alone.
CELLS, LONG = 100_000, 200
SPACE_MARK = "▁"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


class Lattice:
    """A trie of pieces, and the recursions over all segmentations of words."""

    def __init__(self, pieces: list[str]):
        """``pieces`` in the order of their weights; ``<0x00>`` to ``<0xFF>`` are among them."""
        self.size = len(pieces)
        self.byte = [pieces.index(f"<0x{b:02X}>") for b in range(256)]
        plain = [(x, i) for i, x in enumerate(pieces) if not (len(x) == 6 and x.startswith("<0x"))]
        letters = sorted({c for x, _ in plain for c in x})
        self.letter = np.zeros(0x110000, np.int32)  # 0 is no letter of any piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        nodes, self.longest = {"": 0}, max([len(x) for x, _ in plain], default=0)
        for x, _ in plain:
            for n in range(1, len(x) + 1):
                nodes.setdefault(x[:n], len(nodes))
        self.piece = np.full(len(nodes), -1, np.int32)
        self.piece[[nodes[x] for x, _ in plain]] = [i for _, i in plain]
        edges = sorted((nodes[x[:-1]] * self.width + int(self.letter[ord(x[-1])]), n) for x, n in nodes.items() if x)
        self.keys, self.child = np.array([k for k, _ in edges], np.int64), np.array([n for _, n in edges], np.int32)
        self.root = np.full(self.width, -1, np.int32)
        top = self.keys < self.width
        self.root[self.keys[top]] = self.child[top]

    def _spelled(self, letters: np.ndarray, weights: np.ndarray) -> np.ndarray:
        spelled = [chr(x).encode("utf-8", "surrogatepass") for x in letters.tolist()]
        return np.array([weights[[self.byte[b] for b in x]].sum() for x in spelled])

    def _edges(self, text: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(from, to, words, pieces, log weights) of all edges by their start; texts are columns of
        letters, the longest first. A negative piece is minus one minus a letter spelled in bytes."""
        known, places = np.unique(text, return_inverse=True)
        spelled, letter = self._spelled(known, weights), self.letter[text]
        places = places.reshape(text.shape)
        for i in range(len(text)):
            live = np.arange(np.searchsorted(-sizes, -i))
            node = self.root[letter[i, live]]
            bare = live[(node < 0) | (self.piece[node] < 0)]
            if len(bare):
                yield i, i + 1, bare, -1 - text[i, bare].astype(np.int64), spelled[places[i, bare]]
            live, node, j = live[node >= 0], node[node >= 0], i + 1
            while len(live):
                piece = self.piece[node]
                whole = piece >= 0
                if whole.any():
                    yield i, j, live[whole], piece[whole], weights[piece[whole]]
                more = sizes[live] > j
                live, node = live[more], node[more]
                if not len(live):
                    break
                key = node.astype(np.int64) * self.width + letter[j, live]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[at] == key
                live, node, j = live[found], self.child[at[found]], j + 1

    def _batches(self, words: list[str]) -> Iterator[list[int]]:
        """Indexes of words, the longest first, that go together."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        at = 0
        while at < len(order):
            size = len(words[order[at]]) + 1
            step = 1 if size > LONG else max(1, CELLS // size)
            yield order[at : at + step]
            at += step

    def log_marginals(self, words: list[str], weights: np.ndarray, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """log of each word's summed probability over all segmentations. With ``counts`` of the words,
        the expected count of each piece is added to ``expected``."""
        out = np.empty(len(words))
        for batch in self._batches(words):
            texts = [SPACE_MARK + words[i] for i in batch]
            sizes = np.array([len(t) for t in texts])
            joined = "".join(t.ljust(sizes[0], "\0") for t in texts).encode("utf-32-le", "surrogatepass")
            text = np.ascontiguousarray(np.frombuffer(joined, "<u4").reshape(len(texts), -1).T)
            if len(texts) == 1:
                out[batch[0]] = self._alone(texts[0], weights, None if counts is None else float(counts[batch[0]]), expected)
                continue
            ahead = np.full((len(text) + 1, len(texts)), -np.inf)
            ahead[0] = 0.0
            edges = []
            for i, j, rows, pieces, w in self._edges(text, sizes, weights):
                ahead[j, rows] = np.logaddexp(ahead[j, rows], ahead[i, rows] + w)
                if counts is not None:
                    edges.append((i, j, rows, pieces, w))
            z = ahead[sizes, np.arange(len(texts))]
            out[batch] = z
            if counts is not None:
                c = counts[batch]
                back = np.full_like(ahead, -np.inf)
                back[sizes, np.arange(len(texts))] = 0.0
                for i, j, rows, pieces, w in reversed(edges):
                    rest = w + back[j, rows]
                    back[i, rows] = np.logaddexp(back[i, rows], rest)
                    self._add(expected, pieces, np.exp(ahead[i, rows] + rest - z[rows]) * c[rows])
        return out

    def _add(self, expected: np.ndarray, pieces: np.ndarray, n: np.ndarray) -> None:
        if pieces[0] >= 0:
            expected += np.bincount(pieces, n, self.size)
            return
        for letter in np.unique(pieces):
            for b in chr(-1 - int(letter)).encode("utf-8", "surrogatepass"):
                expected[self.byte[b]] += n[pieces == letter].sum()

    def _alone(self, text: str, weights: np.ndarray, count: float | None, expected: np.ndarray | None) -> float:
        """The same for one text, whose words' positions are too many to step through with others."""
        starts: list[list[tuple[int, int, float]]] = []
        ahead: list[list[float]] = [[] for _ in range(len(text) + 1)]
        ahead[0].append(0.0)
        sums = []
        for i, c in enumerate(text):
            sums.append(_log_sum(ahead[i]))
            found, node, j = [], 0, i
            while j < len(text):
                key = node * self.width + int(self.letter[ord(text[j])])
                at = int(np.searchsorted(self.keys, key))
                if at == len(self.keys) or self.keys[at] != key:
                    break
                node, j = int(self.child[at]), j + 1
                if self.piece[node] >= 0:
                    found.append((j, int(self.piece[node]), float(weights[self.piece[node]])))
            if not found or found[0][0] != i + 1:
                found.append((i + 1, -1 - ord(c), float(self._spelled(np.array([ord(c)]), weights)[0])))
            starts.append(found)
            for j, _, w in found:
                ahead[j].append(sums[-1] + w)
        z = _log_sum(ahead[-1])
        if count is not None:
            back = [0.0] * (len(text) + 1)
            for i in range(len(text) - 1, -1, -1):
                back[i] = _log_sum([w + back[j] for j, _, w in starts[i]])
                for j, piece, w in starts[i]:
                    self._add(expected, np.array([piece]), np.array([math.exp(sums[i] + w + back[j] - z) * count]))
        return z


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum([math.exp(v - top) for v in x]))


def read_vocabulary(model_path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a sentencepiece vocabulary, without its control and unknown pieces, and the log
    probability that Zipf's law gives their ranks. A merge vocabulary scores a piece by minus its
    rank; byte pieces and those that are never merged to get the last one."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i))]
    last = float(model.get_piece_size())
    rank = np.array([last if model.is_byte(i) else min(-model.get_score(i), last) for i in ids])
    p = 1.0 / (np.maximum(rank, 0.0) + 1.0)
    return [model.id_to_piece(i) for i in ids], np.log(p / p.sum())


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


_WORDS = "block long, word string, n long"


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, doc_id, text) -> each distinct word of a block with its training count; the word
    "" stands for the end."""

    def rows(block: int, all_words: Counter, ends: int) -> pa.RecordBatch:
        words = [w.decode() for w in all_words] + [""]
        n = [*all_words.values(), ends]
        return pa.RecordBatch.from_arrays([pa.array([block] * len(words), pa.int64()), pa.array(words), pa.array(n, pa.int64())], ["block", "word", "n"])

    now, found, ends = None, Counter(), 0
    for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
        for block, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if block != now:
                if now is not None:
                    yield rows(now, found, ends)
                now, found, ends = block, Counter(), 0
            words = _words(text)
            if held_out(doc_id):
                for w in words:
                    found.setdefault(w, 0)
            else:
                found.update(words)
                ends += 1
    if now is not None:
        yield rows(now, found, ends)


def lattice_scores(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", is_table: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``; both scores are log10. ``is_table``: ``docs`` is a plain scan, which can be read
    twice in the same order; otherwise a copy is stored first."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = blocks(plain if is_table else store(plain, "lattice-docs")).select("block", "doc_id", "text")

    words = store(rows.mapInArrow(_block_words, _WORDS), "lattice-words")
    totals = store(words.groupBy("word").agg(F.sum("n").alias("c")), "lattice-totals")
    known = totals.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("c"))), F.lit(0))).first()
    n_tokens, n_types, n_ends = (int(x) for x in known)

    pieces, first = read_vocabulary(model_path)

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, expected = Lattice(pieces), np.zeros(len(pieces))
        for batch in (b.slice(k, 5000) for b in batches for k in range(0, b.num_rows, 5000)):
            lattice.log_marginals(batch.column(0).to_pylist(), first, batch.column(1).to_numpy().astype(float), expected)
        used = np.flatnonzero(expected)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(expected[used])], ["piece", "n"])

    used = totals.where("c > 0 and word != ''").select("word", "c").mapInArrow(use, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = np.exp(first) * PRIOR
    for r in used.collect():  # at most one row for each piece of the vocabulary
        counts[r["piece"]] += r["n"]
    total = counts.sum() + n_ends + PRIOR_END
    weights = np.log(counts / total)
    end = math.log((n_ends + PRIOR_END) / total)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces)
        for batch in batches:
            words = batch.column(0).to_pylist()
            lp = lattice.log_marginals(words, weights)
            lp[[i for i, w in enumerate(words) if not w]] = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lp / math.log(10))], ["word", "c", "lp"])

    scored = totals.mapInArrow(score, "word string, c long, lp double")
    table = words.select("block", "word").join(scored, "word").select("block", "word", "c", "lp")
    below = math.log10(n_tokens + n_types + 1)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        c = right.column("c").to_numpy()
        base, own, seen = np.log10(c + 1.0) - below, right.column("lp").to_numpy(), c > 0
        place = dict(zip(right.column("word").cast(pa.binary()).to_pylist(), range(len(c))))
        ids, texts, sizes, sums = left.column("doc_id"), left.column("text"), [], []
        for k in range(0, len(texts), 256):
            split = [_words(t) + [b""] for t in texts.slice(k, 256).to_pylist()]
            n = [len(x) for x in split]
            flat = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, sum(n))
            starts = np.cumsum([0, *n[:-1]])
            sums.append([np.add.reduceat(x[flat], starts) for x in (seen.astype(np.int64), base, own)])
            sizes += n
        sums = [np.concatenate(x) for x in zip(*sums)] if sums else [np.empty(0)] * 3
        columns = [ids, pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(sizes, pa.int64()), pa.array(sums[0], pa.int64())]
        columns += [pa.array(np.full(len(sizes), n_tokens)), pa.array(sums[1], pa.float64()), pa.array(sums[2], pa.float64())]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(judge, schema)
