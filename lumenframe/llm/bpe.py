"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Merges by rank have one encoding for every prefix of a word, so the last token of a prefix leads
to the shorter prefix before it. A token may follow another if merging the bytes of both leaves
the two as they are. A nondeterministic machine that begins a token at every byte is determinised:
a state is the longest tail that a token may still go on from, which tells all live positions.
A step reads a byte and yields the next state and the tokens that may end there, the longest first;
the first of them that can follow the last token before it ends the prefix. States and steps are
made when first met; the vocabulary's beginnings bound their number, and registers hold one token
for each byte since the last one emitted. Only the chains from live positions can become the
encoding: what they have in common is emitted every ``AHEAD`` bytes, and the registers before it go.
The new words of a slice step together through the same tables, a byte of all of them at a time.

Pre-tokenised words that are themselves in the vocabulary are that token. Encoding is the same
whether words come alone or in a text, so results are kept by chunk.

Defined results: a null text is an empty one, without tokens; rows that repeat are encoded one by
one; a null id stays null; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.chunks import Memo

#: Steps and pairs of tokens kept before they are made anew.
STEPS, PAIRS = 400_000, 400_000
#: Words whose ids a worker keeps.
WORDS = 300_000
#: Rows whose ids are held at once.
SLICE = 500
#: Bytes of a word that are read before tokens are emitted; shorter words are emitted at their end.
AHEAD = 256
#: Bits of the number of slots in which the latest pairs of tokens are kept for words that step together.
SLOTS = 20
_BYTES = [bytes([b]) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encodes words, a byte at a time, by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.length = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.length[list(self.bytes_of)] = [len(x) for x in self.bytes_of.values()]
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, tuple[int, int] | None] = {}
        self.prefixes = {k[:i] for k in ranks for i in range(1, len(k))}
        self.reset()

    def reset(self) -> None:
        """Forgets all states but the start, whose tail is empty."""
        self.numbers: dict[bytes, int] = {b"": 0}
        self.tails: list[bytes] = [b""]
        self.steps: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}
        # The same as arrays: the number of a step, its next state, and where its ends begin.
        self.step_of = np.full(1 << 16, -1, np.int32)
        self.next: list[int] = []
        self.first: list[int] = [0]
        self.sizes: list[int] = []
        self.tokens: list[int] = []
        self.arrays = [np.empty(0, np.int32)] * 4
        self.slots, self.fit = np.full(1 << SLOTS, np.iinfo(np.int64).min), np.zeros(1 << SLOTS, bool)

    def _live(self, state: int) -> list[int]:
        """How many bytes each live position lies back, the farthest first."""
        tail = self.tails[state]
        return [n for n in range(len(tail), 0, -1) if tail[len(tail) - n :] in self.prefixes] + [0]

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``: none for a byte, and (-1, -1) if merges of
        its bytes end elsewhere."""
        if token not in self.made:
            word = self.bytes_of[token]
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                if rank == 1 << 40:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.made[token] = None if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return self.made[token]

    def _fits(self, a: int, b: int) -> bool:
        """Whether ``b`` can follow ``a``; at a word's start, whether merges make ``b`` at all.

        The merges that made the two are undone, the latest first. Whenever the neighbours at the
        seam have a merge of their own that would have come before the one just undone, the seam
        does not last. Of equal ranks the left one comes first."""
        found = self._parts(b) != (-1, -1)
        bytes_of, left, right = self.bytes_of, a, b
        # Merges at the seam count if they come before this rank, or at it from the left.
        before, ties = 1 << 40, False
        while found and left >= 0:
            across = self.ranks.get(bytes_of[left] + bytes_of[right])
            if across is not None and (across < before or ties and across == before):
                found = False
                break
            of_left, of_right = self._parts(left), self._parts(right)
            if of_left is None and of_right is None:
                break
            if of_right is None or of_left is not None and left > right:
                before, ties, left = left, False, of_left[1]
            else:
                before, ties, right = right, True, of_right[0]
        self.pairs[a << 32 | b] = found
        return found

    def _step(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """The next state, and the tokens that may end with this byte, with their sizes."""
        tail = self.tails[state] + _BYTES[byte]
        ends = [tail[i:] for i in range(len(tail))]
        after = next((x for x in ends if x in self.prefixes), b"")
        number = self.numbers.get(after)
        if number is None:
            number = self.numbers[after] = len(self.tails)
            self.tails.append(after)
        found = self.steps[state << 8 | byte] = number, tuple((len(x), self.ranks[x]) for x in ends if x in self.ranks)
        return found

    def _chain(self, lasts: list[int], end: int) -> list[int]:
        """The tokens that lead to ``end``, by the last token of each prefix."""
        out = []
        while end:
            token = lasts[end]
            out.append(token)
            end -= len(self.bytes_of[token])
        out.reverse()
        return out

    def encode(self, word: bytes) -> list[int]:
        """The tokens of one pre-tokenised word."""
        if word in self.ranks:
            return [self.ranks[word]]
        if len(self.steps) > STEPS:
            self.reset()
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        steps, pairs = self.steps, self.pairs
        # The last token of each prefix since ``out``; before the first stands what was emitted last.
        state, out, lasts, at, pause = 0, [], [-1], 0, AHEAD
        for byte in word:
            step = steps.get(state << 8 | byte)
            if step is None:
                step = self._step(state, byte)
            state, ends = step
            at += 1
            for size, token in ends:
                before = lasts[at - size]
                fits = pairs.get(before << 32 | token)
                if fits if fits is not None else self._fits(before, token):
                    lasts.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            if at == pause:
                # Emits what the chains to all live positions share; goes on to the double if nothing is.
                chains = [self._chain(lasts, at - back) for back in self._live(state)]
                shared = 0
                while all(len(c) > shared for c in chains) and len({c[shared] for c in chains}) == 1:
                    shared += 1
                if shared:
                    out += chains[0][:shared]
                    done = sum(len(self.bytes_of[t]) for t in chains[0][:shared])
                    lasts, at = lasts[done:], at - done
                pause = max(2 * at, AHEAD)
        return out + self._chain(lasts, at)


    def _tabled(self, ats: list[int]) -> None:
        """Puts steps into the arrays."""
        for at in ats:
            state, ends = self.steps.get(at) or self._step(at >> 8, at & 255)
            while len(self.step_of) < len(self.tails) << 8:
                self.step_of = np.concatenate([self.step_of, np.full(len(self.step_of), -1, np.int32)])
            self.step_of[at] = len(self.next)
            self.next.append(state)
            self.sizes += [size for size, _ in ends]
            self.tokens += [token for _, token in ends]
            self.first.append(len(self.sizes))
        lists = (self.next, self.first, self.sizes, self.tokens)
        self.arrays = [np.concatenate([a, np.array(x[len(a) :], np.int32)]) for a, x in zip(self.arrays, lists)]

    def _all_fit(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        key = before.astype(np.int64) << 32 | after
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)
        fits = self.fit[slot]
        new = self.slots[slot] != key
        if new.any():
            asked, where = np.unique(key[new], return_inverse=True)
            known = [self.pairs.get(k) for k in asked.tolist()]
            known = np.array([self._fits(k >> 32, k & 0xFFFFFFFF) if f is None else f for k, f in zip(asked.tolist(), known)], bool)
            fits[new] = known[where]
            self.slots[slot[new]], self.fit[slot[new]] = key[new], fits[new]
        return fits

    def encode_all(self, words: list[bytes]) -> list[bytes]:
        """The tokens of each word as the bytes of 32-bit numbers."""
        done: list[bytes] = [b""] * len(words)
        together = []
        for i, w in enumerate(words):
            if w in self.ranks or len(w) >= AHEAD:
                done[i] = struct.pack(f"<{len(ids := self.encode(w))}i", *ids)
            elif w:
                together.append(i)
        if not together:
            return done
        if len(self.steps) > STEPS:
            self.reset()
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        together.sort(key=lambda i: -len(words[i]))
        sizes = np.array([len(words[i]) for i in together])
        n, longest = len(sizes), int(sizes[0])
        read = np.frombuffer(b"".join(words[i].ljust(longest, b"\0") for i in together), np.uint8).reshape(n, longest)
        lasts = np.full((longest + 1, n), -1, np.int32)
        state = np.zeros(n, np.int32)
        for j in range(longest):
            m = int(np.searchsorted(-sizes, -j))  # words with more than j bytes
            at = (state[:m] << 8) | read[:m, j]
            if int(at.max()) >= len(self.step_of) or (self.step_of[at] < 0).any():
                self._tabled([a for a in np.unique(at).tolist() if a >= len(self.step_of) or self.step_of[a] < 0])
            step = self.step_of[at]
            after, first, size_of, token_of = self.arrays
            state[:m] = after[step]
            todo, end, last = np.arange(m), first[step], first[step + 1]
            while len(todo):
                if (end >= last).any():
                    raise ValueError("the vocabulary lacks a byte")
                token = token_of[end]
                fits = self._all_fit(lasts[j + 1 - size_of[end], todo], token)
                lasts[j + 1, todo[fits]] = token[fits]
                todo, end, last = todo[~fits], end[~fits] + 1, last[~fits]
        at, rows, back = sizes.copy(), np.arange(n), []
        while (at > 0).any():
            token = np.where(at > 0, lasts[at, rows], -1)
            at = np.where(at > 0, at - self.length[token], 0)
            back.append(token)
        found = np.stack(back[::-1], axis=1)
        ends = np.cumsum((found >= 0).sum(axis=1)) * 4
        raw = found[found >= 0].astype("<i4").tobytes()
        for i, a, b in zip(together, [0, *ends[:-1].tolist()], ends.tolist()):
            done[i] = raw[a:b]
        return done


class StreamDecoder:
    """Token ids to text, a batch at a time. Bytes of an unfinished character wait for the next
    batch; ill-formed ones become U+FFFD, as in decoding all at once."""

    #: Bytes that a leading byte announces; continuation bytes have 0, others 1.
    NEED = bytes(0 if 0x80 <= b < 0xC0 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 1 for b in range(256))

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.waiting = bytes_of, b""

    def feed(self, ids: list[int]) -> str:
        data = self.waiting + b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(data)
        for back in range(1, min(4, len(data)) + 1):
            need = self.NEED[data[-back]]
            if need:
                cut = len(data) - back if need > back else len(data)
                break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


def _encoder(ranks_path: str, pattern: str):
    """The transducer, and a cache from chunks to the bytes of their 32-bit ids."""
    machine = Transducer(read_ranks(ranks_path))
    words = regex.compile(pattern)

    known: dict[str, bytes] = {}

    def encode(parts: list[str]) -> list[bytes]:
        split = [words.findall(x) for x in parts]
        if len(known) > WORDS:
            known.clear()
        new = list(set(chain.from_iterable(split)).difference(known))
        known.update(zip(new, machine.encode_all([w.encode() for w in new])))
        out = [b"".join(map(known.__getitem__, x)) for x in split]
        for w in new:
            if len(w) > 100:
                del known[w]
        return out

    return machine, Memo(encode, most=400_000)


_READY: dict[tuple[str, str], tuple[Transducer, Memo]] = {}


def _ready(ranks_path: str, pattern: str) -> tuple[Transducer, Memo]:
    key = (ranks_path, pattern)
    if key not in _READY:
        _READY[key] = _encoder(*key)
    return _READY[key]


def _lists(column: pa.ListArray) -> Iterator[list[int]]:
    """The ids of one row at a time; a null row has none."""
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    for i in range(len(column)):
        yield values[at[i] : at[i + 1]].tolist()


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, ids array<int>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, memo = _ready(ranks_path, pattern)
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            ids = list(memo.texts(t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()))
            at = np.cumsum([0] + [len(x) // 4 for x in ids])
            column = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks_path: str, batch_size: int = 4096) -> DataFrame:
    """``doc_id, ids`` -> ``doc_id, text``: the ids decoded as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = StreamDecoder({v: k for k, v in read_ranks(ranks_path).items()})
        for batch in batches:
            texts = []
            for ids in _lists(batch.column(1)):
                parts = [decoder.feed(ids[i : i + batch_size]) for i in range(0, len(ids), batch_size)]
                texts.append("".join(parts) + decoder.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def bpe_round_trip(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, ids`` -> ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    texts = encoded.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {v: k for k, v in read_ranks(ranks_path).items()}
        decimal = {k: str(k) for k in bytes_of}
        decoder = StreamDecoder(bytes_of)
        for batch in batches:
            n, shown, decoded = [], [], []
            for ids in _lists(batch.column(1)):
                n.append(len(ids))
                shown.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                digest = hashlib.sha256()
                for i in range(0, len(ids), 4096):
                    digest.update(decoder.feed(ids[i : i + 4096]).encode())
                digest.update(decoder.close().encode())
                decoded.append(digest.hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(shown, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
