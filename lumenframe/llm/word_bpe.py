"""BPE over words with end marks, by tree concatenation, and decoding.

What the merges may not cross splits a text into words; a word is unsplit text. One longer than
``LEAF`` symbols is halved until its leaves are short, the leaves are merged by rank, and
neighbours are joined up the tree: the last tokens of the left and the first of the right make a
window, which is merged anew from its symbols. If the window still begins with the left's token and ends
with the right's, both sides agree; else the window grows to twice as many tokens. That is exact: merges by rank
give a row of tokens if and only if they give each two neighbours of it as they are, since a merge
across two of them would show in these two alone. Every two neighbours lie inside one side, or in
the window.

A word longer than ``PIECE`` symbols becomes rows of that many symbols, which Spark deals over all
tasks; the rows of one text then meet to be joined, window by window. All other texts are encoded
where they are read, and a worker keeps the ids of frequent words.

The splitting follows the tokenizer file: special tokens of the text first, then NFC, lower case of each
character, and the file's pattern. A file that asks for other steps is refused. Editions of Unicode
differ in what newer characters are, so a text with a character outside long settled ranges is split
by the library's own normalizer and pattern.

Defined results: a null text is an empty one, without tokens; strings of special tokens become
those tokens; rows that repeat are encoded one by one; a null id stays null; an empty table gives
an empty result; a word of any length is encoded whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Symbols of the leaves of a tree, and of a row of a long word.
LEAF, PIECE = 24, 16_384
#: Words, and runs between blanks, whose ids a worker keeps, and the longest of them.
WORDS, LONGEST = 300_000, 100
#: Ids and rows that are passed on at a time.
IDS, ROWS = 2_000_000, 2_000
#: A character becomes at most so many bytes when it is composed and lower-cased.
SPREAD = 12

#: Pairs and steps hold ids in their low 20 bits; a pair without a merge comes after all ranks.
_ID, _NONE = (1 << 20) - 1, 1 << 60
_STEPS = ["NFC", "Replace", "Lowercase"]
#: Characters outside the ranges on which all editions of Unicode agree.
_UNSETTLED = regex.compile("[^\0-\u0527\u2000-\u206F\u3041-\u3096\u30A0-\u30FF\u4E00-\u9FA5\uAC00-\uD7A3]")


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it can be seen, else one past 255."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    unseen = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}
    return [unseen.get(b, chr(b)) for b in range(256)]


class WordBpe:
    """The vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, suffix = file["model"], file["model"]["end_of_word_suffix"]
        steps = [x["type"] for x in file["normalizer"]["normalizers"]]
        split, level = file["pre_tokenizer"]["pretokenizers"]
        asked = (steps, split["type"], split["behavior"], split["invert"], level["type"], level["use_regex"], level["add_prefix_space"], file["post_processor"], file["decoder"])
        if asked != (_STEPS, "Split", "Removed", True, "ByteLevel", False, False, None, None) or model["continuing_subword_prefix"] or model["byte_fallback"]:
            raise ValueError(f"{path} asks for steps that are not built")
        vocabulary = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.texts = {i: t for t, i in (vocabulary | self.special).items()}
        letters = byte_letters()
        if len(vocabulary) + len(self.special) > _ID:
            raise ValueError("the vocabulary is too large")
        self.inner = [vocabulary[c] for c in letters]
        self.final = [vocabulary[c + suffix] for c in letters]
        #: Both ids of a pair as one number -> the rank of their merge and the id of what it makes, as one number.
        self.merges: dict[int, int] = {}
        made: dict[str, int] = {}
        self.symbols: dict[int, list[int]] = {i: [i] for i in self.inner + self.final}
        for rank, (a, b) in enumerate(map(tuple, model["merges"])):
            if made.get(a, -1) >= rank or made.get(b, -1) >= rank:
                raise ValueError("a merge comes before those of its parts")
            i, x, y = vocabulary[a + b], vocabulary[a], vocabulary[b]
            made[a + b] = rank
            self.merges[x << 20 | y] = rank << 20 | i
            self.symbols[i] = self.symbols[x] + self.symbols[y]
        self.words = regex.compile(split["pattern"]["Regex"])
        self.path, self.library = path, None
        #: The same pattern for ASCII texts.
        self.plain_words = re.compile(split["pattern"]["Regex"].replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    def merge(self, ids: list[int]) -> list[int]:
        """Merges by rank, places of equal rank from left to right."""
        ids, get = list(ids), self.merges.get
        steps = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while steps:
            low = min(steps)
            if low == _NONE:
                break
            i = steps.index(low)
            new = low & _ID
            ids[i : i + 2] = [new]
            del steps[i]
            if i:
                steps[i - 1] = get(ids[i - 1] << 20 | new, _NONE)
            if i < len(steps):
                steps[i] = get(new << 20 | ids[i + 1], _NONE)
        return ids

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' text, from theirs."""
        if not left or not right:
            return left + right
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            window = self.encode([s for i in a + b for s in self.symbols[i]], halve=len(a) + len(b) < len(left) + len(right))
            # Where a side is whole there is nothing outside it to agree with.
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def encode(self, symbols: list[int], halve: bool = True) -> list[int]:
        """Symbols of unsplit text -> ids. The leaves are merged, then joined level by level."""
        if len(symbols) <= LEAF or not halve:
            return self.merge(symbols)
        level = [self.merge(symbols[i : i + LEAF]) for i in range(0, len(symbols), LEAF)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def symbols_of(self, word: str) -> list[int]:
        raw = word.encode()
        ids = list(map(self.inner.__getitem__, raw))
        ids[-1] = self.final[raw[-1]]
        return ids

    def split(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """``(special id, following words)`` in the order of the text; at first the id is None."""
        at, mark = 0, None
        if not any(map(text.__contains__, self.special)):
            yield None, self._words(text)
            return
        for found in self.marks.finditer(text):
            yield mark, self._words(text[at : found.start()])
            at, mark = found.end(), self.special[found[0]]
        yield mark, self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain_words.findall(text.lower())
        if _UNSETTLED.search(text):
            self.library = self.library or Tokenizer.from_file(self.path)
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in found]
        # Python's lower() looks at the letters around a capital sigma, the file's step at none.
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


class _Held(dict):
    """Ids of texts as bytes, made when first asked for. When ``WORDS`` are held, those not asked for
    since the time before go; long ones are never kept."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.before = make, {}

    def __missing__(self, text: str) -> bytes:
        found = self.before.get(text) or self.make(text)
        if len(text) <= LONGEST:
            if len(self) >= WORDS:
                self.before = dict(self)
                self.clear()
            self[text] = found
        return found


class Encoder:
    """A ``WordBpe`` with the ids of frequent words, and of frequent runs between blanks: no step looks
    across a space or a line feed, and no special token holds one."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)
        self.words = _Held(lambda word: array("I", self.bpe.encode(self.bpe.symbols_of(word))).tobytes())
        self.runs = _Held(self._make_run)

    def _make_run(self, run: str) -> bytes:
        if run.isascii() and not any(map(run.__contains__, self.bpe.special)):
            found = self.bpe.plain_words.findall(run.lower())
            return self.words[found[0]] if len(found) == 1 else b"".join(map(self.words.__getitem__, found))
        return b"".join(x for x, _ in self._run(run))

    def _run(self, text: str, piece: int | None = None) -> Iterator[tuple[bytes | None, str]]:
        for mark, words in self.bpe.split(text):
            if mark is not None:
                yield mark.to_bytes(4, "little"), ""
            for word in words:
                if piece and len(word) * 4 > piece and len(word.encode()) > piece:
                    yield None, word
                else:
                    yield self.words[word], ""

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.runs.__getitem__, text.replace("\n", " ").split(" ")))

    def parts(self, text: str, piece: int) -> Iterator[tuple[bytes | None, str]]:
        """Runs of ids, ``(bytes, "")``; a word of more than ``piece`` symbols comes as ``(None, word)``."""
        done: list[bytes] = []
        for run in text.replace("\n", " ").split(" "):
            if len(run) * SPREAD <= piece:
                done.append(self.runs[run])
                continue
            for ids, word in self._run(run, piece):
                if ids is not None:
                    done.append(ids)
                else:
                    yield b"".join(done), ""
                    yield None, word
                    done = []
        yield b"".join(done), ""


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _texts(column: pa.Array) -> Iterator[str]:
    return (x.as_py() or "" for x in column)


def _out(rows: Iterable[tuple[int | None, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of ``doc_id, ids`` with a bounded number of both, unless one row alone has more."""
    keys, ids, size = [], [], 0

    def batch() -> pa.RecordBatch:
        at = np.cumsum([0] + [len(x) // 4 for x in ids])
        column = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), column], ["doc_id", "ids"])

    for key, found in rows:
        keys.append(key)
        ids.append(found)
        size += len(found) // 4
        if size >= IDS or len(keys) >= ROWS:
            yield batch()
            keys, ids, size = [], [], 0
    if keys:
        yield batch()


def word_bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """One row per input row: ``doc_id, ids array<int>``."""
    # A run without blanks may hold a word of more than ``piece`` symbols.
    open_run = F.coalesce(F.col("text").rlike(f"[^\\x20\\x09-\\x0D]{{{piece // SPREAD + 1}}}"), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            yield from _out(zip(batch.column(0).to_pylist(), map(encoder.ids, _texts(batch.column(1)))))

    plain = rows.where(~open_run).mapInArrow(whole, "doc_id long, ids array<int>")
    return plain.unionByName(_encode_long(rows.where(open_run), tokenizer_path, piece))


def _encode_long(rows: DataFrame, tokenizer_path: str, piece: int) -> DataFrame:
    """Texts with a long word: its pieces are rows of their own, then meet by the text's row."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2))):
                out, seq, word_no = [], 0, 0
                for ids, word in encoder.parts(text, piece):
                    if ids is not None:
                        out.append((row, doc_id, seq, -1, ids))
                        seq += 1
                        continue
                    symbols = np.array(encoder.bpe.symbols_of(word), "<u4")
                    for k in range(0, len(symbols), piece):
                        out.append((row, doc_id, seq, word_no, symbols[k : k + piece].tobytes()))
                        seq += 1
                    word_no += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["row", "doc_id", "seq", "word", "data"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(tokenizer_path).bpe
        for batch in batches:
            data = [x.as_py() if w < 0 else np.array(bpe.encode(np.frombuffer(x.as_py(), "<u4").tolist()), "<u4").tobytes() for w, x in zip(batch.column(3).to_pylist(), batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(data, pa.binary())], batch.schema.names)

    def meet(group: pa.Table) -> pa.Table:
        bpe = _encoder(tokenizer_path).bpe
        group = group.sort_by("seq")
        done: list[bytes] = []
        words, datas = group["word"].to_pylist(), group["data"]
        i = 0
        while i < len(words):
            if words[i] < 0:
                done.append(datas[i].as_py())
                i += 1
                continue
            level = []
            while i < len(words) and (not level or words[i] == words[i - 1]):
                level.append(np.frombuffer(datas[i].as_py(), "<u4").tolist())
                i += 1
            while len(level) > 1:
                level = [bpe.join(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
            done.append(np.array(level[0], "<u4").tobytes())
        return pa.Table.from_batches(list(_out([(group["doc_id"][0].as_py(), b"".join(done))])))

    shape = "row long, doc_id long, seq long, word int, data binary"
    dealt = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(deal, shape)
    # Without long words there is nothing to deal: an empty shuffle.
    return dealt.repartition("row", "seq").mapInArrow(encode, shape).groupBy("row").applyInArrow(meet, "doc_id long, ids array<int>")


def _id_rows(column: pa.ListArray) -> Iterator[list[int]]:
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    for i in range(len(column)):
        yield values[at[i] : at[i + 1]].tolist()


def word_bpe_decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, ids`` -> ``doc_id, text``: the tokens' own texts, joined by a space, as for a file without a decoder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _encoder(tokenizer_path).bpe.texts
        for batch in batches:
            found = [" ".join([texts[i] for i in ids]) for ids in _id_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def word_bpe_round_trip(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, ids`` -> ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = {i: t.encode() for i, t in _encoder(tokenizer_path).bpe.texts.items()}
        decimal = {i: str(i).encode() for i in texts}
        for batch in batches:
            n, shown, decoded = [], [], []
            for ids in _id_rows(batch.column(1)):
                n.append(len(ids))
                shown.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest())
                decoded.append(hashlib.sha256(b" ".join(map(texts.__getitem__, ids))).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(shown, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
