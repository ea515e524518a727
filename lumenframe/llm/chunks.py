"""Texts cut where every public pre-tokenizer pattern cuts too, so that pieces can be encoded
once and reused. A cut stands before a space that follows a character other than white space:
no token of those patterns spans such a place, and none looks across it.

All cutting and matching is done with numpy on the bytes of many texts at once. Chunks of one slice
are matched by a 64-bit hash, and then compared byte by byte with the first of theirs: should one differ, the
slice is matched by the bytes alone. What is kept from slice to slice is found by the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

from lumenframe.llm.shingles import _DOWN, _UP, mix

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: White space beyond ASCII, as the numbers of its two and three UTF-8 bytes.
_WHITE2 = np.array([0xC285, 0xC2A0])
_WHITE3 = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
_BYTE = np.random.default_rng(20250301).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cuts(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Where chunks of ``data`` begin, ``starts`` of texts included, and the end."""
    raw = np.frombuffer(data, np.uint8)
    begins = raw == 32
    begins[:1] = False
    at = np.flatnonzero(begins)
    before = raw[at - 1]
    white = _WHITE[before]
    far = np.flatnonzero(before >= 0x80)
    if len(far):
        place = at[far]
        two = (raw[place - 2].astype(np.int64) << 8) | raw[place - 1]
        three = (raw[np.maximum(place - 3, 0)].astype(np.int64) << 16) | two
        white[far] |= np.isin(two, _WHITE2) | np.isin(three, _WHITE3)
    begins[at[white]] = False
    begins[starts[starts < len(raw)]] = True
    return np.append(np.flatnonzero(begins), len(raw))


def chunks(text: str) -> list[str]:
    """Pieces whose concatenation is ``text``."""
    data = text.encode()
    at = cuts(data, np.zeros(1, np.int64)).tolist()
    return [data[a:b].decode() for a, b in zip(at, at[1:])]


def matched(data: bytes, at: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal chunks, and the number of each chunk's set; equal chunks have equal ``key``."""
    _, first, where = np.unique(key, return_index=True, return_inverse=True)
    if (size[first][where] == size).all():
        raw = np.frombuffer(data, np.uint8)
        shift = (at[:-1][first][where] - at[:-1]).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        if (raw[np.arange(at[0], at[-1], dtype=shift.dtype) + np.repeat(shift, size)] == raw[at[0] : at[-1]]).all():
            return first, where
    number: dict[bytes, int] = {}
    where = np.array([number.setdefault(data[a:b], len(number)) for a, b in zip(at.tolist(), at[1:].tolist())], np.int64)
    return np.unique(where, return_index=True)[1], where


class Memo:
    """A cache of an encoder's results for chunks: bytes of 32-bit ids. Texts are cut by slices, and
    a slice's new chunks are encoded together. When more than ``most`` chunks are held, those that
    only one slice had go first, so a worker's memory stays bounded and frequent chunks stay; what
    is gone is encoded again."""

    #: Bytes of texts that are cut at a time, unless one text alone is longer.
    SLICE = 1_000_000

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 500_000, longest: int = 200):
        self.encode, self.most, self.longest = encode, most, longest
        self.held: dict[bytes, bytes] = {}
        self.once: set[bytes] = set()

    def texts(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """The joined results of each UTF-8 text's chunks, in order."""
        waiting: list[bytes] = []
        size = 0
        for text in texts:
            waiting.append(text)
            size += len(text)
            if size >= self.SLICE:
                yield from self._slice(waiting)
                waiting, size = [], 0
        yield from self._slice(waiting)

    def _slice(self, texts: list[bytes]) -> Iterator[bytes]:
        data = b"".join(texts)
        if not data:
            yield from (b"" for _ in texts)
            return
        text_at = np.cumsum([0, *map(len, texts)])
        at = cuts(data, text_at)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * _UP.upto(len(data))[: len(data)], out=total[1:])
        size = np.diff(at)
        key = mix((total[at[1:]] - total[at[:-1]]) * _DOWN.upto(len(data))[at[:-1]] + size.astype(np.uint64))
        first, where = matched(data, at, size, key)
        keys = [data[a:b] for a, b in zip(at[first].tolist(), (at[first] + size[first]).tolist())]
        held = self.held
        new = [k for k in keys if k not in held]
        self.once.difference_update(keys)
        held.update(zip(new, self.encode([k.decode() for k in new])))
        found = [held[k] for k in keys]
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begin = np.frombuffer(b"".join(found), "<u4"), np.cumsum(n) - n
        # Every occurrence's ids, one after another, and where each text's end.
        each = n[where]
        ends = np.cumsum(each)
        ids = flat[np.repeat(begin[where] - (ends - each), each) + np.arange(ends[-1])].tobytes()
        text_ends = np.concatenate([[0], ends])[np.searchsorted(at[:-1], text_at)] * 4
        for a, b in zip(text_ends.tolist(), text_ends[1:].tolist()):
            yield ids[a:b]
        self._forget(new)

    def _forget(self, new: list[bytes]) -> None:
        held = self.held
        self.once.update(new)
        for x in new:
            if len(x) > self.longest:
                del held[x]
                self.once.discard(x)
        if len(held) > self.most:
            for x in self.once:
                del held[x]
            self.once.clear()
        if len(held) > self.most:
            held.clear()
