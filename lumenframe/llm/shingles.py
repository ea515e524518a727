"""Word shingles of texts as sorted arrays of 64-bit hashes, computed with numpy a batch at a time.

Words are maximal runs of characters other than the six ASCII white-space bytes; A-Z count as
a-z. UTF-8 bytes above 127 are never white space, so all work is done on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_PLACES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that one numpy pass works on, unless one text alone is longer.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64, as many as were needed so far."""

    def __init__(self, base: int):
        self.base, self.all = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.all) < n:
            steps = np.full(max(n, CHUNK + 1), self.base, np.uint64)
            steps[0] = 1
            self.all = np.multiply.accumulate(steps)
        return self.all


_UP, _DOWN = _Powers(_BASE), _Powers(_BASE_INVERSE)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The start offset and the hash of each word of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~_SPACE[raw]
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _UP.upto(len(raw))[: len(raw)], out=total[1:])
    value = (total[end] - total[start]) * _DOWN.upto(len(raw))[start]
    return start, mix(value + (end - start).astype(np.uint64))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles; of a text with
    fewer words, the one hash of all its words; without words, none."""
    for a, b in _chunks(texts):
        part = texts[a:b]
        start, words = word_hashes(b"\n".join(part))
        cuts = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in part]))
        whole = max(0, len(words) - width + 1)
        total = np.zeros(whole, np.uint64)
        for k in range(width):
            total += words[k : k + whole] * _PLACES[k]
        total = mix(total)
        for i in range(len(part)):
            lo, hi = cuts[i], cuts[i + 1]
            n = hi - lo
            if n >= width:
                yield np.unique(total[lo : hi - width + 1])
            elif n:
                yield mix((words[lo:hi] * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
            else:
                yield np.empty(0, np.uint64)
