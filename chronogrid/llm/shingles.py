"""Word-shingle sets of texts as sorted 64-bit hashes, vectorised over batches.

Words are runs of characters other than space and U+0009 to U+000D, with A-Z
lower-cased.  A text's set holds its distinct runs of ``width`` words; a text
with fewer words has its whole sequence as the only element; without words, or
null, the set is empty.

A word's hash is a polynomial over its UTF-8 bytes modulo 2**64, taken from
prefix sums over a whole block of documents, so that no Python code runs per
word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shared import BLANKS

#: Bytes of text hashed at once; a longer document makes its own block.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in BLANKS]] = True
_TURN = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK)
        up = np.full(n, _BASE, np.uint64)
        down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def _block(data: np.ndarray, ends: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sets of the documents that lie back to back in ``data``."""
    n = len(data)
    starts = np.concatenate(([0], ends[:-1]))
    if n:
        word = ~_BLANK[data]
        edge = np.zeros(n + 1, bool)
        edge[starts] = True
        edge[n] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power_tables(n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:n])))
        h = scramble((sums[b] - sums[a]) * down[a])
    else:
        a, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lo, hi = np.searchsorted(a, starts), np.searchsorted(a, ends)
    m = len(h) - width + 1
    runs = np.zeros(max(m, 0), np.uint64)
    for j in range(width if m > 0 else 0):
        runs += h[j : j + m] * _TURN[j]
    runs = scramble(runs)
    for i, k in zip(lo, hi):
        if k - i >= width:
            yield np.unique(runs[i : k - width + 1])
        elif k > i:
            yield scramble((h[i:k] * _TURN[32 : 32 + k - i]).sum(keepdims=True) + np.uint64(k - i))
        else:
            yield runs[:0]


def sets_of(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """One sorted array of distinct uint64 hashes for each text."""
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    _, where, chars = texts.buffers()
    ends = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(chars, np.uint8) if chars is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1)
        j = min(j, len(texts))
        yield from _block(data[ends[i] : ends[j]], ends[i + 1 : j + 1] - ends[i], width)
        i = j
