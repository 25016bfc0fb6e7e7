"""Words and word shingles of whole texts as 64-bit hashes, computed for a block of documents at a time."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Words of a shingle.
WORDS = 5
#: White space that parts words: space and the five control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.random.default_rng(5).integers(1 << 62, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n, inverse = 1 << bits, pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and for each document the index of its first word (one more at the end)."""
    n = len(data)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.ones(n, bool)
    before[1:] = ~solid[:-1]
    after = np.ones(n, bool)
    after[:-1] = ~solid[1:]
    start = np.flatnonzero(solid & (before | edge[:n]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word with A-Z lower-cased: a polynomial in its bytes, read off one running sum."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(max(20, int(len(data)).bit_length()))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * up[: len(data)], out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """For each document its distinct shingles, ascending: all runs of five words; with fewer, the whole sequence; without words, none."""
    start, end, first = words(data, offs)
    h = word_hashes(data, start, end)
    n = len(h) - WORDS + 1
    s = np.zeros(max(n, 0), np.uint64)
    for k in range(WORDS) if n > 0 else ():
        s += h[k : k + n] * _MIX[k]
    s = mix(s)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            x = np.sort(s[a : b - WORDS + 1])
            keep = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            out.append(mix((h[a:b] * _MIX[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
