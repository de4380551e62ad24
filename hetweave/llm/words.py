"""Words of whole Arrow batches as numpy arrays: no Python object for each word."""

from __future__ import annotations

import numpy as np

#: Bytes that make up words once A-Z are lower case: 0-9, a-z and all of non-ASCII UTF-8.
IN_WORD = np.zeros(256, bool)
IN_WORD[ord("0") : ord("9") + 1] = IN_WORD[ord("a") : ord("z") + 1] = IN_WORD[128:] = True
#: Bytes between ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    had = _powers.get(int(base))
    if had is None or len(had) < n:
        with np.errstate(over="ignore"):
            had = np.full(max(n, _BLOCK + 1), base, np.uint64)
            had[0] = 1
            had = np.multiply.accumulate(had)
        _powers[int(base)] = had
    return had[:n]


def find_words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, where words of `letters` start and end, and the number of words before each row."""
    data = LOWER[data]
    inside = letters[data]
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]  # a row's first word starts anew even beside the last row's word
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return data, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash, never 0, of each word, by differences of a running polynomial sum."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, low + _BLOCK, side="right")))
            size = int(ends[to - 1] - low)
            total = np.zeros(size + 1, np.uint64)
            np.cumsum((data[low : low + size].astype(np.uint64) + np.uint64(1)) * _power(_BASE, size), out=total[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            h = (total[e] - total[s]) * _power(_UNBASE, size)[s]
            h ^= h >> np.uint64(32)
            h *= _MIX
            h ^= h >> np.uint64(29)
            out[at:to] = h
            at = to
    out[out == 0] = 1
    return out


def hash_shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` word hashes, row borders aside; fewer words give none."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out *= _BASE
            out += words[k : k + n]
            out ^= out >> np.uint64(29)
        out *= _MIX
        out ^= out >> np.uint64(32)
    return out
