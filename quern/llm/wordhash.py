"""Hashes of words and of runs of words for a whole slice of texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What a word is made of after lower-casing: digits, a-z and all beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each row) of rows that lie in `data` from at[i] to at[i+1]."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    low = LOWER[data]
    inside = WORD_BYTE[low]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse = _grown(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[low] * power, out=total[1:])
    hashes = mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(start, at))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; the last k-1 have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _STEP + hashes[j : j + n]
    return mix(out ^ np.uint64(k))


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    size, out = 1, values
    while size < w:
        step = min(size, w - size)
        out = np.minimum(out[: len(out) - step], out[step:])
        size += step
    return out


def winnowed(grams: np.ndarray, row_of: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions whose gram is the least (ties included) of w consecutive grams of one row.

    row_of: the row of each word; a gram or window that runs over a row's end counts as none.
    """
    n = len(grams)
    if n < w:
        return np.zeros(0, np.int64)
    least = window_minima(grams, w)
    whole = row_of[: len(least)] == row_of[w + k - 2 : w + k - 2 + len(least)]
    least = np.where(whole, least, np.uint64(0))
    padded = np.zeros(n + w - 1, np.uint64)
    padded[w - 1 : w - 1 + len(least)] = least
    most = padded[:n].copy()
    for j in range(1, w):
        np.maximum(most, padded[j : j + n], out=most)
    return np.flatnonzero((most == grams) & (most > 0))
