"""Content-defined positions of byte strings, in numpy.

Of the grams in a window of bytes the one with the least hash is the window's anchor. Equal windows have
their anchor at the same place, so equal strings meet at equal anchors although few positions are kept.
"""

from __future__ import annotations

import numpy as np

from .wordhash import _grown, mix

_VALUES = np.random.default_rng(20240301).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch of the bytes follows."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _grown(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def stretch(total: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from start to stop, as signed numbers."""
    inverse = _grown(len(total))[1]
    return mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64)).view(np.int64)


def window_anchors(total: np.ndarray, at: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, first start, last start) of the runs of `size`-byte windows that share an anchor.

    at: offsets of the rows; windows that run over a row's end are none.
    """
    none = np.zeros(0, np.int64)
    n = len(total) - 1
    starts_in = np.maximum(np.diff(at) - size + 1, 0)
    if not starts_in.any():
        return none, none, none, none
    grams = np.arange(n - gram + 1)
    value = stretch(total, grams, grams + gram).view(np.uint64)
    place, width, span = grams.astype(np.int32), 1, size - gram + 1
    while width < span:
        step = min(width, span - width)
        m = len(value) - step
        better = value[step:] < value[:m]
        value = np.where(better, value[step:], value[:m])
        place = np.where(better, place[step:], place[:m])
        width += step
    row = np.repeat(np.arange(len(starts_in)), starts_in)
    start = np.repeat(at[:-1] - (np.cumsum(starts_in) - starts_in), starts_in) + np.arange(len(row))
    anchor = place[start].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([new[1:], [len(row)]]) - 1
    return row[new], anchor[new], start[new], start[last]
