"""Content-defined anchors: any two equal windows of a sequence hold the same anchor at the same place.

The anchor of a window is the least of its grams by hash, the leftmost of equals. It depends on the window's content
alone, so equal windows have equal anchors wherever they are, and windows need to be compared only where anchors are equal.
Successive windows mostly share an anchor: a *span* is a run of windows with one anchor.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(items: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` items (uint64)."""
    h, size, p = items, 1, _BASE
    out, done = None, 0
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    left = gram
    with np.errstate(over="ignore"):
        while left:  # gram as a sum of powers of two
            if left & 1:
                n = len(items) - gram + 1
                part = h[done : done + n]
                out = part if out is None else out * power(size) + part
                done += size
            left >>= 1
            if left:
                h = h[:-size] * power(size) + h[size:]
                size *= 2
        out = out ^ (out >> np.uint64(29))
        out = out * _MIX
        return out ^ (out >> np.uint64(32))


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[: len(keys) - (width - size)], keys[width - size :]) if width > size else keys


def spans(items: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a sequence of uint64 items: starts and ends (of window starts), anchor positions and anchor hashes of its spans.

    Works in overlapping blocks, so memory beyond the sequence itself is constant.
    """
    total = len(items) - window + 1
    if total <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    width = window - gram + 1
    found = []
    for at in range(0, total, BLOCK):
        part = items[at : min(at + BLOCK, total) + window - 1]
        h = gram_hashes(part, gram)
        keys = ((h >> np.uint64(48)).astype(np.int64) << 16 | np.arange(len(h))).astype(np.int64)
        place = _sliding_min(keys, width) & 0xFFFF
        new = np.flatnonzero(np.diff(place, prepend=-1))
        found.append((new + at, np.append(new[1:], len(place)) + at, place[new] + at, h[place[new]]))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.clip(starts, 0, n), 1)
    np.add.at(change, np.clip(ends, 0, n), -1)
    return np.cumsum(change[:-1]) > 0
