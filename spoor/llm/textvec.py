"""Hashes of all words of a text at once, in numpy."""

from __future__ import annotations

import numpy as np

STEP = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``STEP`` and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for at, base in enumerate((int(STEP), pow(int(STEP), -1, 1 << 64))):
            steps = np.full(size, np.uint64(base), np.uint64)
            steps[0] = 1
            _POWERS[at] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes with every bit well spread."""
    h = h * MIX
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, gap: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of ``data``, words being runs without ``gap``.

    ``data`` holds bytes as uint64 and begins and ends with ``gap``. A word's hash is the
    sum of its bytes times powers of ``STEP``: a difference of running sums, brought to a
    common start by the inverse power.
    """
    blank = data == gap
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    stops = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up, dtype=np.uint64, out=sums[1:])
    return (sums[stops] - sums[starts]) * down[starts], starts, stops
