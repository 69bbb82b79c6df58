"""Hashes of word shingles, in numpy over the bytes of a whole text."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64)
_POWERS: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64. Those of up to a million bytes stay with the worker process."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = max(n, 1 << 14)
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        made.append(np.multiply.accumulate(x))
    if size <= 1 << 20:
        _POWERS[:] = made
    return made[0], made[1]


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted hashes of a text's different word shingles. Words as in simhash; a text of fewer than `width` words is one shingle.

    Hashes are polynomials over the bytes between two places, out of one running sum, and mixed.
    """
    raw = np.frombuffer(text.encode("utf-8", "replace").lower() if text else b"", np.uint8)
    blank = _BLANK[raw]
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # one blank after each word
    line, blank = raw[keep], blank[keep]
    if len(line) and blank[-1]:
        line, blank = line[:-1], blank[:-1]
    if not len(line):
        return np.empty(0, np.int64)
    gaps = np.flatnonzero(blank)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(line)]
    more = min(width, len(starts)) - 1
    starts, ends = starts[: len(starts) - more], ends[more:]
    up, down = _powers(len(line))
    values = _BYTES[line]
    values[blank] = _BYTES[32]
    values *= up[: len(line)]
    sums = np.r_[np.uint64(0), np.cumsum(values)]
    out = mixed((sums[ends] - sums[starts]) * down[starts])
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]].view(np.int64)
