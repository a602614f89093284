"""Words of a byte string as 64-bit hashes, in numpy: a polynomial hash by prefix sums, so that no word is a Python object."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 5
#: Bytes that are hashed at a time.
STEP = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse; kept by the worker."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(max(n, STEP) - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def letters(is_word: np.ndarray, seed: int = 20_171) -> np.ndarray:
    """A random odd number for each byte that belongs to words, zero for the others."""
    return np.where(is_word, np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.uint64(0))


def hash_words(buf: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every maximal run of bytes that ``letter`` gives a number."""
    inside = (letter != 0)[buf]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    h = np.empty(len(start), np.uint64)
    first = at = 0
    while first < len(start):  # in steps that end at a word's end; a longer word is a step of its own
        last = max(first + 1, int(np.searchsorted(end, at + STEP, "right")))
        stop = int(end[last - 1])
        up, down = _powers(stop - at)
        total = np.r_[np.uint64(0), np.cumsum(letter[buf[at:stop]] * up, dtype=np.uint64)]
        h[first:last] = (total[end[first:last] - at] - total[start[first:last] - at]) * down[start[first:last] - at]
        first, at = last, stop
    return mix(h), start, end
