"""Words of a batch of texts as arrays: where each stands, whose it is and a 64-bit hash of it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII letters and digits and all bytes of other characters make words.
_IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


@dataclass(frozen=True)
class Words:
    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of a well-known mixing function)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of word bytes, lower-cased A-Z; none spans two texts. Positions are bytes of ``data``."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return Words(none, none, none, np.zeros(0, np.uint64))
    inside = _IN_WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate([inside[1:], [False]])
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)))])
    back = powers(_INVERSE, len(data))
    value = mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    return Words(np.searchsorted(offsets, start, side="right") - 1, start, end, value)


def grams(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``size`` words within one text."""
    n = len(found.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value = value * np.uint64(_BASE) + found.hash[k : n + k]
    at = np.flatnonzero(found.owner[:n] == found.owner[size - 1 :])
    return at, mixed(value[at])


def winnowed(at: np.ndarray, value: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Indexes of the grams kept: the smallest (rightmost of equal ones) of every window of one text.

    A text with fewer grams than a window keeps its smallest one.
    """
    n = len(at)
    if not n:
        return np.zeros(0, np.int64)
    keep = np.zeros(n, bool)
    best = np.arange(n)
    for k in range(1, window):
        other = np.minimum(np.arange(n) + k, n - 1)
        same = owner[at[other]] == owner[at]
        best = np.where(same & (value[other] <= value[best]), other, best)
    last = np.flatnonzero(np.concatenate([owner[at[1:]] != owner[at[:-1]], [True]]))
    first = np.concatenate([[0], last[:-1] + 1])
    whole = np.arange(n) + window - 1 <= np.repeat(last, last - first + 1)
    whole[first] = True  # the only window of a short text
    keep[best[whole]] = True
    return np.flatnonzero(keep)
