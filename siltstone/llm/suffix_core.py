"""Array helpers of the substring deduplication: anchors of a batch, sorting and comparing suffixes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from siltstone.llm.words import mixed, powers

_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)


class RollingHash:
    """64-bit hashes of any substrings of a byte array."""

    def __init__(self, data: np.ndarray, which: int = 0):
        base = _BASES[which]
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


@dataclass(frozen=True)
class Anchors:
    """owner: text of the batch; place: the anchor; first, last: the windows that choose it (bytes of the batch)."""

    owner: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i : i + width] for every i that has as many (two running minima per block)."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, rolling: RollingHash) -> Anchors:
    """Every window of ``length`` bytes within a text chooses the gram of least hash inside it, the leftmost of equal ones.

    The choice depends on the window's bytes alone, so equal windows choose the same gram.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return Anchors(none, none, none, none)
    at = np.arange(len(data) - gram + 1)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    value = rolling.of(at, at + gram) >> bits << bits | at.astype(np.uint64)
    chosen = (sliding_least(value, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    windows = np.arange(len(chosen))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(chosen)]
    inside = np.flatnonzero(windows + length <= offsets[owner + 1])
    if not len(inside):
        return Anchors(none, none, none, none)
    chosen, owner = chosen[inside], owner[inside]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(chosen)]]) - 1
    return Anchors(owner[begin], chosen[begin], inside[begin], inside[end])


def multikey_order(leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, run) of fixed-size byte strings (n, bytes): run numbers equal strings in sorted order.

    Multikey quicksort with keys of eight bytes: strings that tie so far are the only ones that are
    partitioned by their next key.
    """
    n, size = leads.shape
    padded = np.zeros((n, -(-size // 8) * 8), np.uint8)
    padded[:, :size] = leads
    keys = padded.view(">u8").astype(np.uint64)
    order, run, open_ = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for k in range(keys.shape[1]):
        if not len(open_):
            break
        part = order[open_]
        by = np.lexsort((keys[part, k], run[open_]))
        part, runs = part[by], run[open_]
        order[open_] = part
        key = keys[part, k]
        step = np.concatenate([[True], (runs[1:] != runs[:-1]) | (key[1:] != key[:-1])])
        run[open_] = open_[np.maximum.accumulate(np.where(step, np.arange(len(open_)), 0))]
        alone = step & np.concatenate([step[1:], [True]])
        open_ = open_[~alone]
    return order, run


def repeated_windows(data: np.ndarray, starts: np.ndarray, key: np.ndarray, length: int, rolling: RollingHash) -> np.ndarray:
    """Which windows data[s : s + length] have an equal one among those of the same key; bytes are compared."""
    value = rolling.of(starts, starts + length)
    order = np.lexsort((value, key))
    a, b = order[:-1], order[1:]
    same = np.flatnonzero((key[a] == key[b]) & (value[a] == value[b]))
    found = np.zeros(len(starts), bool)
    span = np.arange(length)
    for at in range(0, len(same), 20_000):
        i, j = a[same[at : at + 20_000]], b[same[at : at + 20_000]]
        equal = (data[starts[i][:, None] + span] == data[starts[j][:, None] + span]).all(axis=1)
        found[i[equal]] = True
        found[j[equal]] = True
    return found
