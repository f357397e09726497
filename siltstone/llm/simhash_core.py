"""Per-text SimHash fingerprints: a small helper that runs inside Arrow batches."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

#: Bits of a fingerprint.
BITS = 64
_SEED = 42
_BLOCK = 1 << 16


def shingles(text: bytes, width: int) -> list[bytes]:
    """Word shingles of an ASCII-lower-cased text, repeats included.

    Words are runs of bytes other than space and tab..carriage return. A text of fewer than
    ``width`` words (but not none) is one shingle; a text without words has none.
    """
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [joined]
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps[: len(words) - width] + 1]).tolist()
    ends = np.concatenate([gaps[width - 1 :], [len(joined)]]).tolist()
    return [joined[a:b] for a, b in zip(starts, ends, strict=True)]


def fingerprint(text: bytes | None, width: int) -> int:
    """The signed 64-bit SimHash: a bit is 1 if set in over half of the shingles' XXH64."""
    parts = shingles(text or b"", width)
    if not parts:
        return 0
    hashes = np.array([xxh64_intdigest(x, _SEED) for x in parts], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    packed = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(packed.view(np.int64)[0])
