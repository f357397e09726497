"""Token ids by the tokenizers library, part by part with a bounded cache.

The vocabulary's normaliser and splitter never join text across ASCII white space, so the ids of a
text are the ids of its white-space words in order. Words of ASCII and precomposed Latin-1 letters, digits and
ASCII marks are already normal but for their case; their pre-tokens (runs of letters, single digits, runs of marks)
go to the library's model directly. All others (other scripts, apostrophes, control characters, special-token
strings) go whole through the library's pipeline.

Texts are cut some megabytes at a time, as bytes in numpy; Arrow numbers the distinct parts and finds those that are
known. The library sees each of them once for as long as the cache holds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Distinct parts of words that a worker keeps; about 40 bytes each.
CACHE_WORDS = 1_000_000
#: Bytes of text that are cut at a time, about; a word is never cut. The parts of SLICES of them are looked up together.
SLICE_BYTES, SLICES = 1 << 22, 4
_WHITE = b" \t\n\v\f\r"
_CUT = re.compile(rb"[ \t-\r]")
#: Byte-level alphabet: bytes that aren't printable (in Latin-1) stand as characters from 256 on, in their order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_ALPHABET = "".join(chr(b if b in _PRINTABLE else 256 + _OTHERS.index(b)) for b in range(256))
#: Kinds of bytes. Latin-1 letters are 0xC3 and a byte below 0xC0; all other multi-byte characters begin with an odd byte.
_LETTER, _DIGIT, _MARK, _SPACE = range(4)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = _LETTER
_KIND[0x80:] = _LETTER
_KIND[list(b"0123456789")] = _DIGIT
_KIND[list(_WHITE)] = _SPACE
_ODD = np.zeros(256, np.uint8)
_ODD[[k for k in range(33) if k not in _WHITE]] = 1
_ODD[[*b"'<|\x7f", 0xC0, 0xC1, 0xC2, *range(0xC4, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KIND, _ODD, _LOWER = _KIND.tobytes(), _ODD.tobytes(), _LOWER.tobytes()  # for bytes.translate


def _parts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, odd, body, offsets) of the parts of words in bytes of UTF-8: where each starts and whether it is a word
    for the whole pipeline; their bytes without white space, lower-cased but in odd words, and n + 1 offsets there."""
    plain, kinds = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(_KIND), np.uint8)
    odd = np.frombuffer(bytearray(data).translate(_ODD), bool)
    body = np.frombuffer(bytearray(data).translate(_LOWER, _WHITE), np.uint8)
    inside = kinds != _SPACE
    place = np.cumsum(inside, dtype=np.int32)  # of a byte in body, from 1
    latin = np.flatnonzero(plain == 0xC3) + 1
    second = plain[latin]
    body[place[latin[second < 0x9F]] - 1] += 0x20
    odd[latin[(second == 0x97) | (second == 0xB7)]] = True  # multiplication and division signs
    start = kinds == _DIGIT
    start[:1] = True
    start[1:] |= kinds[1:] != kinds[:-1]
    start &= inside
    there = np.flatnonzero(odd)
    if len(there):
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        words = np.flatnonzero(head)
        strange = np.unique(np.searchsorted(words, there, side="right") - 1)
        ends = place[np.append(words, len(data))[strange + 1] - 1] - place[words[strange]]  # bytes after the first
        whole = _spread(words[strange], ends + np.int64(1))
        odd[whole] = True
        start[whole] = False
        start[words[strange]] = True
        body[place[whole] - 1] = plain[whole]
    starts = np.flatnonzero(start)
    return starts, odd[starts], body, np.append(place[starts] - np.int32(1), np.int32(len(body)))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(len(out))
    return out


class _Slice(NamedTuple):
    """Some megabytes of text: the distinct parts, which of them are odd, which is where, and the first part of each text."""

    distinct: pa.Array
    whole: np.ndarray
    of: np.ndarray
    heads: np.ndarray


class WordEncoder:
    """Encodes texts with a vocabulary file whose pre-tokens never hold white space."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        """Release the cache, for what the worker does next."""
        self.known = pa.array([], pa.binary())  # part k has ids[ends[k] : ends[k + 1]]
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, simple: pa.Array, whole: pa.Array) -> None:
        """Numbers and ids for parts that aren't known yet."""
        ids, counts = [self.ids], []
        for at in range(0, len(simple), 10_000):
            some = simple.slice(at, 10_000).cast(pa.string()).to_pylist()
            found = [self.model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_ALPHABET)) for p in some]
            counts += map(len, found)
            ids.append(np.fromiter((t.id for part in found for t in part), np.uint32))
        for at in range(0, len(whole), 10_000):
            some = whole.slice(at, 10_000).cast(pa.string()).to_pylist()
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            counts += map(len, found)
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
        self.known = pa.concat_arrays([self.known, simple, whole])
        self.ids = np.concatenate(ids)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.array(counts, np.int64))])

    def _numbers(self, distinct: pa.Array, whole: np.ndarray) -> np.ndarray:
        """The number of each part, new ones included; whole: which are words for the whole pipeline."""
        number = pc.index_in(distinct, self.known).fill_null(-1).to_numpy().copy()
        new = number < 0
        if new.any():
            simple, whole = np.flatnonzero(new & ~whole), np.flatnonzero(new & whole)
            number[simple] = len(self.known) + np.arange(len(simple))
            number[whole] = len(self.known) + len(simple) + np.arange(len(whole))
            self._learn(distinct.take(pa.array(simple)), distinct.take(pa.array(whole)))
        return number

    def _cut(self, texts: list[bytes]) -> _Slice:
        data = b" ".join(texts)
        data.decode()  # what isn't UTF-8 is an error
        starts, odd, body, offsets = _parts(data)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        of, whole = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), bool)
        whole[of[odd]] = True
        return _Slice(coded.dictionary, whole, of, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])))

    def _encode(self, slices: list[_Slice]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of each slice, and how many each of its texts has."""
        coded = pa.concat_arrays([s.distinct for s in slices]).dictionary_encode()
        of, whole = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), bool)
        whole[of] = np.concatenate([s.whole for s in slices])  # a part with odd bytes is so wherever it is
        number = self._numbers(coded.dictionary, whole)[of]
        lengths = self.ends[number + 1] - self.ends[number]
        at = 0
        for s in slices:
            to = at + len(s.distinct)
            own = lengths[at:to][s.of]
            ids = self.ids[_spread(self.ends[number[at:to]][s.of], own)]
            before = np.concatenate([[0], np.cumsum(own)])
            yield ids, np.diff(before[s.heads])
            at = to
        if len(self.known) > CACHE_WORDS:
            self.forget()

    def encode_all(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts one after the other, ``end_id`` after each if there is one, and how many each text has."""
        counts, found = np.zeros(len(texts), np.int64), []
        slices, some, of, owners, size = [], [], [], [], 0

        def cut() -> None:
            slices.append(self._cut(some))
            owners.append(of)

        def flush() -> None:
            for own, (ids, n) in zip(owners, self._encode(slices), strict=True):
                found.append(ids)
                np.add.at(counts, own, n)

        for k, text in enumerate(texts):
            at = 0
            while at < len(text):
                stop = _CUT.search(text, at + SLICE_BYTES) if len(text) - at > SLICE_BYTES else None
                to = stop.start() if stop else len(text)
                some.append(text[at:to])
                of.append(k)
                size += to - at
                at = to
                if size >= SLICE_BYTES:
                    cut()
                    some, of, size = [], [], 0
                    if len(slices) == SLICES:
                        flush()
                        slices, owners = [], []
        if some:
            cut()
        if slices:
            flush()
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        if end_id is None:
            return ids, counts
        ends = np.cumsum(counts) + np.arange(len(counts))
        out = np.empty(len(ids) + len(counts), np.uint32)
        kept = np.ones(len(out), bool)
        kept[ends] = False
        out[kept], out[ends] = ids, end_id
        return out, counts + 1

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0].astype("<u4").tobytes()


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@contextmanager
def encoder(path: str, keep: bool = False) -> Iterator[WordEncoder]:
    """The worker's encoder of a vocabulary file; its cache is released at the end, unless the worker's next task of a kind
    is to find it."""
    found = _encoder(path)
    try:
        yield found
    finally:
        if not keep:
            found.forget()
