"""Adaptive context-mixing range coder for token ids: independently reset blocks of interleaved lanes.

A block is coded on its own from a fresh model. Its ids are dealt to lanes, a stretch of the block each,
and step t codes the t-th id of every lane as one numpy operation; all lanes of a block share and update
one model, so a block learns from all of its ids.

Three predictions are mixed into one distribution, with weights that are learned as the block goes on,
for each class of how often the two contexts were seen:

* order 2: the ids that followed the same two ids, counted in SLOTS2 slots,
* order 1: the ids that followed the same id, counted in SLOTS1 slots,
* order 0: how often each id of the alphabet occurred.

An id that one of the contexts predicts has the mixed mass of both; any other has its order-0 share of
the rest. Weights move towards what each prediction contributed to the ids coded (expectation
maximisation), and order 0 keeps a part, so that every id of the alphabet can be coded at any time.

All masses are integers that sum to 2^24. Each lane's arithmetic coder has a range of 48 bits and emits 16-bit
words; carries are settled once a block is coded. Encoder and decoder make the same steps.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block, and lanes that a full block has; shorter blocks have a lane for LEAST_STEPS ids.
BLOCK, LANES, LEAST_STEPS = 1 << 20, 2048, 256
SLOTS1, SLOTS2 = 12, 1
GROUP = 4  # blocks that are coded side by side, to share numpy's calls; nothing in the files depends on it
HASH_BITS = 18
TOTAL_BITS, ZERO_BITS = 24, 20
_COUNT_BITS = 11
_COUNT = (1 << _COUNT_BITS) - 1
_EVERY = 8  # steps between two refreshes of the order-0 sums
_LEARN = 8  # steps between two that the weights learn from
_LEAST_ZERO = 1 / 15
_RATE = 0.02
_SEEN = 1 << 12
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MASK32, _BITS16, _BITS32 = np.uint64(0xFFFFFFFF), np.uint64(16), np.uint64(32)
#: The most ids that an alphabet may have: each keeps a share of order 0.
ALPHABET_LIMIT = 1 << (ZERO_BITS - 1)


def _classes(edges: tuple[int, ...]) -> np.ndarray:
    return np.searchsorted(np.array(edges), np.arange(_SEEN), side="right")


_SLOTS = SLOTS1 + SLOTS2
_SLOT_BITS = 4  # a count and a slot's number within its table fit 15 bits
_NUMBERS8 = np.arange(_SLOTS, dtype=np.uint8)[:, None]
_NUMBERS16 = np.concatenate([np.arange(SLOTS2, dtype=np.int16), np.arange(SLOTS1, dtype=np.int16)])[:, None]
_PARTS = (slice(0, SLOTS2), slice(SLOTS2, _SLOTS))
_NONE = 255
_TILE = 16  # steps that are turned from lanes to steps at a time
_CLASSES = 6 * 9
_CLASS2, _CLASS1 = _classes((1, 2, 3, 5, 9)), _classes((1, 3, 7, 15, 31, 63, 127, 255))


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b of whole numbers below 2^48 and 2^26 whose quotient is below 2^25, by doubles, which divide faster: a quotient
    that isn't whole is 2^-26 from the next whole number or further, and its rounding moves it by 2^-29 at most."""
    return np.divide(a, b, dtype=np.float64).astype(np.int64)


class _Model:
    """The models of some blocks, side by side: lanes and rows of a block follow those of the block before.

    Slots hold an id (from 1; 0 is empty) above a count of _COUNT_BITS; a context is a row of slots. Blocks share no
    row, class or sum. Arrays are (slots, lanes) and as narrow as their values allow, as each operation reads them from
    the cache.
    """

    def __init__(self, alphabet: int, lanes: list[int]):
        blocks = len(lanes)
        block = np.repeat(np.arange(blocks), lanes)
        self.tables = [np.zeros((blocks << HASH_BITS, SLOTS2), np.int32), np.zeros((blocks * (alphabet + 1), SLOTS1), np.int32)]
        self.zero = np.ones((blocks, alphabet + 1), np.int64)  # from the second column on
        self.coded: list[np.ndarray] = []  # what ``zero`` doesn't count yet
        self.weights = np.tile(np.array([0.2, 0.3, 0.5]), (blocks * _CLASSES, 1))
        self.hashed, self.classed, self.row = block << HASH_BITS, (block * _CLASSES).astype(np.int32), block * (alphabet + 1)
        self.apart = block << ZERO_BITS + 1  # sums of a block, plus this, are above all of the blocks before
        self.spread = np.arange(blocks)[:, None] << ZERO_BITS + 1
        self.last = np.zeros(len(block), np.int64)
        self.before = np.zeros(len(block), np.int64)
        self.lanes = np.arange(len(block))
        self.steps = self.n = 0
        self.refresh()

    def refresh(self) -> None:
        """Order-0 sums, scaled to 2^ZERO_BITS; each id keeps one at least."""
        n = self.zero.shape[1] - 1
        if self.coded:
            self.zero += 24 * np.bincount(np.concatenate(self.coded), minlength=self.zero.size).reshape(self.zero.shape)
            self.coded = []
        sums = np.zeros_like(self.zero)
        np.cumsum(self.zero[:, 1:], axis=1, out=sums[:, 1:])
        self.sums = _quotient(sums * ((1 << ZERO_BITS) - n), sums[:, -1:]) + np.arange(n + 1)
        self.keys = (self.sums + self.spread).reshape(-1)

    def _room(self, n: int) -> None:
        """Arrays for n lanes, kept from step to step."""
        self.n = n
        self.found, self.ids, self.mass, self.ends, self.wide = (np.empty((_SLOTS, n), np.int32) for _ in range(5))
        self.mass2, self.shared = np.empty((SLOTS2, n), np.int32), np.empty((SLOTS2, n), np.int32)
        self.counts, self.order = np.empty((_SLOTS, n), np.int16), np.empty((_SLOTS, n), np.int16)
        self.match, self.number = np.empty((_SLOTS, n), bool), np.empty((_SLOTS, n), np.uint8)
        self.seen, self.kinds, self.first = np.empty((2, n), np.int32), np.empty((2, n), np.uint8), np.empty((2, n), np.uint8)
        self.lane = self.lanes[:n]

    def predict(self, n: int) -> None:
        """For the first n lanes: ids and masses (slots, lanes), their running sums, and what is left for order 0."""
        if n != self.n:
            self._room(n)
        last, before = self.last[:n], self.before[:n]
        hashed = ((before.view(np.uint64) << np.uint64(24)) + last.view(np.uint64)) * _MUL >> np.uint64(64 - HASH_BITS)
        self.rows = [hashed.view(np.int64) + self.hashed[:n], last + self.row[:n]]
        for table, rows, part in zip(self.tables, self.rows, _PARTS, strict=True):
            taken = table.take(rows, axis=0)
            for k, out in enumerate(self.found[part]):
                out[:] = taken[:, k]
        np.right_shift(self.found, _COUNT_BITS, out=self.ids)
        counts = np.bitwise_and(self.found, _COUNT, out=self.wide)
        self.counts[:] = counts
        some = np.greater(self.counts, 0, out=self.match).view(np.uint8)
        for k, part in enumerate(_PARTS):
            np.add.reduce(counts[part], axis=0, dtype=np.int32, out=self.seen[k])
            np.add.reduce(some[part], axis=0, dtype=np.uint8, out=self.kinds[k])
        self.set = _CLASS2.take(self.seen[0], mode="clip") * np.int32(9) + _CLASS1.take(self.seen[1], mode="clip")
        self.set += self.classed[:n]
        share = self.weights[:, :2].T.take(self.set, axis=1)
        share *= 1 << TOTAL_BITS
        whole = np.multiply(self.kinds, 0.5, dtype=np.float64)
        whole += self.seen
        whole += 0.5
        share /= whole
        mass1 = self.mass[SLOTS2:]
        for part, own, out in zip(_PARTS, share.astype(np.int32), (self.mass2, mass1), strict=True):
            np.multiply(counts[part], own, out=out)
        for k in range(SLOTS2):  # shared: what order 1 adds to the ids that order 2 has too
            match, number = self.match[SLOTS2:], self.number[SLOTS2:]
            np.equal(self.ids[SLOTS2:], self.ids[k], out=match)
            np.subtract(match.view(np.uint8), np.uint8(1), out=number)
            number |= _NUMBERS8[SLOTS2:]
            slot = np.minimum.reduce(number, axis=0)
            both = np.flatnonzero(slot != _NONE)  # of several slots that match all are empty
            at = slot.take(both).astype(np.int64) * n + both
            self.shared[k] = 0
            self.shared[k, both] = self.mass.take(at)
            self.mass.reshape(-1)[at] = 0
        np.add(self.mass2, self.shared, out=self.mass[:SLOTS2])
        self.ends[0] = self.mass[0]
        for k in range(1, _SLOTS):
            np.add(self.ends[k - 1], self.mass[k], out=self.ends[k])
        self.rest = (1 << TOTAL_BITS) - self.ends[-1].astype(np.int64)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the ids coded."""
        np.equal(self.ids, ids.astype(np.int32), out=self.match)
        number = np.subtract(self.match.view(np.uint8), np.uint8(1), out=self.number)
        number |= _NUMBERS8
        for k, part in enumerate(_PARTS):
            np.minimum.reduce(number[part], axis=0, out=self.first[k])
        slot = np.minimum(*self.first)
        at = np.minimum(slot, np.uint8(_SLOTS - 1)).astype(np.int64) * self.n + self.lane
        size = self.mass.take(at) * (slot != _NONE)
        self.placed = ids + self.row[: self.n]
        low = self.sums.take(self.placed - 1) * self.rest >> ZERO_BITS
        high = self.sums.take(self.placed) * self.rest >> ZERO_BITS
        no_slot = (size == 0).astype(np.int64)
        start = self.ends.take(at) - size
        return start + (self.ends[-1] + low - start) * no_slot, size + (high - low) * no_slot

    def lookup(self, value: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold these values."""
        value = value.astype(np.int32)
        below = np.less_equal(self.ends[:-1], value, out=self.match[:-1]).view(np.uint8)
        slot = np.add.reduce(below, axis=0, dtype=np.uint8)
        ids = self.ids.take(slot.astype(np.int64) * self.n + self.lane).astype(np.int64)
        other = np.flatnonzero(value >= self.ends[-1])
        inner = (value[other] - self.ends[-1, other]).astype(np.int64)
        share = _quotient((inner + 1 << ZERO_BITS) - 1, self.rest[other]) + self.apart[other]
        both = np.sort(share << 32 | other)  # neighbours in order are found faster
        other = both & 0xFFFFFFFF
        ids[other] = np.searchsorted(self.keys, both >> 32, side="right") - self.row[other]
        return ids

    def learn(self, match: np.ndarray) -> None:
        """Move the weights of the classes seen towards what each prediction contributed."""
        hit = match[:SLOTS2]
        two, one = (self.mass2 * hit).sum(axis=0), (self.mass[SLOTS2:] * match[SLOTS2:]).sum(axis=0) + (self.shared * hit).sum(axis=0)
        whole = np.maximum(two + one, 1)
        many = np.bincount(self.set, minlength=len(self.weights))
        some = np.flatnonzero(many)
        rate = 1 - (1 - _RATE) ** np.minimum(many[some], 32)
        for k, own in enumerate((two / whole, one / whole)):
            mean = np.bincount(self.set, own, len(self.weights))[some] / many[some]
            self.weights[some, k] += rate * (mean - self.weights[some, k])
        self.weights[some, 2] = 1 - self.weights[some, 0] - self.weights[some, 1]
        lack = np.maximum(_LEAST_ZERO - self.weights[some, 2], 0)
        self.weights[some, :2] *= ((1 - self.weights[some, 2] - lack) / np.maximum(1 - self.weights[some, 2], 1e-9))[:, None]
        self.weights[some, 2] += lack

    def update(self, ids: np.ndarray) -> None:
        n = len(ids)
        if self.steps < 64 or self.steps % _LEARN == 0:
            self.learn(self.match)
        fresh = (ids << _COUNT_BITS).astype(np.int32) + np.int32(1)
        order = np.left_shift(self.counts, _SLOT_BITS, out=self.order)
        order |= _NUMBERS16
        # The slot of the id, else the one of the least count. No numpy.where: its branches cost more than the sums.
        there = self.first != _NONE
        slot = np.empty((2, n), np.uint8)
        for part, own in zip(_PARTS, slot, strict=True):
            least = np.minimum.reduce(order[part], axis=0)
            least &= np.int16((1 << _SLOT_BITS) - 1)
            own[:] = least + np.int16(part.start)
        slot |= -there.view(np.uint8)
        slot = np.minimum(slot, self.first).astype(np.int64)
        entry = self.found.take(slot * n + self.lane)
        count = entry & _COUNT
        more, often = there & (count < _COUNT), count > 1
        entry += more.view(np.int8) - (often > there).view(np.int8)
        entry ^= (entry ^ fresh) & -(~(there | often)).view(np.int8).astype(np.int32)
        for table, rows, own, part, new in zip(self.tables, self.rows, slot, _PARTS, entry, strict=True):
            table.reshape(-1)[rows * table.shape[1] + (own - part.start)] = new
        self.coded.append(self.placed)
        self.before[:n] = self.last[:n]
        self.last[:n] = ids
        self.steps += 1
        if self.steps < 64 or self.steps % _EVERY == 0:
            self.refresh()


def _shape(n: int) -> tuple[int, int]:
    """(lanes, steps) of a block of n ids; only the last lane may have fewer."""
    steps = -(-n // max(1, min(LANES, n // LEAST_STEPS)))
    return -(-n // steps), steps


def _lanes(sizes: list[int]) -> tuple[list[int], int, list[int]]:
    """(lanes of each block, steps, lanes that have an id at each step) of blocks of which only the last may be shorter."""
    shapes = [_shape(n) for n in sizes]
    lanes, (own, last) = [x for x, _ in shapes], shapes[-1]
    short, steps = sizes[-1] - last * (own - 1), shapes[0][1]
    return lanes, steps, [sum(lanes) - (own if t >= last else t >= short) for t in range(steps)]


def _groups(sizes: list[int]) -> list[slice]:
    """Blocks that are coded side by side: GROUP of those whose lanes are all of one length, and a shorter last one that
    takes no more steps. Others are coded alone."""
    if not sizes:
        return []
    lanes, steps = _shape(sizes[0])
    some = GROUP if lanes * steps == sizes[0] else 1
    even = len(sizes) - (sizes[-1] < sizes[0])
    found = [slice(at, min(at + some, even)) for at in range(0, even, some)]
    if even < len(sizes):
        fits = lanes * steps == sizes[0] and _shape(sizes[-1])[1] <= steps
        found[-1:] = [slice(found[-1].start, len(sizes))] if fits else [found[-1], slice(even, len(sizes))]
    return found


def _encode_blocks(parts: list[np.ndarray], alphabet: int) -> list[bytes]:
    lanes, steps, active = _lanes([len(p) for p in parts])
    columns, first = np.zeros((steps, sum(lanes)), np.int32), 0
    for part, n in zip(parts, lanes, strict=True):
        own = _shape(len(part))[1]
        padded = np.zeros(n * own, np.int32)
        padded[: len(part)] = part
        for t in range(0, own, _TILE):
            columns[t : min(t + _TILE, own), first : first + n] = padded.reshape(n, own)[:, t : t + _TILE].T
        first += n
    model = _Model(alphabet, lanes)
    low, size = np.zeros(first, np.uint64), np.full(first, 1 << 48, np.uint64)
    width = 2 * steps + 4
    words, at = np.zeros(first * width, np.uint32), np.arange(first)  # the k-th words of all lanes lie together
    for x, n in zip(columns, active, strict=True):
        x = x[:n].astype(np.int64)
        model.predict(n)
        start, freq = model.interval(x)
        r = size[:n] >> np.uint64(TOTAL_BITS)
        low[:n] += r * start.view(np.uint64)
        size[:n] = r * freq.view(np.uint64)
        out = np.flatnonzero(size[:n] <= _MASK32)
        while len(out):
            emitted, place, wide = low[out], at[out], size[out] << _BITS16
            words[place] = emitted >> _BITS32
            at[out] = place + first
            low[out] = (emitted & _MASK32) << _BITS16
            size[out] = wide
            out = out[wide <= _MASK32]
        model.update(x)
    for _ in range(3):
        words[at] = low >> _BITS32
        at += first
        low = (low & _MASK32) << _BITS16
    used, found, across, first = at // first, [], first, 0
    for n in lanes:
        own = used[first : first + n]
        place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        flat = words[place * across + np.repeat(np.arange(first, first + n), own)]
        while (carry := flat >> np.uint32(16)).any():
            flat &= np.uint32(0xFFFF)
            flat[:-1] += carry[1:]
        found.append(own.astype("<u2").tobytes() + flat.astype("<u2").tobytes())
        first += n
    return found


def _decode_blocks(parts: list[bytes], sizes: list[int], alphabet: int) -> list[np.ndarray]:
    lanes, steps, active = _lanes(sizes)
    begins, words, first = [], [], 0
    for data, n in zip(parts, lanes, strict=True):
        used = np.frombuffer(data, "<u2", n).astype(np.int64)
        begins.append(first + np.cumsum(used) - used)
        words.append(np.frombuffer(data, "<u2", offset=2 * n))
        first += len(words[-1])
    words, at = np.concatenate([*words, np.zeros(3, np.uint16)]), np.concatenate(begins)
    code = words[at].astype(np.uint64) << _BITS32 | words[at + 1].astype(np.uint64) << _BITS16 | words[at + 2]
    at += 3
    size = np.full(len(at), 1 << 48, np.uint64)
    model = _Model(alphabet, lanes)
    out = np.zeros((steps, len(at)), np.int32)
    for t, n in enumerate(active):
        model.predict(n)
        r = size[:n] >> np.uint64(TOTAL_BITS)
        value = np.minimum(_quotient(code[:n].view(np.int64), r.view(np.int64)), (1 << TOTAL_BITS) - 1)
        x = model.lookup(value)
        start, freq = model.interval(x)
        code[:n] -= r * start.view(np.uint64)
        size[:n] = r * freq.view(np.uint64)
        more = np.flatnonzero(size[:n] <= _MASK32)
        while len(more):
            place, wide = at[more], size[more] << _BITS16
            code[more] = code[more] << _BITS16 | words.take(place, mode="clip")
            at[more] = place + 1
            size[more] = wide
            more = more[wide <= _MASK32]
        model.update(x)
        out[t, :n] = x
    found, first = [], 0
    for count, n in zip(sizes, lanes, strict=True):
        own = _shape(count)[1]
        ids = np.empty((n, own), np.int32)
        for t in range(0, own, _TILE):
            ids[:, t : t + _TILE] = out[t : min(t + _TILE, own), first : first + n].T
        found.append(ids.reshape(-1)[:count])
        first += n
    return found


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, ascending, and the place of each id among them, from 1."""
    most = int(ids.max(initial=0))
    if most < max(1 << 20, len(ids)):  # a table of all ids up to the largest
        there = np.zeros(most + 1, bool)
        there[ids] = True
        return np.flatnonzero(there).astype(ids.dtype), np.cumsum(there)[ids]
    alphabet, dense = np.unique(ids, return_inverse=True)
    return alphabet, dense.reshape(-1).astype(np.int64) + 1


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, list[bytes]]:
    """(alphabet, blocks): the ids that occur, ascending, and each block of ``block`` ids coded over them."""
    alphabet, dense = _numbered(ids)
    if len(alphabet) > ALPHABET_LIMIT or block > BLOCK:
        raise ValueError(f"{len(alphabet)} different ids, blocks of {block}; {ALPHABET_LIMIT} and {BLOCK} are the most")
    parts = [dense[at : at + block] for at in range(0, len(ids), block)]
    return alphabet, [data for some in _groups([len(p) for p in parts]) for data in _encode_blocks(parts[some], len(alphabet))]


def decode(alphabet: np.ndarray, blocks: list[bytes], count: int, block: int = BLOCK) -> np.ndarray:
    """The ``count`` ids that ``encode`` made these blocks of."""
    if not count:
        return np.zeros(0, np.uint32)
    sizes = [min(block, count - k * block) for k in range(len(blocks))]
    parts = [ids for some in _groups(sizes) for ids in _decode_blocks(blocks[some], sizes[some], len(alphabet))]
    return alphabet.astype(np.uint32)[np.concatenate(parts) - 1]


def checksum(data: bytes) -> int:
    return zlib.crc32(data)
