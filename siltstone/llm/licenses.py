"""Licence scans: winnowed fingerprints pick templates, banded alignment reports what matched.

The templates' winnowed word-gram fingerprints form an inverted index, in which every word-gram of a
text is looked up (so a shared run of gram + window - 1 words has one in common; short notices have short
grams, long texts longer ones and wider windows). A twentieth of a template's fingerprints (one at least) that
agree on nearby diagonals make a candidate, and a banded local alignment of template and text words gives the
matched span and the share of the template's words that it covers. Candidates of one template are aligned
together, a row of all their bands at a time; texts that hold the template word for word need no alignment. Of a LEAST_COVERAGE or more, a match has the template's name, if it also holds the
words that tell the template from its neighbours (version, clause, name); from LEAST_PART on it is reported
as a part. The index is as large as the templates, not the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.common import pieces, utf8_buffer
from siltstone.llm.license_texts import TELLING, TEMPLATES
from siltstone.llm.words import Words, grams, winnowed, words

#: (gram, window) of templates of fewer words than LONG, and of the others.
SHORT_GRAMS, LONG_GRAMS, LONG = (3, 3), (4, 5), 60
#: Words by which an alignment may drift: a quarter of the template's, within these bounds.
BANDS = (6, 24)
LEAST_COVERAGE, LEAST_PART = 0.8, 0.4
#: The share of a template's fingerprints that make a candidate.
LEAST_VOTES = 0.05
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells of bands that are aligned at once.
_CELLS = 1 << 20


@dataclass(frozen=True)
class Index:
    names: tuple[str, ...]
    hashes: tuple[np.ndarray, ...]
    telling: tuple[tuple[np.ndarray, ...], ...]
    votes: tuple[int, ...]
    gram: int
    keys: np.ndarray
    template: np.ndarray
    place: np.ndarray


def _tokens(text: str) -> Words:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]))


def build(templates: Mapping[str, str], telling: Mapping[str, tuple[str, ...]] = TELLING) -> list[Index]:
    """The inverted indexes of short and of long templates, each sorted by fingerprint; a template of fewer words than a gram is left out."""
    sizes = {name: len(_tokens(text).hash) for name, text in templates.items()}
    out = []
    for (gram, window), is_long in ((SHORT_GRAMS, False), (LONG_GRAMS, True)):
        names = tuple(sorted(n for n in templates if (sizes[n] >= LONG) == is_long))
        keys, of, place, hashes, votes = [], [], [], [], []
        for k, name in enumerate(names):
            found = _tokens(templates[name])
            at, value = grams(found, gram)
            kept = winnowed(at, value, found.owner, window)
            keys.append(value[kept].astype(np.uint64))
            place.append(at[kept])
            of.append(np.full(len(kept), k))
            hashes.append(found.hash)
            votes.append(max(1, int(LEAST_VOTES * len(kept))))
        keys, of, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, of, place))
        order = np.argsort(keys, kind="stable")
        marks = tuple(tuple(_tokens(t).hash for t in telling.get(n, ())) for n in names)
        out.append(Index(names, tuple(hashes), marks, tuple(votes), gram, keys[order].astype(np.uint64), of[order], place[order]))
    return out


def _holds(words_of: np.ndarray, run: np.ndarray) -> bool:
    """Whether a run of words occurs among others."""
    at = np.flatnonzero(words_of[: len(words_of) - len(run) + 1] == run[0]) if len(words_of) >= len(run) else ()
    return any((words_of[k : k + len(run)] == run).all() for k in at)


def align(template: np.ndarray, windows: np.ndarray, band: int) -> np.ndarray:
    """(matches, first, end) of the best local alignment in each window, (n, 3).

    A window holds the text's words from ``band`` before the candidate's diagonal to ``band`` after its end, other
    values where the text has none; first and end count from the window's start. Cells are
    whole numbers, score before matched words before first word, so that the best of equal scores matches
    more words, then spans fewer. A row of a band depends on the row before it by plain maxima, and on itself by
    skipped text words, which a running maximum of score plus place finds at once.
    """
    width, point, hit = 2 * band + 1, 1 << 44, (MATCH << 44) + (1 << 24)
    n = len(windows)
    key, best, stop = np.zeros((n, width), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    step = np.arange(width, dtype=np.int64) * -(GAP * point)
    each = np.arange(n)
    for i, word in enumerate(template):
        same = windows[:, i : i + width] == word
        begun = hit + np.arange(i, i + width)
        cell = np.where(same, np.where(key > 0, key + hit, begun), key + MISMATCH * point)
        np.maximum(cell[:, :-1], key[:, 1:] + GAP * point, out=cell[:, :-1])
        cell[cell < point] = 0
        key = np.maximum.accumulate(cell + step, axis=1) - step
        key[key < point] = 0
        at = key.argmax(axis=1)
        top = key[each, at]
        better = top >> 24 > best >> 24
        best, stop = np.where(better, top, best), np.where(better, at + i + 1, stop)
    return np.column_stack([best >> 24 & 0xFFFFF, best & 0xFFFFFF, stop])


def candidates(index: Index, found: Words, begins: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Diagonals (text minus template) on which fingerprints agree and how many do, by (text, template)."""
    at, value = grams(found, index.gram)
    seen = np.zeros(1 << 16, bool)
    seen[(index.keys >> np.uint64(48)).astype(np.int64)] = True
    likely = seen[(value >> np.uint64(48)).astype(np.int64)]
    at, value = at[likely], value[likely]
    low = np.searchsorted(index.keys, value, side="left")
    n = np.searchsorted(index.keys, value, side="right") - low
    entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    word = np.repeat(at, n)
    of, template = found.owner[word], index.template[entry]
    diagonal = word - begins[of] - index.place[entry]
    order = np.lexsort((diagonal, template, of))
    keys = np.column_stack([of, template, diagonal])[order]
    if not len(keys):
        return {}
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    counts, keys = np.diff(np.append(first, len(order))), keys[first]
    pairs = np.flatnonzero(np.concatenate([[True], (keys[1:, :2] != keys[:-1, :2]).any(axis=1)]))
    ends = np.append(pairs[1:], len(keys))
    return {(int(keys[a, 0]), int(keys[a, 1])): (keys[a:b, 2], counts[a:b]) for a, b in zip(pairs.tolist(), ends.tolist(), strict=True)}


def clusters(diagonals: np.ndarray, counts: np.ndarray, reach: int, least: int) -> list[int]:
    """Diagonals with ``least`` fingerprints or more within ``reach``, those with the most first; none within reach of one before it."""
    total = np.concatenate([[0], np.cumsum(counts)])
    votes = total[np.searchsorted(diagonals, diagonals + reach, side="right")] - total[np.searchsorted(diagonals, diagonals - reach, side="left")]
    kept: list[int] = []
    free = votes >= least
    for k in np.lexsort((diagonals, -counts, -votes)).tolist():
        if free[k]:
            kept.append(int(diagonals[k]))
            free[np.searchsorted(diagonals, diagonals[k] - reach) : np.searchsorted(diagonals, diagonals[k] + reach, side="right")] = False
    return kept


def aligned(template: np.ndarray, found: Words, places: list[tuple[int, int, int]], band: int) -> np.ndarray:
    """``align`` of a template with texts at (begin, end, diagonal); first and end are words of ``found``."""
    size = len(template) + 2 * band
    out = np.zeros((len(places), 3), np.int64)
    for low in range(0, len(places), max(1, _CELLS // size)):
        some = places[low : low + max(1, _CELLS // size)]
        begin, end, diagonal = (np.array(x)[:, None] for x in zip(*some, strict=True))
        at = begin + diagonal - band + np.arange(size)
        inside = (at >= begin) & (at < end)
        windows = np.where(inside, found.hash[np.clip(at, 0, len(found.hash) - 1)], _absent(template))
        exact = (windows[:, band : band + len(template)] == template).all(axis=1)
        whole = np.array([len(template), band, band + len(template)])
        own = np.broadcast_to(whole, (len(some), 3)).copy()
        if not exact.all():
            own[~exact] = align(template, windows[~exact], band)
        own[:, 1:] += begin + diagonal - band
        out[low : low + len(some)] = own
    return out


def _absent(template: np.ndarray) -> np.uint64:
    """A value that isn't a word of the template."""
    value = np.uint64(0)
    while (template == value).any():
        value += np.uint64(1)
    return value


def matches(indexes: list[Index], data: np.ndarray, offsets: np.ndarray, least: float = LEAST_COVERAGE, part: float = LEAST_PART) -> dict[int, list[tuple[str, float, int, int, bool]]]:
    """For each text with any: (name, coverage, start byte, end byte, whole) of its matches, in order of place.

    whole: ``least`` of the template and every telling run are there. Overlapping matches stay if they are
    of different templates, unless one lies in a longer one, or is a part that meets a whole one that is no shorter. The
    longest templates come first, and of each the diagonals with the most fingerprints. A diagonal is left out if
    its middle lies in a whole match of the same template, or all of it in one of another: what could come of it
    would not stay.
    """
    found = words(data, offsets)
    begins = np.searchsorted(found.owner, np.arange(len(offsets)))
    out: dict[int, list] = {}
    held: dict[int, list[tuple[int, int]]] = {}
    for index in reversed(indexes):  # the index of long templates is the last
        waiting: dict[int, dict[int, list[int]]] = {}
        for (of, t), (diagonals, counts) in candidates(index, found, begins).items():
            band = _band(index.hashes[t])
            waiting.setdefault(t, {})[of] = clusters(diagonals, counts, band // 2, index.votes[t])[::-1]
        for t, texts in sorted(waiting.items(), key=lambda x: -len(index.hashes[x[0]])):
            template = index.hashes[t]
            band, size = _band(template), len(template)
            taken: dict[int, list[tuple[int, int]]] = {}
            while texts := {of: left for of, left in texts.items() if left}:
                places = []
                for of, left in texts.items():
                    d = left.pop()
                    start = int(begins[of]) + d
                    if not any(a <= start + size // 2 < b for a, b in taken.get(of, ())) and not any(a <= start and start + size <= b for a, b in held.get(of, ())):
                        places.append((of, d))
                bounds = [(int(begins[of]), int(begins[of + 1]), d) for of, d in places]
                for (of, _), (m, first, stop) in zip(places, aligned(template, found, bounds, band).tolist() if places else [], strict=True):
                    if m >= part * size and m >= 3:
                        inside = found.hash[first:stop]
                        whole = m >= least * size and all(_holds(inside, run) for run in index.telling[t])
                        if whole:
                            taken.setdefault(of, []).append((first, stop))
                            held.setdefault(of, []).append((first, stop))
                        out.setdefault(of, []).append((index.names[t], m / size, int(found.start[first]), int(found.end[stop - 1]), whole, m))
    for of, rows in out.items():
        rows = sorted(set(rows), key=lambda x: (x[2], -x[3], -x[1], x[0]))
        rank = lambda x: (x[4], x[3] - x[2], x[5], x[1], x[0])  # noqa: E731  whole, span, words matched, share
        meets = lambda x, y: y[2] < x[3] and x[2] < y[3] if y[4] and not x[4] and y[3] - y[2] >= x[3] - x[2] else y[2] <= x[2] and x[3] <= y[3]
        out[of] = [x[:5] for x in rows if not any(y is not x and meets(x, y) and rank(y) > rank(x) for y in rows)]
    return out


def _band(template: np.ndarray) -> int:
    return min(max(len(template) // 4, BANDS[0]), BANDS[1])


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_matches, licenses, coverage, spans, parts) of every row, from the whole text.

    licenses: the distinct names, sorted, comma-joined. coverage: the largest (0 without a match).
    spans: ``name:start:end:coverage`` by start, comma-joined; code points, end exclusive, coverage in
    per cent rounded down. parts: the same of matches that hold only a part of a template, or not the words
    that tell it from its neighbours; they count in no other column. Null and empty texts match nothing; ids
    may repeat or be null.
    """
    indexes = build(templates)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text="__text"):
            data, offsets = utf8_buffer(batch.column("__text"))
            got = matches(indexes, data, offsets)
            n = batch.num_rows
            count, names, cover, spans, parts = np.zeros(n, np.int64), [""] * n, np.zeros(n), [""] * n, [""] * n
            for of, rows in got.items():
                text = data[offsets[of] : offsets[of + 1]].tobytes()
                place = lambda b, o=offsets[of], t=text: len(t[: b - o].decode("utf-8", "ignore"))
                whole = [x for x in rows if x[4]]
                count[of], names[of], cover[of] = len(whole), ",".join(sorted({x[0] for x in whole})), max((x[1] for x in whole), default=0)
                spans[of], parts[of] = (",".join(f"{x[0]}:{place(x[2])}:{place(x[3])}:{int(100 * x[1])}" for x in rows if x[4] == w) for w in (True, False))
            arrays = [pa.array(count), pa.array(names, pa.string()), pa.array(cover), pa.array(spans, pa.string()), pa.array(parts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [id_col, "n_matches", "licenses", "coverage", "spans", "parts"])

    schema = f"`{id_col}` {kind}, n_matches long, licenses string, coverage double, spans string, parts string"
    return docs.select(id_col, docs[text_col].alias("__text")).mapInArrow(run, schema)
