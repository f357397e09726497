"""Language identification by language-bitmask n-gram filters.

Training collects, per language, the character n-grams that a fixed share of its sampled documents
contains, and enters them into one bit-sliced Bloom filter: each slot holds a bitmask with a bit per
language, and the AND of an n-gram's slots is the set of languages that contain it. A text is decided
by the popcount of each language over its n-grams, corrected for the filter's false positives:
with n n-grams, h hits and a false-positive rate f of a language, the estimate is (h - f n) / (1 - f).
The language with the largest estimate wins.

The filter is fitted on a bounded sample of labelled rows (about ``per_language`` documents each); every text is then scored whole. Labels, sources and ids are no
inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import pieces, utf8_buffer

SIZES = (3, 4)
SLOT_BITS = 18
PROBES = 2
#: Odd multipliers of the hash functions, one per probe.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
PER_LANGUAGE = 1500
_OWNER_SHIFT = 40
LEAST_SHARE = 0.01
UNKNOWN = "und"
#: Bytes of text that are made n-grams of at once, and n-grams that are looked up at once.
PIECE, BLOCK = 1 << 18, 1 << 16

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = 32
_FOLD[91:97] = 32
_FOLD[123:128] = 32


@dataclass(frozen=True)
class LanguageFilter:
    """slots: (words of 64 languages, slots); bit k % 64 of word k // 64 belongs to languages[k]; rates: each language's false-positive rate."""

    languages: tuple[str, ...]
    slots: np.ndarray
    rates: np.ndarray


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, owners): the texts with one blank for any run of other ASCII, and the number of each byte's text."""
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    out = _FOLD[data]
    blank = out == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1] | (owner[1:] != owner[:-1])
    keep[:1] = True
    return out[keep], owner[keep]


def grams(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, owners), BLOCK at a time: the n-grams of each text and the text's number in the batch.

    Bytes are folded to letters with one blank for any run of other ASCII; no n-gram spans two texts.
    """
    f, of = folded(data, offsets)
    for at in range(0, len(f) - size + 1, BLOCK):
        n = min(BLOCK, len(f) - size + 1 - at)
        code = np.full(n, size, np.uint64)
        for k in range(size):
            code = (code << np.uint64(8)) | f[at + k : at + k + n]
        whole = of[at : at + n] == of[at + size - 1 : at + size - 1 + n]
        yield code[whole], of[at : at + n][whole]


def slots_of(codes: np.ndarray, probe: int) -> np.ndarray:
    return ((codes * np.uint64(_MULTIPLIERS[probe])) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageFilter:
    """Learn from rows with text and a language. No such row: a filter that knows no language.

    The sample is about ``per_language`` rows (whole texts) of each language, picked by a hash of the text
    against the language's number of rows, so no row is sorted or moved for it; equal texts of a language count as two at most. The list of languages is
    small (a name for each); every 64 of them take one bitmask word of 2 MB. The n-grams are counted on the executors, and only those in ``LEAST_SHARE`` of a language's sample
    reach the driver.
    """
    known = docs.where(F.col(lang_col).isNotNull() & (F.col(text_col) != ""))
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageFilter((), np.zeros((1, 1 << SLOT_BITS), np.uint64), np.zeros(0))
    of = lambda values: F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col("lang")]
    rows = known.where(F.pmod(F.xxhash64("text"), of(sizes)) < per_language)
    rows = rows.groupBy("lang", F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.first("text").alias("text"), F.least(F.count("*"), F.lit(2)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            data, offsets = utf8_buffer(batch.column("text"))
            names, copies = np.array(batch.column("lang").to_pylist(), object), batch.column("copies").to_numpy()
            for size in SIZES:
                parts = [np.unique(of.astype(np.uint64) << np.uint64(_OWNER_SHIFT) | code) for code, of in grams(data, offsets, size)]
                once = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))  # a code has fewer bits than that
                code, of = once & np.uint64((1 << _OWNER_SHIFT) - 1), (once >> np.uint64(_OWNER_SHIFT)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names[of], pa.string()), pa.array(code.view(np.int64)), pa.array(copies[of])], ["lang", "code", "copies"])

    counts = rows.select("lang", "text", "copies").mapInArrow(run, "lang string, code long, copies long").groupBy("lang", "code").agg(F.sum("copies").alias("count"))
    least = F.greatest(F.lit(2), F.round(LEAST_SHARE * of({k: min(n, per_language) for k, n in sizes.items()})))
    learned = counts.where(F.col("count") >= least).select("lang", "code").toPandas()
    slots = np.zeros((-(-len(languages) // 64), 1 << SLOT_BITS), np.uint64)
    for k, language in enumerate(languages):
        codes = learned["code"][learned["lang"] == language].to_numpy(np.int64).view(np.uint64)
        for p in range(PROBES):
            slots[k // 64, slots_of(codes, p)] |= np.uint64(1 << k % 64)
    full = np.array([np.mean(slots[k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(languages))])
    return LanguageFilter(languages, slots, full**PROBES)


def score_batch(model: LanguageFilter, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, languages): the corrected share of each text's n-grams that each language contains."""
    n = len(offsets) - 1
    hits, total = np.zeros((n, len(model.languages))), np.zeros(n)
    for size in SIZES:
        for codes, of in grams(data, offsets, size):
            at = [slots_of(codes, p) for p in range(PROBES)]
            total += np.bincount(of, minlength=n)
            for word, slots in enumerate(model.slots):
                mask = np.bitwise_and.reduce([slots[a] for a in at])
                for k in range(64 * word, min(64 * word + 64, len(model.languages))):
                    hits[:, k] += np.bincount(of[(mask >> np.uint64(k % 64) & np.uint64(1)).astype(bool)], minlength=n)
    return np.clip((hits - model.rates * total[:, None]) / np.maximum((1 - model.rates) * total[:, None], 1e-9), 0, 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def predict(docs: DataFrame, model: LanguageFilter, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns, the predicted language and its score (0 to 1) of every row, the latter two under ``names``.

    ``und`` with score 0 if a text is null or has no letter, or if the model knows no language; texts
    too short for an n-gram get the first language with score 0. Ties go to the first language in
    alphabetical order. The score is the share of the text's n-grams that the winner contains. ``keep``
    must not hold ``names``; the text itself is carried once, whether it is kept or not.
    """
    if {*keep} & {*names}:
        raise ValueError(f"{sorted({*keep} & {*names})} would stand twice; choose other names")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [*keep, *([text_col] if text_col not in keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches, PIECE, text_col):
            texts = batch.column(text_col)
            data, offsets = utf8_buffer(texts)
            readable = np.array([has_letter(x) for x in texts.to_pylist()]) & bool(model.languages)
            if model.languages:
                share = score_batch(model, data, offsets)
                best = share.argmax(axis=1)
                score = np.where(readable, share[np.arange(len(share)), best], 0.0)
                found = np.where(readable, np.array(model.languages, object)[best], UNKNOWN)
            else:
                score, found = np.zeros(batch.num_rows), np.full(batch.num_rows, UNKNOWN, object)
            own = [batch.column(n) for n in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep) + f", `{names[0]}` string, `{names[1]}` double"
    return docs.select(*columns).mapInArrow(run, schema)
