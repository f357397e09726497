"""Fill-in-the-middle: texts cut in three at token borders, the middle moved to the end.

Run-length class encoding: a text is stored as its maximal runs of one character class, with the number of
units before each. A run of ASCII letters is one unit; every other code point is a unit of its own, and its
class is its width in UTF-8. So a cut after u units is found by a binary search for the run that holds it and
one multiplication: no unit is ever listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import pieces, utf8_rows

#: Classes of bytes: LETTER, or the width of the code point that the byte begins; INNER bytes belong to the code point before.
LETTER, INNER = 0, 255
_CLASS = np.array([LETTER if chr(b).isalpha() and b < 128 else 1 if b < 0x80 else INNER if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Runs:
    """kind: class of each run; byte, point, unit: how many bytes, code points and units stand before it (one entry more: all)."""

    kind: np.ndarray
    byte: np.ndarray
    point: np.ndarray
    unit: np.ndarray

    @classmethod
    def of(cls, text: bytes) -> Runs:
        kinds = _CLASS[np.frombuffer(text, np.uint8)]
        if not text.isascii():
            for _ in range(3):  # a code point has three inner bytes at most
                kinds[1:] = np.where(kinds[1:] == INNER, kinds[:-1], kinds[1:])
        start = np.concatenate([[0] if text else [], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1]).astype(np.int64)
        kind = kinds[start]
        byte = np.append(start, len(text))
        points = np.diff(byte) // np.maximum(kind, 1)
        total = lambda n: np.concatenate([[0], np.cumsum(n)])
        return cls(kind, byte, total(points), total(np.where(kind == LETTER, 1, points)))

    @property
    def units(self) -> int:
        return int(self.unit[-1])

    def cut(self, units: int) -> tuple[int, int]:
        """(byte, code point) after so many units."""
        run = int(np.searchsorted(self.unit, units, side="right")) - 1
        within = units - int(self.unit[run])  # 0 in a run of letters, and after the last run
        return int(self.byte[run]) + within * int(self.kind[run] if within else 0), int(self.point[run]) + within


def seeds(id_col: str, seed: int) -> list[Column]:
    """The first four groups of 8 digits of sha256("seed:id") as integers; a null id is empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"__h{k + 1}") for k in range(4)]


def transformed(docs: DataFrame, seed: int, rate: int = 90, suffix_first: int = 20, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every document's whole text, null as empty.

    Of a hundred documents ``rate`` are cut, at places that the id's hash chooses among all borders of units, and
    of those ``suffix_first`` take the form spm (suffix, prefix, middle), the others psm; the rest stays plain, as do
    empty texts and such as hold a mark. prefix_chars and middle_chars count code points, null if plain. Rows of
    equal id and text give equal rows; other columns of ``docs`` are not read. No rows give none. One text is in
    a worker's memory at a time, with a few bytes for each of its own.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), *seeds(id_col, seed))
    p, s, m = (x.encode() for x in marks)

    def one(text: bytes, h: tuple[int, int, int, int]) -> tuple:
        runs = Runs.of(text)
        n = runs.units
        if not text or p in text or s in text or m in text or h[2] % 100 >= rate:
            return n, "plain", None, None, text
        (a, first), (b, second) = (runs.cut(u) for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h[3] % 100 < suffix_first:
            return n, "spm", first, second - first, b"".join((s, suffix, p, prefix, m, middle))
        return n, "psm", first, second - first, b"".join((p, prefix, s, suffix, m, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes = zip(*(batch.column(f"__h{k}").to_pylist() for k in (1, 2, 3, 4)), strict=True)
            n, form, first, second, out = zip(*map(one, utf8_rows(batch.column("text")), hashes), strict=True)
            columns = [batch.column("__id"), pa.array(n, pa.int64()), pa.array(form), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["__id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = rows.mapInArrow(run, f"__id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("__id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that ``transformed`` made this output from.

    A cut text holds no mark, and a mark has no border, so the first of each kind is the one that was put there.
    """
    p, s, m = marks

    def parts(one: str, two: str, three: str) -> list[Column]:
        rest = F.substr(output, F.lit(len(one) + 1))
        a = F.substring_index(rest, two, 1)
        rest = F.substr(rest, F.length(a) + len(two) + 1)
        b = F.substring_index(rest, three, 1)
        return [a, b, F.substr(rest, F.length(b) + len(three) + 1)]

    prefix, suffix, middle = parts(p, s, m)
    back, ahead, last = parts(s, p, m)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(ahead, last, back)).otherwise(output)
