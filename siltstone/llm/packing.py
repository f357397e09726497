"""Best-fit packing planned on a length histogram.

Documents are never packed one by one. The plan places the counts of each length, longest first, into
the fullest sequence that still has room, all sequences of one fill at a time; it sees as many numbers
as there are lengths. Each document then takes the slot that belongs to its rank within its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed, pieces, utf8_rows
from siltstone.llm.tokens import SLICE_BYTES, encoder


@dataclass(frozen=True)
class Run:
    """Ranks [first, first + sequences * each) of a length: ``each`` of them side by side at ``offset`` in every sequence."""

    length: int
    first: int
    sequences: int
    each: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing over counts. At most three groups of sequences arise per length, and a group has
    as many parts as lengths fit side by side, so the plan's size is bounded by the capacity alone."""
    groups: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, parts: tuple) -> None:
        if n:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((n, parts))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                n, parts = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, n, parts = capacity, -(-left // (capacity // length)), ()
            each = room // length
            full = min(n, left // each)
            rest = min(left - full * each, each - 1) if full < n else 0
            put(room - each * length, full, (*parts, (length, each)))
            put(room - rest * length, int(rest > 0), (*parts, (length, rest)))
            put(room, n - full - (rest > 0), parts)
            left -= full * each + rest
    runs, sequence, taken = [], 0, dict.fromkeys(histogram, 0)
    for room in sorted(groups):
        for n, parts in groups[room]:
            offset = 0
            for length, each in parts:
                runs.append(Run(length, taken[length], n, each, sequence, offset))
                taken[length] += n * each
                offset += length * each
            sequence += n
    return runs


def pack(items: DataFrame, capacity: int, order: tuple[str, ...], length_col: str = "length") -> DataFrame:
    """All columns of ``items`` with sequence_id and offset; every length must be 1 to ``capacity``.

    ``items`` must be stable when read twice (a checkpoint or a table). Ranks come from counts of each
    (partition, length), so a length that most rows share is numbered by many tasks; rows that tie in
    ``order`` take slots of the same length, in any order. An empty table gives an empty result.
    """
    histogram = {r[0]: r[1] for r in items.groupBy(length_col).count().collect()}
    runs = sorted(plan(histogram, capacity), key=lambda r: (r.length, r.first))
    shift = 40
    key = np.array([r.length << shift | r.first for r in runs], np.int64)
    each, sequence, offset, first = (np.array([getattr(r, n) for r in runs], np.int64) for n in ("each", "sequence", "offset", "first"))

    names = items.columns
    placed = items.withColumn("__part", F.spark_partition_id())
    within = Window.partitionBy("__part", length_col).orderBy(*order)
    before = Window.partitionBy(length_col).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__part", length_col).count()
    counts = counts.select("__part", length_col, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    ranked = placed.withColumn("__rank", F.row_number().over(within) - 1).join(counts, ["__part", length_col])
    ranked = ranked.select(*names, (F.col("__before") + F.col("__rank")).alias("__rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(length_col).to_numpy().astype(np.int64)
            rank = batch.column("__rank").to_numpy()
            k = np.searchsorted(key, length << shift | rank, side="right") - 1
            i = rank - first[k]
            own = [batch.column(n) for n in names]
            at = [pa.array(sequence[k] + i // each[k]), pa.array(offset[k] + i % each[k] * length)]
            yield pa.RecordBatch.from_arrays([*own, *at], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): the ids of every whole text (null: empty) and ``end_id``, cut at ``capacity``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(vocabulary) as words:
            for batch in pieces(batches, SLICE_BYTES, text_col):
                ids, counts = words.encode_all(utf8_rows(batch.column(1)), end_id)
                data, first = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts) - counts
                n = -(-counts // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(counts[row] - start, capacity)
                begin = 4 * (first[row] + start)
                crc = [zlib.crc32(data[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of all rows, each with its sequence and its place there. Ids may repeat or be null."""
    found = checkpointed(token_pieces(docs, vocabulary, end_id, capacity, id_col, text_col))
    return pack(found, capacity, (id_col, "piece"))
