"""Exact top-k by inner product over a bit-sliced index.

Components become integers, floor(scale * x). A block of rows keeps, for each component, bitmaps over its rows:
one for each bit of (component - least of the block). A query's score of all rows of a block comes from these
slices alone. Weight w of a component adds slice j at bit i + j for each bit i of |w|; for negative weights the
complement is added and a constant taken off. All slices of one bit are added by full adders, three bitmaps to a sum
and a carry at a time. The result is the score in slices itself. From its most significant slice downward rows
are split into those above the k-th score and those that may equal it; of those that do equal it, the ones with
the smallest ids are taken, as rows stand in the order of their ids. No score but the winners' is ever a number.

Rows are dealt into blocks evenly, whatever their values; every block meets every chunk of queries by equality
of (block, chunk), one pair to a task at a time, and hands on k rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import stored

#: Rows times components of a block, about, and queries of a chunk, about.
CELLS, QUERIES = 1 << 20, 1024
INDEX = "block int, dims int, rows int, ids binary, least binary, width binary, slices binary"


@dataclass(frozen=True)
class Block:
    """ids in ascending order; width: slices of each component; slices: (all widths, words) bitmaps, the first component's lowest bit first."""

    ids: np.ndarray
    least: np.ndarray
    width: np.ndarray
    slices: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray) -> Block:
        order = np.argsort(ids, kind="stable")
        least = x.min(axis=0)
        above = x[order] - least
        width = np.array([int(m).bit_length() for m in above.max(axis=0)], np.uint8)
        words = -(-len(ids) // 64)
        slices = np.zeros((int(width.sum()), words * 8), np.uint8)
        at = 0
        for column, w in zip(above.T, width.tolist(), strict=True):
            bits = ((column >> np.arange(w)[:, None]) & 1).astype(np.uint8)
            packed = np.packbits(bits, axis=1, bitorder="little")
            slices[at : at + w, : packed.shape[1]] = packed
            at += w
        return cls(ids[order], least, width, slices.view(np.uint64))

    def everyone(self) -> np.ndarray:
        """The bitmap of all rows."""
        rows = np.arange(self.slices.shape[1] * 64) < len(self.ids)
        return np.packbits(rows, bitorder="little").view(np.uint64)

    def weighed(self, weights: list[int]) -> tuple[list[np.ndarray], int]:
        """(slices of a whole number for each row, constant): together a row's inner product with the weights."""
        constant, columns, at = 0, {}, 0
        for w, least, width in zip(weights, self.least.tolist(), self.width.tolist(), strict=True):
            constant += w * least - (-w * ((1 << width) - 1) if w < 0 else 0)
            for i in range(abs(w).bit_length()):
                if abs(w) >> i & 1:
                    for j in range(width):
                        columns.setdefault(i + j, ([], []))[w < 0].append(at + j)
            at += width
        out, carried, bit = [], [], 0
        while bit <= max(columns, default=-1) or carried:
            plain, turned = columns.get(bit, ([], []))
            total, carried = added(np.concatenate([self.slices[plain], ~self.slices[turned], *carried]))
            out.append(total)
            bit += 1
        return out, constant


def added(bitmaps: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The lowest bit of how many of the bitmaps hold each row, and bitmaps that count double for the rest."""
    carries = []
    while len(bitmaps) > 1:
        if len(bitmaps) == 2:
            carries.append(bitmaps[:1] & bitmaps[1:])
            bitmaps = bitmaps[:1] ^ bitmaps[1:]
            break
        m = len(bitmaps) // 3
        a, b, c = bitmaps[:m], bitmaps[m : 2 * m], bitmaps[2 * m : 3 * m]
        two = a ^ b
        carries.append((a & b) | (two & c))
        bitmaps = np.concatenate([two ^ c, bitmaps[3 * m :]])
    return (bitmaps[0] if len(bitmaps) else np.zeros(bitmaps.shape[1], np.uint64)), carries


def ones(bitmap: np.ndarray, most: int) -> list[int]:
    """The first ``most`` rows of a bitmap."""
    out = []
    for word in np.flatnonzero(bitmap):
        bits = int(bitmap[word])
        while bits and len(out) < most:
            out.append(int(word) * 64 + (bits & -bits).bit_length() - 1)
            bits &= bits - 1
        if len(out) == most:
            break
    return out


def top(slices: list[np.ndarray], among: np.ndarray, k: int) -> list[int]:
    """The k rows ``among`` these of the greatest numbers; of equal ones the first rows."""
    above, taken, level = np.zeros_like(among), 0, among
    for bitmap in reversed(slices):
        both = level & bitmap
        n = int(np.bitwise_count(both).sum())
        if taken + n > k:
            level = both
            continue
        above, taken = above | both, taken + n
        if taken == k:
            return ones(above, k)
        level = level & ~bitmap
    return ones(above, k) + ones(level, k - taken)


def best(block: Block, query_id: int, weights: list[int], k: int) -> list[tuple[int, int]]:
    """(id, score) of the block's k best rows for a query, without those of its own id."""
    among = block.everyone()
    first, last = np.searchsorted(block.ids, [query_id, query_id + 1]).tolist()
    for row in range(first, last):
        among[row >> 6] &= ~np.uint64(1 << (row & 63))
    slices, constant = block.weighed(weights)
    rows = top(slices, among, k)
    return [(int(block.ids[r]), constant + sum((int(s[r >> 6]) >> (r & 63) & 1) << p for p, s in enumerate(slices))) for r in rows]


def usable(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, ids, integers) of the rows that have an id and a vector of finite components."""
    lengths = pc.list_value_length(batch.column("__vector")).fill_null(-1).to_numpy(zero_copy_only=False)
    lengths = np.where(batch.column("__id").is_null().to_numpy(zero_copy_only=False), -1, lengths)
    for dims in sorted({*lengths.tolist()} - {-1}):
        own = batch.filter(pa.array(lengths == dims))
        x = own.column("__vector").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(own.num_rows, dims)
        finite = np.isfinite(x).all(axis=1)
        whole = np.floor(x[finite] * scale)
        if whole.size and not np.abs(whole).max() < 2.0**62:
            raise OverflowError("a component times the scale does not fit 62 bits")
        if len(whole):
            yield int(dims), own.column("__id").to_numpy()[finite].astype(np.int64), whole.astype(np.int64)


def _source(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("__id"), F.col(vector_col).alias("__vector")).where("__id is not null and __vector is not null")


def build(vectors: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The index of all rows, stored in the shared folder: INDEX, a row for each block (blocks hold vectors of one size).

    Rows without an id, and vectors that are null or hold null or non-finite components, are left out.
    """
    rows = _source(vectors, id_col, vector_col)
    cells = rows.agg(F.sum(F.size("__vector").cast("long") + 1)).first()[0] or 0
    dealt = rows.repartition(max(1, -(-cells // CELLS))).withColumn("__block", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = number = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for dims, parts in held.items():
                b = Block.of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                row = [number, dims, len(b.ids), b.ids.tobytes(), b.least.tobytes(), b.width.tobytes(), b.slices.tobytes()]
                yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema)
            held.clear()

        for batch in batches:
            number = batch.column("__block")[0].as_py() if batch.num_rows else number
            for dims, ids, x in usable(batch, scale):
                held.setdefault(dims, []).append((ids, x))
                size += len(ids) * (dims + 1)
            if size > 2 * CELLS:
                yield from flush()
                size = 0
        yield from flush()

    names = ["block", "dims", "rows", "ids", "least", "width", "slices"]
    schema = pa.schema([(n, pa.int32()) for n in names[:3]] + [(n, pa.binary()) for n in names[3:]])
    return stored(dealt.mapInArrow(run, INDEX), "slices")


def _block(row: dict) -> Block:
    numbers = lambda name, kind: np.frombuffer(row[name], kind)
    words = -(-row["rows"] // 64)
    return Block(numbers("ids", np.int64), numbers("least", np.int64), numbers("width", np.uint8), numbers("slices", np.uint64).reshape(-1, words))


def search(index: DataFrame, vectors: DataFrame, chosen: Column, scale: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of the index for each of ``vectors`` that is chosen.

    chosen: a condition on ``id``. A query meets the rows with as many components as it has, but none of its
    own id; fewer than k such rows are all its answers, in the order of scores and then ids. Queries that repeat (id
    and vector) are answered once; rows that repeat are answers each. A score beyond 64 bits is an error. No
    queries or no rows give no answers. Other columns are not read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, x in usable(batch, scale):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([row.tobytes() for row in x], pa.binary())], ["id", "weights"])

    rows = _source(vectors, id_col, vector_col).withColumnRenamed("__id", "id").where(chosen).withColumnRenamed("id", "__id")
    asked = stored(rows.mapInArrow(read, "id long, weights binary").distinct(), "queries")
    chunks = max(1, -(-asked.count() // QUERIES))
    blocks = (index.agg(F.max("block")).first()[0] or 0) + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("id", "weights"), F.lit(chunks)).cast("int")).withColumn("block", every(blocks))
    ready = index.withColumn("chunk", every(chunks))

    def run(own: pa.Table, queries: pa.Table) -> pa.Table:
        columns: list[list[int]] = [[], [], [], [], []]
        held = [(r["dims"], _block(r)) for r in own.to_pylist()]
        chunk = queries.column("chunk")[0].as_py() if queries.num_rows else 0
        asks = sorted(zip(queries.column("id").to_pylist(), queries.column("weights").to_pylist(), strict=True))
        for number, (query, packed) in enumerate(asks):
            weights = np.frombuffer(packed, np.int64).tolist()
            for dims, block in held:
                if dims == len(weights):
                    for vec, score in best(block, query, weights, k):
                        for column, value in zip(columns, (chunk, number, query, vec, score), strict=True):
                            column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["chunk", "number", "query_id", "vec_id", "score"])

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    pairs = ready.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk"))
    found = pairs.applyInArrow(run, "chunk int, number int, query_id long, vec_id long, score long")
    order = Window.partitionBy("chunk", "number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
