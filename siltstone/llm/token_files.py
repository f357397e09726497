"""Token-id files: range-coded blocks, written by Spark in ascending document order and read back.

A file set is a parquet folder of rows (shard, first, n_ids, payload), so any store that Spark writes
to can hold it. Shards follow each other in ascending document order; ``first`` is where a payload's
ids begin within its shard. A payload is, little-endian:

    magic "SLT1", version u16, block length u32, documents u32, ids u64, blocks u32, alphabet bytes u32
    per document: id i64, null mark u8, number of ids u32 (three arrays)
    per block: bytes u32, crc32 u32 (two arrays)
    the alphabet: the ids that occur, ascending, as differences u32, deflated
    crc32 of all the above u32
    the blocks (see rangecoder), each coded from a fresh model over the alphabet

A block that fails its checksum is reported with its place; no other block needs it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import rangecoder
from siltstone.llm.common import pieces, utf8_rows
from siltstone.llm.tokens import SLICE_BYTES, SLICES, encoder

MAGIC, VERSION = b"SLT1", 2
_HEAD = struct.Struct("<4sHIIQII")
#: Ids of a payload, about; a document is never cut.
PAYLOAD_IDS = 1 << 22
FILE_SCHEMA = "shard int, first long, n_ids long, payload binary"


class DamagedFile(ValueError):
    """A header or block whose checksum doesn't hold."""


def dump(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """One payload of whole documents; counts: the number of ids of each."""
    alphabet, blocks = rangecoder.encode(ids)
    letters = zlib.compress(np.diff(alphabet.astype("<u4"), prepend=np.uint32(0)).astype("<u4").tobytes(), 9)
    head = _HEAD.pack(MAGIC, VERSION, rangecoder.BLOCK, len(doc_ids), len(ids), len(blocks), len(letters))
    head += np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes()
    head += np.array([x is None for x in doc_ids], "u1").tobytes() + np.array(counts, "<u4").tobytes()
    head += np.array([len(b) for b in blocks], "<u4").tobytes() + np.array([zlib.crc32(b) for b in blocks], "<u4").tobytes()
    head += letters
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks)


def load(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of a payload, with every checksum verified."""
    if len(payload) < _HEAD.size:
        raise DamagedFile("header cut short")
    magic, version, block, n_docs, n_ids, n_blocks, n_letters = _HEAD.unpack_from(payload)
    if magic != MAGIC or version != VERSION:
        raise DamagedFile(f"not a payload of version {VERSION}")
    end = _HEAD.size + 13 * n_docs + 8 * n_blocks + n_letters
    if len(payload) < end + 4 or struct.unpack_from("<I", payload, end)[0] != zlib.crc32(payload[:end]):
        raise DamagedFile("header checksum")
    at, arrays = _HEAD.size, []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u4", n_blocks), ("<u4", n_blocks)):
        arrays.append(np.frombuffer(payload, kind, n, at))
        at += arrays[-1].nbytes
    alphabet = np.cumsum(np.frombuffer(zlib.decompress(payload[at:end]), "<u4"), dtype=np.uint32)
    numbers, absent, counts, sizes, sums = arrays
    ends = np.cumsum(sizes.astype(np.int64)) + end + 4
    blocks = [payload[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
    for k, (b, want) in enumerate(zip(blocks, sums.tolist(), strict=True)):
        if zlib.crc32(b) != want:
            raise DamagedFile(f"checksum of block {k}")
    doc_ids = [None if a else int(x) for x, a in zip(numbers, absent, strict=True)]
    return doc_ids, counts, rangecoder.decode(alphabet, blocks, n_ids, block)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty), append ``end_id`` to each, and write the files.

    Order: ascending id, null ids first; rows of equal ids in order of a hash of their text, then of the
    text. The texts are shuffled once, by range of id and hash, so that an id that many rows share is
    dealt to many tasks; each task streams its rows and holds one payload. Ids must be whole numbers (the files
    hold them as 64 bits); others are refused.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}, not a whole number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first = TaskContext.get().partitionId(), 0
        numbers, counts, parts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            columns = [pa.array([shard], pa.int32()), pa.array([first]), pa.array([len(ids)]), pa.array([dump(numbers, counts, ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "first", "n_ids", "payload"])

        with encoder(vocabulary, keep=True) as words:
            for batch in pieces(batches, SLICES * SLICE_BYTES):
                ids, own = words.encode_all(utf8_rows(batch.column(1)), end_id)
                at = 0
                for number, count in zip(batch.column(0).to_pylist(), own.tolist(), strict=True):
                    numbers.append(number)
                    counts.append(count)
                    parts.append(ids[at : at + count])
                    at += count
                    size += count
                    if size >= PAYLOAD_IDS:
                        yield flush()
                        first += size
                        numbers, counts, parts, size = [], [], [], 0
        if numbers:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text")
    rows.mapInArrow(run, FILE_SCHEMA).write.option("compression", "none").parquet(path)


def _starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard: one number for each partition that was written."""
    sizes = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    before = np.cumsum([0, *(r["n"] for r in sizes)])
    return {r["shard"]: int(b) for r, b in zip(sizes, before, strict=False)}


def _read(spark: SparkSession, path: str, named: str, kind: pa.DataType, schema: str, value) -> DataFrame:
    """(doc_id, start, n_tokens, a value of its ids) of each document; value: a function of one document's ids."""
    starts = _starts(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, counts, ids = load(row["payload"])
                ends = np.cumsum(counts.astype(np.int64))
                begins = ends - counts
                values = [value(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                start = begins + row["first"] + starts[row["shard"]]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(start), pa.array(counts.astype(np.int64)), pa.array(values, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", named])

    return spark.read.parquet(path).mapInArrow(run, f"doc_id long, start long, n_tokens long, {named} {schema}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of each document; start: ids of all documents before it."""
    return _read(spark, path, "ids", pa.list_(pa.int32()), "array<int>", lambda x: x.astype(np.int32))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 of the ids as little-endian unsigned 32-bit integers)."""
    return _read(spark, path, "ids_crc32", pa.int64(), "long", lambda x: zlib.crc32(x.astype("<u4").tobytes()))
