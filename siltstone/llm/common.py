"""What the operators share: reading tables, shared storage, text batches."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.shared import checkpointed, shared_folder

__all__ = ["ascii_lower", "checkpointed", "pieces", "shared_folder", "small", "stored", "table", "utf8_buffer", "utf8_rows"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; the path may be any that Spark's readers know."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as a table to the shared folder and reread; smaller than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if it has ``rows`` rows at most (they are counted), else as it is: joins then shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def utf8_rows(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one byte array with n + 1 offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 21, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each have about ``most_bytes`` at most (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(text).fill_null(""))
        sizes = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def ascii_lower(column):
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
