"""Reads of relational sources in parts, by a column whose range the source itself tells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parts(spark: SparkSession, options: dict[str, str], column: str, parts: int, after=None, until=None) -> DataFrame:
    """The rows of ``dbtable`` with ``column`` after one value and up to another, read by ``parts`` queries of even ranges.

    The source is asked for the least and the greatest value within the window first (one row), so that the
    ranges fit what is read, not all that is there. The window's conditions reach the source, as do columns and
    filters that are put on the result. No rows in the window: nothing is read.
    """
    rows = spark.read.format("jdbc").options(**options).load()
    kept = lambda df: df.where((F.lit(True) if after is None else F.col(column) > F.lit(after)) & (F.lit(True) if until is None else F.col(column) <= F.lit(until)))
    low, high = kept(rows).agg(F.min(column), F.max(column)).first()
    if low is None:
        return rows.where("false")
    bounds = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return kept(spark.read.format("jdbc").options(**options, **bounds).load())
