"""Surrogate keys: dense numbers in the order of the business key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.shared import checkpointed

#: A row's number within its partition is in the low bits of ``monotonically_increasing_id``.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: list[str], name: str, after: int = 0) -> DataFrame:
    """df with ``name`` = after + 1, after + 2, ... by ``order``, which must be unique.

    The rows are dealt to tasks by range and sorted there, and that is stored, once: so no task sees more
    than its share, nothing is computed twice, and a lost executor can't number rows anew. The
    partitions' sizes (a number for each) then say where each one begins. Storing runs when this is called.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = checkpointed(ranged.withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", _PLACE_BITS)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    begin, rows = after + 1, []
    for p, n in sizes:
        rows.append((p, begin))
        begin += n
    begins = spark.createDataFrame(rows, "__part long, __begin long")
    within = F.col("__place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    out = placed.withColumn("__part", part).join(F.broadcast(begins), "__part")  # a row for each partition
    return out.withColumn(name, F.col("__begin") + within).select(*df.columns, name)


def greatest_key(table: DataFrame | None, name: str) -> int:
    return (table.agg(F.max(name)).first()[0] or 0) if table is not None else 0
