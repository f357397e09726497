"""Joins by time alone: points with the intervals that hold them, intervals with those that they overlap."""

from __future__ import annotations

from datetime import datetime
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.plans.shared import checkpointed

#: Points in a block at least, blocks from which on they grow, intervals in a unit, pairs looked at in a task (about).
POINTS, BLOCKS, UNIT, PAIRS = 1024, 16384, 8192, 2**24


def _number(df: DataFrame, column: str) -> Column:
    """Times as microseconds, so that bins are whole numbers."""
    if isinstance(df.schema[column].dataType, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))
    return F.col(column).cast("long")


def _up_to(values: Column, n: int, x: Column, inclusive: bool) -> Column:
    """How many of n ascending values are at most (not inclusive: below) x, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    holds = lambda v: v <= x if inclusive else v < x
    return F.aggregate(steps, F.lit(0), lambda found, step: found + F.when(holds(F.get(values, found + step - 1)), step).otherwise(F.lit(0)))


def _numbers(values: list[int]) -> Column:
    """A constant array, without an expression for each value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def points_within(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, open_low: bool = False) -> DataFrame:
    """All columns of both for each point and interval with low <= at <= high (open_low: low < at).

    A null ``high`` is an interval that hasn't ended; a null point or ``low`` meets nothing. Column names of the two must differ.

    Points are stored in blocks of some 1,024 in the order of time, one row and array each. An interval meets the blocks
    from its low to its high by their numbers, and reads a block's points one after the other, so that besides the result's
    pairs it takes those of the blocks at its ends. Where blocks begin is known to the driver (16,384 times and one for
    each partition at most; blocks grow above that), and how many intervals meet each: those are dealt into even units
    with a copy of the block in each, and units into partitions by pairs, so long intervals and crowded times spread.
    """
    p = points.withColumn("__at", _number(points, at)).where("__at is not null")
    i = intervals.withColumns({"__low": _number(intervals, low), "__high": _number(intervals, high)})
    i = i.withColumn("__high", F.coalesce("__high", F.lit(2**63 - 1))).where("__low <= __high")
    n = p.count()
    if n == 0:
        return points.join(intervals, F.lit(False))
    shift = max((POINTS - 1).bit_length(), ((n - 1) // BLOCKS).bit_length())
    p = p.repartitionByRange("__at").sortWithinPartitions("__at").withColumn("__block", F.shiftright(F.monotonically_increasing_id(), shift))
    # stored, as another run might cut elsewhere
    blocks = checkpointed(p.groupBy("__block").agg(F.min("__at").alias("__from"), F.collect_list(F.struct("__at", *points.columns)).alias("__points")))
    known = sorted(blocks.select("__block", "__from", F.size("__points")).collect())
    begins, b = _numbers([r[1] for r in known]), len(known)
    # a block before the first that begins at low or later may hold low
    first = F.greatest(_up_to(begins, b, F.col("__low"), False) - 1, F.lit(0))
    i = i.where(F.col("__high") >= known[0][1]).withColumns({"__first": first, "__last": _up_to(begins, b, F.col("__high"), True) - 1})
    ends = F.explode(F.array(F.struct(F.col("__first").alias("k"), F.lit(1).alias("n")), F.struct((F.col("__last") + 1).alias("k"), F.lit(-1).alias("n"))))
    steps = {r[0]: r[1] for r in i.select(ends.alias("e")).groupBy("e.k").agg(F.sum("e.n")).collect()}
    meet = list(accumulate(steps.get(k, 0) for k in range(b)))
    units = _numbers([-(-m // UNIT) for m in meet])
    blocks = blocks.withColumn("__block", _up_to(_numbers([r[0] for r in known]), b, F.col("__block"), False))
    blocks = blocks.withColumn("__units", F.get(units, F.col("__block"))).where("__units > 0").withColumn("__unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__units") - 1)))
    hashed = F.xxhash64(*[f.name for f in i.schema if isinstance(f.dataType, T.NumericType | T.StringType | T.DateType | T.TimestampType | T.TimestampNTZType)])
    i = i.withColumn("__block", F.explode(F.sequence("__first", "__last"))).withColumn("__unit", F.pmod(hashed, F.get(units, F.col("__block"))))
    tasks = min(8192, sum(m * r[2] for m, r in zip(meet, known, strict=True)) // PAIRS)
    if tasks > 1:
        i, blocks = (df.repartition(tasks, "__block", "__unit") for df in (i, blocks))
    met = i.join(blocks.select("__block", "__unit", "__points"), ["__block", "__unit"]).select(*intervals.columns, "__low", "__high", F.inline("__points"))
    after = F.col("__at") > F.col("__low") if open_low else F.col("__at") >= F.col("__low")
    return met.where(after & (F.col("__at") <= F.col("__high"))).select(*points.columns, *intervals.columns)


def overlapping(left: DataFrame, right: DataFrame, one: tuple[str, str], two: tuple[str, str]) -> DataFrame:
    """All columns of both for each pair of intervals that share a moment; one, two: their (low, high) columns.

    Either the left one begins within the right one, or the right one after the left one's begin and within it: never both.
    """
    began = points_within(left, right, one[0], *two)
    later = points_within(right, left, two[0], *one, open_low=True)
    return began.unionByName(later.select(*began.columns))
