"""Reads of satellites at a time, between times and on a grid of days."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.naming import END, IS_CURRENT, IS_TOMBSTONE, START
from siltstone.plans.shared import checkpointed

#: A key with more facts than this is split by time, into so many slices; so few hot keys are sent to every task.
HOT_ROWS, SLICES, FEW_KEYS = 1_000_000, 64, 100_000


def valid_at(t: Column | None) -> Column:
    """Start inclusive, end exclusive, no tombstones; without a time: the current versions."""
    alive = ~F.col(IS_TOMBSTONE)
    return alive & F.col(IS_CURRENT) if t is None else alive & (F.col(START) <= t) & (F.col(END) > t)


def point_in_time(table: DataFrame, t: datetime | None = None) -> DataFrame:
    return table.where(valid_at(None if t is None else F.lit(t).cast("timestamp_ntz")))


def changes_between(table: DataFrame, after: datetime, until: datetime) -> DataFrame:
    """Versions and tombstones that start after one time and not after another."""
    low, high = (F.lit(t).cast("timestamp_ntz") for t in (after, until))
    return table.where((F.col(START) > low) & (F.col(START) <= high))


def day_ends(spark: SparkSession, first: date, last: date) -> DataFrame:
    """(pit_date): the last millisecond of each day."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))).alias("day"))
    return days.select((F.col("day").cast("timestamp_ntz") + F.expr("interval 1 day") - F.expr("interval 1 millisecond")).alias("pit_date"))


def daily_grid(table: DataFrame, first: date, last: date) -> DataFrame:
    """The versions valid at the end of each day, with pit_date.

    Each version lists the days that it spans by arithmetic, so there is no range join and no shuffle.
    """
    day_end = F.expr("interval 1 day") - F.expr("interval 1 millisecond")
    low = F.greatest(F.to_date(START), F.lit(first))
    # The first day end not before the start: the start's own day, unless it lies in that day's last millisecond.
    low = F.when(F.col(START) > low.cast("timestamp_ntz") + day_end, F.date_add(low, 1)).otherwise(low)
    high = F.least(F.to_date(END), F.lit(last))
    high = F.when(high.cast("timestamp_ntz") + day_end >= F.col(END), F.date_sub(high, 1)).otherwise(high)
    spans = table.where(~F.col(IS_TOMBSTONE)).withColumns({"__low": low, "__high": high}).where("__low <= __high")
    days = spans.withColumn("__day", F.explode(F.sequence("__low", "__high", F.expr("interval 1 day"))))
    return days.withColumn("pit_date", F.col("__day").cast("timestamp_ntz") + day_end).drop("__low", "__high", "__day")


def as_of(facts: DataFrame, versions: DataFrame, keys: list[str], at: str, payload: dict[str, str], how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """facts with the version of their key that was valid at their own time ``at``.

    payload: columns of the versions to the names that they get. ``left`` keeps facts for which nothing was valid
    (no version yet, a tombstone, an ended one, a null key or time) with nulls, ``inner`` drops them. A version
    is valid from its start on and before its end; of versions that start at the same time the one that ends last counts.

    There is no range join: facts and versions are united, sorted by key and time, and each fact looks back to the
    last version before it. Keys with more than ``hot_rows`` facts (they are counted first) are cut into
    slices of time with about as many of their facts each, and into every slice the last version before it is
    carried, so that one key is the work of many tasks.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unknown join {how}")
    if clash := set(payload.values()) & set(facts.columns):
        raise ValueError(f"facts have columns {sorted(clash)} already")
    present = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*keys, at)))
    known, time = facts.where(present), F.col(at).cast("timestamp_ntz")
    hot = checkpointed(known.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys, F.lit(True).alias("__hot")))
    n_hot = hot.count()
    bounds = []
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= FEW_KEYS else hot
        shares = F.array(*(F.lit(k / SLICES) for k in range(1, SLICES)))
        bounds = sorted(set(known.join(hot, keys, "left_semi").agg(F.percentile_approx(_micros(time), shares)).first()[0]))

    def sliced(rows: DataFrame, t: Column) -> DataFrame:
        if not bounds:
            return rows.withColumn("__slice", F.lit(0))
        place = reduce(lambda a, b: a + b, ((_micros(t) >= b).cast("int") for b in bounds))
        return rows.join(hot, keys, "left").withColumn("__slice", F.when(F.col("__hot"), place).otherwise(0)).drop("__hot")

    kept = versions.select(*keys, F.col(START).alias("__time"), F.col(END).alias("__end"), F.struct(F.col(END).alias("end"), F.col(IS_TOMBSTONE).alias("gone"), *(F.col(c).alias(n) for c, n in payload.items())).alias("__version"))
    placed = sliced(kept, F.col("__time"))
    if bounds:
        last = placed.join(hot, keys, "left_semi").groupBy(*keys, "__slice").agg(F.max_by(F.struct("__time", "__end", "__version"), F.struct("__time", "__end")).alias("v"))
        until = F.coalesce(F.lead("__slice").over(Window.partitionBy(*keys).orderBy("__slice")), F.lit(len(bounds)))
        later = last.withColumn("__to", until).where(F.col("__to") > F.col("__slice"))
        carried = later.select(*keys, "v.*", F.explode(F.sequence(F.col("__slice") + 1, F.col("__to"))).alias("__slice"))
        placed = placed.unionByName(carried)
    asked = sliced(known.select(*keys, time.alias("__time"), F.struct(*facts.columns).alias("__fact")), F.col("__time"))
    both = placed.unionByName(asked, allowMissingColumns=True)
    is_fact = F.col("__fact").isNotNull()
    back = Window.partitionBy(*keys, "__slice").orderBy("__time", is_fact, "__end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("__version", F.last("__version", ignorenulls=True).over(back)).where(is_fact)
    valid = F.coalesce(~F.col("__version.gone") & (F.col("__time") < F.col("__version.end")), F.lit(False))
    if how == "inner":
        met = met.where(valid)
    values = [F.when(valid, F.col(f"__version.{n}")).alias(n) for n in payload.values()]
    out = met.select(*(F.col(f"__fact.{c}").alias(c) for c in facts.columns), *values)
    if how == "left":
        none = [F.lit(None).cast(versions.schema[c].dataType).alias(n) for c, n in payload.items()]
        out = out.unionByName(facts.where(~present).select("*", *none))
    return out


def _micros(time: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), time)
