"""Left/right comparison: the rows that only one of two objects has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.keys import numbered

MASTER, MATCH_ROW = "_master_table", "_match_row"


def left_right(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Distinct rows of either side that the other lacks; null equals null.

    pairs: left and right column; the right one is cast to the left one's type where they differ, and
    the result has the left names. Both sides are aggregated once by the compared columns.
    """
    columns = [a for a, _ in pairs]
    one = left.select(*columns, F.lit(1).alias("__l"), F.lit(0).alias("__r"))
    casts = [(F.col(b) if right.schema[b].dataType == left.schema[a].dataType else F.col(b).cast(left.schema[a].dataType)).alias(a) for a, b in pairs]
    two = right.select(*casts, F.lit(0).alias("__l"), F.lit(1).alias("__r"))
    sides = one.union(two).groupBy(*columns).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r"))
    only = sides.where(F.col("__l") != F.col("__r"))
    return only.select(F.when(F.col("__l") == 1, names[0]).otherwise(names[1]).alias(MASTER), *columns)


def with_match_row(found: DataFrame) -> DataFrame:
    """found with a dense row number by master table and then all columns."""
    return numbered(found, found.columns, MATCH_ROW)


def link_business_keys(link: DataFrame, hubs: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """The link with its hubs' business keys as ``<role>__<key>``; hubs: role column to (hub, surrogate, keys)."""
    for role, (hub, key, keys) in hubs.items():
        name = role.removeprefix("h_").removesuffix("_key")
        side = hub.select(F.col(key).alias(role), *(F.col(k).alias(f"{name}__{k}") for k in keys))
        link = link.join(side, role)
    return link
