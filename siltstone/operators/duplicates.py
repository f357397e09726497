"""Duplicate keys of a staged batch: refuse them, or set all rows of such keys aside up to a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.shared import checkpointed

#: The message of journal entries about rows set aside.
REMOVED = "Duplicate Key Removed"


class DuplicateKeys(ValueError):
    """More duplicated rows than the threshold allows."""


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def removed_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of a duplicated key."""
    return df.join(duplicate_keys(df, keys).select(*keys), keys, "left_semi")


def apply_policy(df: DataFrame, keys: list[str], threshold: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows to load, rows set aside). threshold 0 refuses any duplicate; else it counts rows, not keys.

    All rows of a duplicated key are set aside, none is kept. Keys are grouped once: the duplicated ones are stored,
    counted, and joined with both ways.
    """
    doubled = checkpointed(duplicate_keys(df, keys))
    rows = doubled.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not rows:
        return df, None
    if rows > threshold:
        raise DuplicateKeys(f"Duplicate Keys Detected: {rows} rows, {threshold} allowed")
    return df.join(doubled.select(*keys), keys, "left_anti"), df.join(doubled.select(*keys), keys, "left_semi")
