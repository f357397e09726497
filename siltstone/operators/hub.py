"""Hub loads: distinct business keys that the hub lacks get surrogate keys."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.naming import LOAD_TIME, RECORD_SOURCE, key_name
from siltstone.operators.keys import greatest_key, numbered


def business_keys(roles: list[DataFrame], keys: list[str]) -> DataFrame:
    """The distinct keys of all roles, matched by name; a key with a null part is not a key."""
    every = reduce(DataFrame.unionByName, (r.select(*keys) for r in roles))
    return every.dropna(subset=keys).distinct()


def rejected_keys(roles: list[DataFrame], keys: list[str]) -> DataFrame:
    """(rejected): the number of staged rows whose key has a null part."""
    some_null: Column = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    every = reduce(DataFrame.unionByName, (r.select(*keys) for r in roles))
    return every.agg(F.count_if(some_null).alias("rejected"))


def new_rows(roles: list[DataFrame], hub: DataFrame | None, name: str, keys: list[str], load_time: datetime, record_source: str) -> DataFrame:
    """Rows to append to the hub: (surrogate, load time, record source, keys)."""
    found = business_keys(roles, keys)
    if hub is not None:
        found = found.join(hub.select(*keys), keys, "left_anti")
    return _finished(found, hub, name, keys, load_time, record_source)


def new_rows_by_except(roles: list[DataFrame], hub: DataFrame, name: str, keys: list[str], load_time: datetime, record_source: str) -> DataFrame:
    """The same by set difference, in which null equals null."""
    every = reduce(DataFrame.unionByName, (r.select(*keys) for r in roles))
    return _finished(every.subtract(hub.select(*keys)).dropna(subset=keys), hub, name, keys, load_time, record_source)


def _finished(found: DataFrame, hub: DataFrame | None, name: str, keys: list[str], load_time: datetime, record_source: str) -> DataFrame:
    key = key_name("hub", name)
    out = numbered(found, keys, key, greatest_key(hub, key))
    return out.select(key, F.lit(load_time).cast("timestamp_ntz").alias(LOAD_TIME), F.lit(record_source).alias(RECORD_SOURCE), *keys)
