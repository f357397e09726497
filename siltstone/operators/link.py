"""Link loads: distinct combinations of hub keys that the link lacks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.naming import LOAD_TIME, RECORD_SOURCE, key_name
from siltstone.operators.keys import greatest_key, numbered


def new_rows(looked_up: DataFrame, link: DataFrame | None, name: str, roles: list[str], load_time: datetime, record_source: str) -> DataFrame:
    """Rows to append to the link; a combination with a null role is no link."""
    found = looked_up.select(*roles).dropna(subset=roles).distinct()
    if link is not None:
        found = found.join(link.select(*roles), roles, "left_anti")
    key = key_name("link", name)
    out = numbered(found, roles, key, greatest_key(link, key))
    return out.select(key, F.lit(load_time).cast("timestamp_ntz").alias(LOAD_TIME), F.lit(record_source).alias(RECORD_SOURCE), *roles)
