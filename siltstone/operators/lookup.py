"""Key lookups of staged rows: surrogate keys of hubs and links, with a default where there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.naming import FAILED_LOOKUP_KEY
from siltstone.functions.types import ColumnDef, cast_to, spark_type


def hub_key(stage: DataFrame, hub: DataFrame, on: dict[str, str], key: str, alias: str | None = None, default: int | None = FAILED_LOOKUP_KEY) -> DataFrame:
    """stage with the hub's surrogate as ``alias``; on: stage column to business key.

    Adaptive execution broadcasts a small hub. default None leaves null where the key is missing.
    """
    alias = alias or key
    names = {b: f"__{alias}_{b}" for b in on.values()}
    side = hub.select(F.col(key).alias(alias), *(F.col(b).alias(n) for b, n in names.items()))
    condition = [stage[s] == side[names[b]] for s, b in on.items()]
    joined = stage.join(side, condition, "left").drop(*names.values())
    return joined if default is None else joined.withColumn(alias, F.coalesce(alias, F.lit(default).cast("long")))


def link_key(stage: DataFrame, link: DataFrame, roles: list[str], key: str, default: int = FAILED_LOOKUP_KEY) -> DataFrame:
    """stage (with role keys) and the link's surrogate."""
    joined = stage.join(link.select(*roles, key), roles, "left")
    return joined.withColumn(key, F.coalesce(key, F.lit(default).cast("long")))


def payload(stage: DataFrame, columns: dict[str, ColumnDef], keep: list[str]) -> DataFrame:
    """``keep`` and the mapped columns (stage name to declared column); retired ones are null of their type."""
    out = []
    for name, column in columns.items():
        value = F.lit(None).cast(spark_type(column)) if column.retired else cast_to(F.col(name), stage.schema[name].dataType, column)
        out.append(value.alias(column.name))
    return stage.select(*keep, *out)
