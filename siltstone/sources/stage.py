"""Staging a source: which rows of it, since when, with which technical columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.naming import CDC_ACTION, HIGH_DATE, IS_CURRENT, IS_TOMBSTONE, LOW_DATE, STAGE_TIME, VERSION_KEY
from siltstone.functions.types import ColumnDef, cast_to, spark_type
from siltstone.operators import temporal
from siltstone.plans.store import Table, Version
from siltstone.sources import jdbc

LOAD_TYPES = ("Full", "Delta", "DateCdc", "SequenceCdc")
RUN_TYPES = ("Full", "Delta")


@dataclass(frozen=True)
class Source:
    """One feed: how to read it, which columns to take and how it tells changes.

    reader: (spark, run type) -> rows; kind "table" reads ``path`` in ``format``; "external": the stage is
    there already; "match": what only one side of the configured comparison ``match`` has (see ``Vault``);
    "satellite": a full run takes the current versions, a delta what has changed, as actions, either of the satellite
    ``satellite`` of the same vault (see ``Vault``; marks are versions of its table), or of loose satellite rows at
    ``path`` (marks are times). row_filter: an SQL condition. sequence: the column of change order. declared: the
    columns of the stage with types and defaults; those that a batch lacks are filled, others go.
    A "jdbc" format with ``sequence`` and an option ``parts`` is read in so many parts.
    """

    name: str
    load_type: str = "Full"
    kind: str = "table"
    path: str | None = None
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)
    reader: Callable[[SparkSession, str], DataFrame] | None = None
    columns: tuple[str, ...] | None = None
    derived: dict[str, str] = field(default_factory=dict)
    row_filter: str | None = None
    operation: str | None = None
    sequence: str | None = None
    version: int = 1
    match: str | None = None
    satellite: str | None = None
    declared: tuple[ColumnDef, ...] = ()


def read(spark: SparkSession, source: Source, run_type: str, after=None, until=None) -> DataFrame:
    """The source's rows by its kind; table formats are any that Spark reads, JDBC included.

    after, until: the window of a delta, for sources that are asked for its bounds.
    """
    if source.load_type not in LOAD_TYPES or run_type not in RUN_TYPES:
        raise ValueError(f"{source.name}: load type {source.load_type}, run type {run_type}")
    if source.kind == "callable":
        if source.reader is None:
            raise ValueError(f"{source.name}: no reader")
        return source.reader(spark, run_type)
    if source.kind in ("table", "external", "satellite"):
        if source.path is None:
            raise ValueError(f"{source.name}: no path")
        if source.format == "jdbc" and source.sequence and "parts" in source.options:
            options = {k: v for k, v in source.options.items() if k != "parts"}
            return jdbc.read_parts(spark, options | {"dbtable": source.path}, source.sequence, int(source.options["parts"]), after, until)
        return spark.read.format(source.format).options(**source.options).load(source.path)
    raise ValueError(f"{source.name}: unknown kind {source.kind}")


def decode_operations(rows: DataFrame, operation: str) -> DataFrame:
    """Change-table operations as actions: 1 is a delete, 2 and 4 are upserts; others (images before) go."""
    kept = rows.where(F.col(operation).isin(1, 2, 4))
    return kept.withColumn(CDC_ACTION, F.when(F.col(operation) == 1, "D").otherwise("U")).drop(operation)


def nullify_deleted(rows: DataFrame, keys: list[str], technical: list[str] = (), action: str = CDC_ACTION) -> DataFrame:
    """Payload of deletes is null; keys and technical columns stay."""
    fixed = {*keys, *technical, action}
    return rows.select(*(F.col(c) if c in fixed else F.when(F.coalesce(F.col(action), F.lit("")) != "D", F.col(c)).alias(c) for c in rows.columns))


def window(source: Source, rows: DataFrame, after, until) -> DataFrame:
    """Changes after one high-water mark and up to another; a missing bound is open."""
    if source.sequence is None:
        return rows
    at = F.col(source.sequence)
    rows = rows if after is None else rows.where(at > F.lit(after))
    return rows if until is None else rows.where(at <= F.lit(until))


def satellite_rows(rows: DataFrame, run_type: str, at: datetime | None, after: datetime | None, until: datetime | None) -> DataFrame:
    """What a satellite gives to the next layer: a full run its versions at a time, a delta the changes of a window as actions."""
    if run_type == "Full":
        return temporal.point_in_time(rows, at).withColumn(CDC_ACTION, F.lit("U"))
    low, high = after or LOW_DATE, until or HIGH_DATE
    return temporal.changes_between(rows, low, high).withColumn(CDC_ACTION, F.when(F.col(IS_TOMBSTONE), "D").otherwise("U"))


def stage(spark: SparkSession, source: Source, run_type: str, stage_time: datetime, after=None, until=None, keys: list[str] = ()) -> DataFrame:
    """The staged batch: filtered, pruned to the configured columns, with technical columns.

    Filters and columns are applied before anything else, so they reach the scan.
    """
    delta = run_type == "Delta" and source.load_type != "Full"
    rows = read(spark, source, run_type, *((after, until) if delta and source.kind != "satellite" else ()))
    if source.row_filter:
        rows = rows.where(source.row_filter)
    if source.kind == "satellite":
        rows = satellite_rows(rows, run_type if source.load_type == "DateCdc" else "Full", None, after, until)
    elif delta:
        rows = window(source, rows, after, until)
    if source.columns:
        extra = [c for c in (source.operation, source.sequence, CDC_ACTION if source.kind == "satellite" else None) if c and c not in source.columns]
        rows = rows.select(*source.columns, *extra)
    if source.operation:
        rows = decode_operations(rows, source.operation)
        rows = nullify_deleted(rows, list(keys), [c for c in (source.sequence,) if c])
    for name, expression in source.derived.items():
        value = F.expr(expression)
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    if source.declared:
        rows = typed(rows, list(source.declared), [c for c in (CDC_ACTION, source.sequence) if c and c in rows.columns])
    return rows.withColumns({STAGE_TIME: F.lit(stage_time).cast("timestamp_ntz"), VERSION_KEY: F.lit(source.version)})


def typed(rows: DataFrame, columns: list[ColumnDef], keep: list[str] = ()) -> DataFrame:
    """The declared columns, cast where types differ: nulls and columns that the rows lack get the default; retired ones are null.

    A null in a column that isn't nullable and has no default is an error as the rows are read.
    """
    out = []
    for c in columns:
        default = F.lit(None) if c.default is None else F.expr(c.default)
        have = c.name in rows.columns and not c.retired
        value = cast_to(F.col(c.name), rows.schema[c.name].dataType, c) if have else F.lit(None).cast(spark_type(c))
        value = value if c.retired or c.default is None else F.coalesce(value, default.cast(spark_type(c)))
        if not c.nullable and not c.retired:
            value = F.coalesce(value, F.raise_error(F.lit(f"column {c.name} is null")).cast(spark_type(c)))
        out.append(value.alias(c.name))
    names = {c.name for c in columns}
    return rows.select(*out, *(k for k in keep if k not in names))


def vault_rows(table: Table, run_type: str, since: Version | None, until: Version) -> DataFrame:
    """What a vault's satellite gives to the next layer: a full run its current rows at a version, a delta what has changed between two.

    A delta's rows are the net changes by key, with the action; deletes have no payload.
    """
    if run_type == "Full":
        return table.read(until, "current").withColumn(CDC_ACTION, F.lit("U"))
    return table.changes(since, until, net=True).withColumn(CDC_ACTION, F.when(F.col(IS_CURRENT), "U").otherwise("D"))


def high_water_marks(sources: DataFrame, batches: DataFrame, states: DataFrame) -> DataFrame:
    """(source, mark) to go on from: the least of the batch, else of the last satellite load, else of the last stage load.

    sources: (source); batches: (source, mark) of staged rows; states: (source, kind, mark, ended). None of them: null.
    """
    least = batches.groupBy("source").agg(F.min("mark").alias("batch"))
    ended = lambda kind: F.when((F.col("kind") == kind) & F.col("mark").isNotNull(), F.col("ended"))
    last = states.groupBy("source").agg(*(F.max_by("mark", ended(k)).alias(k) for k in ("sat", "stage")))
    found = sources.join(least, "source", "left").join(last, "source", "left")
    return found.select("source", F.coalesce("batch", "sat", "stage").alias("mark"))


def high_water(stage_rows: DataFrame, mark: str, states: DataFrame, source: str):
    """The mark of one source; see ``high_water_marks``."""
    one = states.sparkSession.createDataFrame([(source,)], "source string")
    return high_water_marks(one, stage_rows.select(F.lit(source).alias("source"), F.col(mark).alias("mark")), states).first()["mark"]
