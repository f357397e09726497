"""Satellite loads: full history of a parent's attributes, with tombstones.

A satellite row has the parent's surrogate, source time, record source, current and tombstone flags, a
validity interval [start, end), and the payload. Versions compare null-safely as structs. At most one
row of a key is current; a tombstone is a row of no length that isn't current.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.naming import END, HIGH_DATE, IS_CURRENT, IS_TOMBSTONE, RECORD_SOURCE, SOURCE_TIME, START


@dataclass(frozen=True)
class Satellite:
    """keys: the parent's surrogate (one column as a rule); payload: the attributes, in order. No maps."""

    keys: tuple[str, ...]
    payload: tuple[str, ...]

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.keys, SOURCE_TIME, RECORD_SOURCE, IS_CURRENT, IS_TOMBSTONE, START, END, *self.payload)


def _time(t: datetime) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def _version(sat: Satellite, start: Column, end: Column, current: bool, tombstone: bool, source: str, time: Column, payload=None) -> list[Column]:
    values = [F.col(p) for p in sat.payload] if payload is None else payload
    flags = [F.lit(current).alias(IS_CURRENT), F.lit(tombstone).alias(IS_TOMBSTONE)]
    return [*sat.keys, time.alias(SOURCE_TIME), F.lit(source).alias(RECORD_SOURCE), *flags, start.alias(START), end.alias(END), *(v.alias(p) for v, p in zip(values, sat.payload, strict=True))]


def initial(sat: Satellite, source: DataFrame, version_date: datetime, record_source: str) -> DataFrame:
    """The first load: each source row is a current version. source: keys, payload, SOURCE_TIME if known."""
    return source.select(*_version(sat, _time(version_date), _time(HIGH_DATE), True, False, record_source, _source_time(source, version_date)))


def _source_time(source: DataFrame, version_date: datetime) -> Column:
    return F.col(SOURCE_TIME).cast("timestamp_ntz") if SOURCE_TIME in source.columns else _time(version_date)


def merge(sat: Satellite, table: DataFrame, source: DataFrame, version_date: datetime, record_source: str, infer_deletes: bool, unchanged: bool = True) -> DataFrame:
    """The rows of ``table`` after a load of one row for each key: changed keys get a new version, new keys a first one.

    ``infer_deletes`` (a full run of a source that isn't a delta): current keys that the source lacks are
    closed and get a tombstone with null payload. Keys that come back after a tombstone are new. A version
    closes at the version date, or a millisecond after its start if that is later.

    One full outer join with the source finds all cases, and every row of the result comes from it: rows
    that have ended match nothing and pass. A caller that keeps current rows apart gives only those, and
    gets the new current rows and the rows that ended in this load; without ``unchanged`` only rows that this load
    made or ended, so that what is written follows what has changed.
    """
    keys, payload, kinds = list(sat.keys), list(sat.payload), {f.name: f.dataType for f in table.schema}
    others = [c for c in sat.columns if c not in keys]
    own = table.select(*keys, IS_CURRENT, F.struct(*[c for c in others if c != IS_CURRENT]).alias("was"))
    typed = [F.col(p) if source.schema[p].dataType == kinds[p] else F.col(p).cast(kinds[p]).alias(p) for p in payload]
    new = source.select(*keys, F.lit(True).alias(IS_CURRENT), F.struct(_source_time(source, version_date).alias(SOURCE_TIME), *typed).alias("new"))
    both = own.join(new, [*keys, IS_CURRENT], "full_outer")
    same = F.struct(*(F.col(f"was.{p}") for p in payload)).eqNullSafe(F.struct(*(F.col(f"new.{p}") for p in payload)))
    close = F.greatest(_time(version_date), F.timestamp_add("MILLISECOND", F.lit(1), F.col(f"was.{START}")))

    def version(time: Column, source_name: Column, current: Column | bool, tombstone: Column | bool, start: Column, end: Column, values: list[Column]) -> Column:
        flags = [F.lit(current) if isinstance(current, bool) else current, F.lit(tombstone) if isinstance(tombstone, bool) else tombstone]
        fixed = dict(zip((SOURCE_TIME, RECORD_SOURCE, IS_CURRENT, IS_TOMBSTONE, START, END), (time, source_name, *flags, start, end), strict=True))
        return F.struct(*(c.alias(n) for n, c in (fixed | dict(zip(payload, values, strict=True))).items()))

    was = lambda c: F.col(f"was.{c}")
    own_values, new_values = ([F.col(f"{side}.{p}") for p in payload] for side in ("was", "new"))
    kept = version(was(SOURCE_TIME), was(RECORD_SOURCE), F.col(IS_CURRENT), was(IS_TOMBSTONE), was(START), was(END), own_values)
    closed = version(was(SOURCE_TIME), was(RECORD_SOURCE), False, was(IS_TOMBSTONE), was(START), close, own_values)
    opened = lambda start: version(F.col(f"new.{SOURCE_TIME}"), F.lit(record_source), True, False, start, _time(HIGH_DATE), new_values)
    absent = [F.lit(None).cast(kinds[p]) for p in payload]
    tombstone = version(_time(version_date), F.lit(record_source), False, True, close, close, absent)
    stays = F.array(kept) if unchanged else F.slice(F.array(kept), 1, 0)
    gone = F.array(closed, tombstone) if infer_deletes else stays
    rows = (
        F.when(F.col("was").isNull(), F.array(opened(_time(version_date))))
        .when(~F.col(IS_CURRENT), stays)
        .when(F.col("new").isNull(), gone)
        .when(same, stays)
        .otherwise(F.array(closed, opened(close)))
    )
    return both.select(*keys, F.inline(rows)).select(*sat.columns)


def replay(sat: Satellite, table: DataFrame, changes: DataFrame, order: list[str], version_date: datetime, record_source: str, action: str = "dv_cdc_action", unchanged: bool = True) -> DataFrame:
    """The rows of ``table`` after several changes for each key, loaded in the order given, at once.

    ``action`` is ``D`` for a delete, anything else an upsert. A change that leaves the state as it is
    (an equal payload, a delete of what isn't there) is dropped; as a dropped change carries the state of
    the one before, one look back is enough. Change i of a key starts i microseconds after the version
    date. Deletes keep their staged payload in the tombstone. Current rows and changes are shuffled once, by
    key, and sorted there, so the changes of one key meet in one task, as replaying them in order asks for;
    keys without a change and rows that have ended pass through, unless ``unchanged`` is false.
    """
    keys, payload = list(sat.keys), list(sat.payload)
    own = table.where(F.col(IS_CURRENT))
    by_key = Window.partitionBy(*keys)
    rn = F.row_number().over(by_key.orderBy(*order))
    time = _source_time(changes, version_date)
    state = lambda deleted, values: F.struct(deleted.alias("gone"), *(F.when(~deleted, v).alias(p) for v, p in zip(values, payload, strict=True)))
    steps = changes.select(*keys, rn.alias("rn"), (F.coalesce(F.col(action), F.lit("")) == "D").alias("gone"), time.alias(SOURCE_TIME), *payload)
    first = own.select(*keys, F.lit(0).alias("rn"), F.lit(False).alias("gone"), SOURCE_TIME, *payload, START, RECORD_SOURCE)
    timeline = first.unionByName(steps, allowMissingColumns=True).withColumn("state", state(F.col("gone"), [F.col(p) for p in payload]))
    nothing = F.struct(F.lit(True).alias("gone"), *(F.lit(None).cast(table.schema[p].dataType).alias(p) for p in payload))
    before = F.coalesce(F.lag("state").over(by_key.orderBy("rn")), nothing)
    kept = timeline.withColumn("before", before).where((F.col("rn") == 0) | ~F.col("state").eqNullSafe(F.col("before")))
    starts = F.coalesce(F.col(START), F.timestamp_add("MICROSECOND", F.col("rn"), F.greatest(_time(version_date), F.coalesce(F.max(F.timestamp_add("MILLISECOND", F.lit(1), F.col(START))).over(by_key), _time(version_date)))))
    placed = kept.withColumn("__start", starts).withColumn("__next", F.lead("__start").over(by_key.orderBy("rn")))
    ends = F.col("__next")
    end = F.when(F.col("gone"), F.col("__start")).otherwise(F.coalesce(ends, _time(HIGH_DATE)))
    current = ~F.col("gone") & ends.isNull()
    placed = placed if unchanged else placed.where((F.col("rn") > 0) | ends.isNotNull())
    rows = placed.select(
        *keys,
        SOURCE_TIME,
        F.coalesce(RECORD_SOURCE, F.lit(record_source)).alias(RECORD_SOURCE),
        current.alias(IS_CURRENT),
        F.col("gone").alias(IS_TOMBSTONE),
        F.col("__start").alias(START),
        end.alias(END),
        *payload,
    )
    return rows.unionByName(table.where(~F.col(IS_CURRENT)).select(*sat.columns)) if unchanged else rows


def duplicate_versions(sat: Satellite, table: DataFrame) -> DataFrame:
    """(keys, start, n) of versions of a key that start at the same time; a sound satellite has none."""
    return table.groupBy(*sat.keys, START).agg(F.count("*").alias("n")).where("n > 1")
