"""Tables of a vault as plain Parquet folders, with a list of the loads that count.

A load writes one folder, ``data/<load>``, and changes none: rows that are added for good or have ended under
``__part=history`` and, where the table has keys, what is current now under ``__part=current``, bucketed and sorted
by key. So a load's size follows what it changes. Current rows are merged when they are read: the oldest load
with current rows is the base, later ones are runs beside it, and of a key the newest run counts; a
tombstone in a run hides its key. The base is only filtered by the runs' keys, and being bucketed it is never
shuffled for that, nor to be joined by key; ``compact`` folds the runs into a new base.

``versions`` has a row for each load that was finished. So a reader knows its folders by name and lists no
others, sees a load as a whole or not at all, and may read any version that ``vacuum`` has left; what a crash
leaves is never read. Everything is written and read by Spark alone, so the root may be any store that it knows.
Writers of one table take turns.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.naming import IS_CURRENT, IS_TOMBSTONE
from siltstone.plans.shared import exists

#: Buckets of current rows, by a hash of their keys, unless a table is given another number.
BUCKETS = 64
_VERSION = "load string, kind string, parts array<string>, schema string, note string, ledger map<string,long>, history array<string>"
_PART = "__part"
#: A load adds to what there is, puts itself in place of the current rows (which it has folded) or in place of everything.
ADD, FOLD, WHOLE = "add", "fold", "whole"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Version:
    """base, runs: loads with current rows, in their order; history: loads with other rows; ledger: the last batch of each stream."""

    number: int
    schema: T.StructType
    load: str
    kind: str = ADD
    parts: tuple[str, ...] = ()
    base: str | None = None
    runs: tuple[str, ...] = ()
    history: tuple[str, ...] = ()
    note: dict = field(default_factory=dict)
    ledger: dict[str, int] = field(default_factory=dict)

    @property
    def loads(self) -> set[str]:
        return {*self.history, *self.runs, *([self.base] if self.base else [])}


def _after(before: Version | None, row: dict) -> Version:
    """The version that a row of ``versions`` makes of the one before it."""
    base, runs, history = (before.base, before.runs, before.history) if before else (None, (), ())
    if row["kind"] in (FOLD, WHOLE):  # such a row says all; none before it is needed
        base, runs, history = None, (), tuple(row["history"])
    if "current" in row["parts"]:
        base, runs = (base, (*runs, row["load"])) if base else (row["load"], runs)
    if "history" in row["parts"]:
        history = (*history, row["load"])
    schema = T.StructType.fromJson(json.loads(row["schema"]))
    return Version(row["number"], schema, row["load"], row["kind"], tuple(row["parts"]), base, runs, history, json.loads(row["note"]), dict(row["ledger"]))


@dataclass(frozen=True)
class Table:
    """keys: whose rows replace each other; a table without keys is only added to.

    n_buckets stays the same for as long as the table lives; a large satellite takes as many as give buckets of a
    task's size. current, tombstone: boolean columns of a table with keys; rows that are neither are history.
    """

    spark: SparkSession
    root: str
    name: str
    keys: tuple[str, ...] = ()
    n_buckets: int = BUCKETS
    current: str = IS_CURRENT
    tombstone: str = IS_TOMBSTONE

    @property
    def path(self) -> str:
        return f"{self.root}/{self.name}"

    def versions(self) -> list[Version]:
        """All versions in their order; none if nothing was committed."""
        if not exists(self.spark, f"{self.path}/versions"):
            return []
        rows = self.spark.read.schema(f"{_VERSION}, number int").parquet(f"{self.path}/versions").collect()
        out: list[Version] = []
        for r in sorted(rows, key=lambda r: r["number"]):
            out.append(_after(out[-1] if out else None, r.asDict()))
        return out

    def latest(self) -> Version | None:
        return next(iter(reversed(self.versions())), None)

    def version(self, number: int) -> Version:
        found = next((v for v in self.versions() if v.number == number), None)
        if found is None:
            raise ValueError(f"{self.path}: there is no version {number}")
        return found

    def _current(self, load: str, schema: T.StructType) -> DataFrame:
        """What a load wrote as current, tombstones included, with its buckets known to Spark.

        Only a table of the session's catalog can tell Spark of buckets; it is dropped at once, its files stay.
        """
        name, columns = f"siltstone_{uuid4().hex}", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        keys, path = ", ".join(f"`{k}`" for k in self.keys), f"{self.path}/data/{load}/{_PART}=current".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) INTO {self.n_buckets} BUCKETS LOCATION '{path}'")
        try:
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def _history(self, loads: tuple[str, ...], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{load}/{_PART}=history" for load in loads))

    def _newest(self, sides: list[DataFrame], dealt: bool = False) -> DataFrame:
        """Of each key the row of the last side that has it; within a side a current row counts before a tombstone.

        dealt: in the buckets of the base, so that both can be united without a shuffle of it.
        """
        numbered = (rows.select(*self.keys, F.struct(F.lit(k).alias("side"), F.col(self.current).alias("now")).alias("__at"), F.struct("*").alias("__row")) for k, rows in enumerate(sides))
        every = reduce(DataFrame.unionByName, numbered)
        every = every.repartition(self.n_buckets, *self.keys) if dealt else every
        newest = every.groupBy(*self.keys).agg(F.max_by("__row", "__at").alias("__row"))
        return newest.select(*self.keys, *(F.col(f"__row.{c}").alias(c) for c in sides[0].columns if c not in self.keys)).select(*sides[0].columns)

    def read(self, version: Version | None = None, part: str = "all", schema: T.StructType | None = None) -> DataFrame | None:
        """part: ``current``, ``history`` or all of a version (None: the latest). schema: to read older rows by; the version's own if None.

        None: there is no version yet.
        """
        version = version or self.latest()
        if version is None:
            return None
        schema, found = schema or version.schema, []
        if part in ("current", "all") and version.base:
            rows = self._current(version.base, schema)
            if version.runs:
                runs = [self._current(load, schema) for load in version.runs]
                seen = reduce(DataFrame.unionByName, (r.select(*self.keys) for r in runs))
                rows = rows.join(seen, list(self.keys), "left_anti").select(*schema.names).unionByName(self._newest(runs, dealt=True))
            found.append(rows.where(F.col(self.current)))
        if part in ("history", "all") and version.history:
            found.append(self._history(version.history, schema))
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], schema)

    def current_of(self, keys: DataFrame, version: Version | None = None) -> DataFrame | None:
        """The current rows of these keys alone: base and runs are filtered, and only what is left is merged."""
        version = version or self.latest()
        if version is None:
            return None
        wanted = keys.select(*self.keys).distinct()
        sides = [self._current(load, version.schema).join(wanted, list(self.keys), "left_semi").select(*version.schema.names) for load in (version.base, *version.runs) if load]
        return self._newest(sides).where(F.col(self.current)) if sides else self.spark.createDataFrame([], version.schema)

    def changes(self, since: Version | None, until: Version | None = None, net: bool = False) -> DataFrame:
        """The state at ``until`` of each key that a load after ``since`` has touched: its current row, or a tombstone.

        Only the loads between the two are read; where one of them replaced everything, both states are compared. Since
        None: all current rows.
        net: without keys that are again as they were at ``since``, and tombstones of keys that weren't there; the state at
        ``since`` is then read for the touched keys.
        """
        until = until or self.latest()
        if since is None:
            return self.read(until, "current")
        between = [v for v in self.versions() if since.number < v.number <= until.number and v.kind != FOLD]
        if any(v.kind == WHOLE for v in between):
            now, was = self.read(until, "current"), self.read(since, "current", until.schema)
            gone = was.join(now, list(self.keys), "left_anti").withColumns({self.current: F.lit(False), self.tombstone: F.lit(True)})
            touched, net = now.unionByName(gone), True
        else:
            sides = [self._current(v.load, until.schema) for v in between if "current" in v.parts]
            touched = self._newest(sides) if sides else self.spark.createDataFrame([], until.schema)
        if not net:
            return touched
        others = [c for c in until.schema.names if c not in self.keys]
        was = (self.current_of(touched, since) if not any(v.kind == WHOLE for v in between) else was).select(*self.keys, F.struct(*(F.col(c) if c in since.schema.names else F.lit(None).cast(until.schema[c].dataType).alias(c) for c in others)).alias("__was"))
        both = touched.join(was, list(self.keys), "left")
        same = (F.col(self.current) & F.struct(*others).eqNullSafe(F.col("__was"))) | (~F.col(self.current) & F.col("__was").isNull())
        return both.where(~same).select(*touched.columns)

    def added(self, since: Version | None, until: Version) -> DataFrame:
        """The rows that loads after ``since`` up to ``until`` added for good; only those loads are read.

        Where one of them replaced everything, all rows are given.
        """
        between = [v for v in self.versions() if (since.number if since else 0) < v.number <= until.number]
        whole = any(v.kind == WHOLE for v in between)
        loads = until.history if whole else tuple(v.load for v in between if "history" in v.parts and v.kind == ADD)
        return self._history(loads, until.schema) if loads else self.spark.createDataFrame([], until.schema)

    def commit(self, rows: DataFrame, kind: str = ADD, note: dict | None = None, base: Version | None = None, ledger: dict[str, int] | None = None, observed: dict[str, Column] | None = None, skip_empty: bool = False) -> Version:
        """Write rows once and publish them as the next version.

        With keys, ``rows`` has what changes: new current rows, rows that ended, tombstones. Rows are counted as
        they are written (``rows`` of the note), and ``observed`` aggregates with them (under ``observed``). skip_empty:
        no version is made of no rows if there is one.
        """
        before = base or self.latest()
        number, load = (before.number + 1 if before else 1), uuid4().hex
        parts = F.array(F.lit("history"))
        if self.keys:
            gone = F.col(self.tombstone) if self.tombstone in rows.columns else F.lit(False)
            parts = F.when(F.col(self.current), F.array(F.lit("current"))).when(gone, F.array(F.lit("history"), F.lit("current"))).otherwise(parts)
        placed = rows.withColumn(_PART, F.explode(parts))
        place = f"{self.path}/data/{load}"
        counts = {"current": F.count_if(F.col(_PART) == "current"), "history": F.count_if(F.col(_PART) == "history"), "rows": F.count_if((F.col(_PART) == "history") | F.col(self.current)) if self.keys else F.count("*")}
        seen = Observation()
        if self.keys:
            tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            tasks = max(n for n in range(1, self.n_buckets + 1) if self.n_buckets % n == 0 and n <= max(1, tasks))  # a bucket is one task's then
            dealt = placed if kind == FOLD else placed.repartition(tasks, *self.keys)
            name = f"siltstone_{uuid4().hex}"
            written = dealt.observe(seen, *(c.alias(n) for n, c in (counts | (observed or {})).items())).write.partitionBy(_PART)
            written.bucketBy(self.n_buckets, *self.keys).sortBy(*self.keys).format("parquet").option("path", place).saveAsTable(name)
            self.spark.sql(f"DROP TABLE {name}")
        else:
            placed.observe(seen, *(c.alias(n) for n, c in (counts | (observed or {})).items())).write.partitionBy(_PART).parquet(place)
        found = seen.get
        if skip_empty and before and not found["rows"]:
            return before
        note = (note or {}) | {"rows": found["rows"]} | ({"observed": {n: found[n] for n in observed}} if observed else {})
        row = [(load, kind, [p for p in ("current", "history") if found[p]], rows.schema.json(), json.dumps(note), (before.ledger if before else {}) | (ledger or {}), list(before.history) if before and kind == FOLD else [])]
        try:
            self.spark.createDataFrame(row, _VERSION).coalesce(1).write.parquet(f"{self.path}/versions/number={number}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            raise Conflict(f"{self.path}: version {number} exists") from e
        return _after(before, dict(zip(("load", "kind", "parts", "schema", "note", "ledger", "history", "number"), (*row[0], number), strict=True)))

    def compact(self, history: bool = True) -> Version:
        """Fold the runs into a new base; with ``history`` rewrite that too, so that all is one load. Notes and ledger stay."""
        version = self.latest()
        if not self.keys or history:
            return self.commit(self.read(version), WHOLE, version.note)
        return self.commit(self.read(version, "current"), FOLD, version.note)

    def vacuum(self, keep: int = 1) -> int:
        """Delete what none of the last ``keep`` versions names, a crash's remains included; gives the number of folders deleted.

        For a writer, in its turn. Versions before those kept can't be read any more.
        """
        versions = self.versions()
        kept = versions[-keep:]
        named = {load for v in kept for load in v.loads}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = [f.getPath() for f in files.listStatus(path) if f.getPath().getName() not in named] if files.exists(path) else []
        whole = next((v.number for v in reversed(versions) if v.kind != ADD and v.number <= kept[0].number), 0) if kept else 0
        for f in gone:
            files.delete(f, True)
        for v in versions:
            if v.number < whole:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/number={v.number}"), True)
        return len(gone)
