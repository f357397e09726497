"""Loading one source from end to end: stage, hubs, link, satellites, states."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.macros import computed
from siltstone.functions.marks import as_text, from_text
from siltstone.functions.naming import CDC_ACTION, END, SOURCE_TIME, START, key_name, object_name
from siltstone.functions.types import spark_type
from siltstone.operators import compare, duplicates, hub, link, lookup, metrics, satellite, temporal
from siltstone.plans.config import ConfigError, HubConfig, LinkConfig, MatchConfig, Registry, SatelliteConfig, SourceConfig
from siltstone.plans.state import JOURNAL_SCHEMA, TASK_SCHEMA, Journal, Log, last_mark
from siltstone.plans.store import ADD, WHOLE, Table
from siltstone.sources.stage import Source, high_water, read, stage, vault_rows


class NotUnique(ValueError):
    """A hub or link that holds a key more than once."""


@dataclass
class Vault:
    """A registry of configuration and the root folder of its tables."""

    spark: SparkSession
    root: str
    registry: Registry = field(default_factory=Registry)

    def table(self, kind: str, name: str) -> Table:
        """kind: ``hub``, ``link``, ``sat``, or ``stage``, the last batches of a source."""
        place = (self.spark, self.root, f"{kind}/{object_name(kind, name)}")
        if kind != "sat":
            return Table(*place)
        s: SatelliteConfig = self.registry.get("satellite", name)
        return Table(*place, (key_name(s.parent_kind, s.parent),), s.buckets)

    @property
    def states(self) -> Log:
        return Log(self.spark, f"{self.root}/task_state", TASK_SCHEMA)

    @property
    def journal(self) -> Journal:
        return Journal(Log(self.spark, f"{self.root}/journal", JOURNAL_SCHEMA))

    def create(self, kind: str, name: str) -> Table:
        """An empty hub, link or satellite by its declared columns; one that exists stays as it is."""
        table = self.table(kind, name)
        if table.latest() is None:
            empty = {"hub": empty_hub, "link": empty_link, "sat": empty_satellite}[kind]
            table.commit(empty(self.spark, self.registry.get("satellite" if kind == "sat" else kind, name)))
        return table

    def check_unique(self, kind: str, name: str) -> None:
        """A hub must hold each business key once, a link each combination of roles, a satellite each start of a key."""
        config = self.registry.get("satellite" if kind == "sat" else kind, name)
        keys = {"hub": lambda: list(config.keys), "link": lambda: [key_name("hub", r) for r in config.roles], "sat": lambda: [key_name(config.parent_kind, config.parent), START, END]}[kind]()
        rows = self.table(kind, name).read()
        found = [] if rows is None else duplicates.duplicate_keys(rows, keys).limit(1).collect()
        if found:
            raise NotUnique(f"{object_name(kind, name)}: {found[0].asDict()}")

    def read_object(self, kind: str, name: str, at: datetime | None = None) -> DataFrame:
        """One side of a comparison: a hub, a link with the business keys of its hubs, a satellite at a time, or a staged source."""
        if kind == "stage":
            return read(self.spark, self.registry.get("source", name).source, "Full")
        rows = self.table(kind, name).read()
        if rows is None:
            raise ConfigError(f"{object_name(kind, name)} was never loaded")
        if kind == "sat":
            return temporal.point_in_time(rows, at)
        if kind == "link":
            roles = self.registry.get("link", name).roles
            hubs = {key_name("hub", r): (self.table("hub", h).read(), key_name("hub", h), list(self.registry.get("hub", h).keys)) for r, h in roles.items()}
            return compare.link_business_keys(rows, hubs)
        return rows

    def column_list(self, kind: str, name: str, alias: str | None = None) -> list[dict[str, object]]:
        """Name, qualified name, type and nullability of the columns that ``read_object`` gives, in order."""
        prefix = alias or object_name(kind, name)
        fields = self.read_object(kind, name).schema.fields
        return [{"name": f.name, "qualified": f"{prefix}.{f.name}", "type": f.dataType.simpleString(), "nullable": f.nullable} for f in fields]

    def compared(self, match: str, at: datetime | None = None) -> DataFrame:
        """What only one side of a configured match has."""
        m: MatchConfig = self.registry.get("match", match)
        sides = [self.read_object(kind, name, at) for kind, name in (m.left, m.right)]
        return compare.left_right(*sides, list(m.columns), (object_name(*m.left), object_name(*m.right)))

    def profile(self, kind: str, name: str, columns: list[str]) -> DataFrame:
        """``merged_profile`` of a hub or a link, of which only the loads since the last call are read.

        What each call finds is kept as a row beside the table; other columns, or a table that was rewritten, begin anew.
        """
        table = self.table(kind, name)
        parts, now = Table(self.spark, self.root, f"profile/{object_name(kind, name)}"), table.latest()
        if now is None or table.keys:
            raise ConfigError(f"{object_name(kind, name)} " + ("was never loaded" if now is None else "is not only added to"))
        last = parts.latest()
        known = {v.number: v for v in table.versions()}
        since = known.get(last.note["upto"]) if last and last.note["columns"] == columns else None
        if since and any(v.kind == WHOLE for v in known.values() if v.number > since.number):
            since = None
        if since is None or since.number < now.number:
            part = metrics.profile_part(table.added(since, now), columns)
            last = parts.commit(part, ADD if since else WHOLE, {"upto": now.number, "columns": columns})
        return metrics.merged_profile(parts.read(last), columns)

    def load(self, name: str, run_type: str, at: datetime, run: int = 0, after=None, until=None) -> dict[str, int]:
        """Load a source; every target commits on its own, and a failed load can be repeated.

        The batch is written to the stage first, and hubs, links and satellites read it from there, so the source
        is read once. A delta of a source with a sequence goes on after the mark of the last load of its satellites
        (else of its stage) if ``after`` isn't given; the mark it reaches is noted with the state of every
        target, and it is an error if there is none. The marks of a source that is a satellite of this vault are
        versions of its table. What is set aside as duplicate, and how the load ends, goes to the journal.
        """
        with self.journal.guarded(at, run, name):
            return self._load(name, run_type, at, run, after, until)

    def _load(self, name: str, run_type: str, at: datetime, run: int, after, until) -> dict[str, int]:
        config = self.registry.check(name)
        rows, mark, n = self._staged(config, run_type, at, after, until)
        config = replace(config, source=replace(config.source, sequence=_order(config.source)))
        counts = {name: n}
        feeds: dict[str, list[dict[str, str]]] = {}
        for role, columns in config.hub_columns.items():
            feeds.setdefault(self._hub_of(config, role), []).append(columns)
        for hub_name, columns in feeds.items():
            counts |= self._hub(config, rows, hub_name, columns, at)
        looked_up = self._lookup(config, rows)
        if config.link:
            counts |= self._link(config, looked_up, at)
            looked_up = self._link_lookup(config, looked_up)
        looked_up = looked_up.persist()  # every satellite reads it; lost parts are computed from stored tables
        try:
            for s in config.satellites:
                counts |= self._satellite(config, looked_up, s, run_type, at, run)
        finally:
            looked_up.unpersist()
        kinds = {**{o: {"h": "hub", "l": "link", "s": "sat"}[o.split("_")[0]] for o in counts if o != name}, name: "stage"}
        self.states.append([(name, o, kinds[o], run, n, mark, at, datetime.now()) for o, n in counts.items()])
        return counts

    def _staged(self, config: SourceConfig, run_type: str, at: datetime, after, until) -> tuple[DataFrame, str | None, int]:
        """The batch as it was stored, its mark and its number of rows, both from the one pass that stored it."""
        source, last = config.source, self.states.read()
        name, delta = source.name, run_type == "Delta" and source.load_type != "Full"
        keys = [c for columns in config.hub_columns.values() for c in columns]
        if source.kind == "match":
            source = replace(source, kind="callable", reader=lambda s, r: self.compared(source.match, at))
        own_mark = None
        if source.kind == "satellite" and source.satellite:
            table = self.table("sat", source.satellite)
            known = {v.number: v for v in table.versions()}
            last_seen = after if after is not None else last_mark(last, name) if delta else None
            since, upto = known.get(int(last_seen or 0)), known[until] if until is not None else table.latest()
            if last_seen and since is None:
                raise ValueError(f"{name}: version {last_seen} of {source.satellite} is no longer there; a full load begins anew")
            if upto is None:
                raise ConfigError(f"{object_name('sat', source.satellite)} was never loaded")
            own_mark, taken = str(upto.number), run_type if delta else "Full"
            columns = source.columns and tuple(dict.fromkeys((*source.columns, CDC_ACTION, START)))
            source = replace(source, kind="callable", reader=lambda s, r: vault_rows(table, taken, since, upto), columns=columns, sequence=None)
            after = until = None
        kind = read(self.spark, source, run_type).schema[source.sequence].dataType if source.sequence else None
        if delta and source.sequence and after is None:
            found = last_mark(last, name)
            after = None if found is None else from_text(found, kind)
        batch = stage(self.spark, source, run_type, at, after, until, keys)
        batch = batch.select(*(F.col(f.name).cast("string") if isinstance(f.dataType, T.NullType) else F.col(f.name) for f in batch.schema))
        reached = {"mark": as_text(F.max(source.sequence) if until is None else F.lit(until).cast(kind), kind)} if source.sequence else {}
        table = self.table("stage", name)
        version = table.commit(batch, WHOLE, observed=reached)
        table.vacuum(config.stages)
        mark = own_mark
        if source.sequence:
            batch_mark = [(version.note["observed"]["mark"],)] if version.note["rows"] or until is not None else []
            mark = high_water(self.spark.createDataFrame(batch_mark, "mark string"), "mark", last, name)
            if delta and mark is None:
                raise ValueError(f"{name}: a delta without a high-water mark")
        return table.read(version), mark, version.note["rows"]

    def _hub_of(self, config: SourceConfig, role: str) -> str:
        return self.registry.get("link", config.link).roles[role] if config.link else role

    def _hub(self, config: SourceConfig, rows: DataFrame, name: str, feeds: list[dict[str, str]], at: datetime) -> dict[str, int]:
        """All roles of the source that go to this hub, at once."""
        table = self.table("hub", name)
        keys = list(self.registry.get("hub", name).keys)
        staged = [rows.select(*(F.col(s).alias(b) for s, b in columns.items())) for columns in feeds]
        new = hub.new_rows(staged, table.read(), name, keys, at, str(config.source.version))
        return {object_name("hub", name): self._appended(table, new)}

    def _lookup(self, config: SourceConfig, rows: DataFrame) -> DataFrame:
        for role, columns in config.hub_columns.items():
            name = self._hub_of(config, role)
            alias = key_name("hub", role)
            default = None if config.link else -999
            rows = lookup.hub_key(rows, self.table("hub", name).read(), columns, key_name("hub", name), alias, default)
        return rows

    def _link(self, config: SourceConfig, rows: DataFrame, at: datetime) -> dict[str, int]:
        table, roles = self.table("link", config.link), [key_name("hub", r) for r in config.hub_columns]
        new = link.new_rows(rows, table.read(), config.link, roles, at, str(config.source.version))
        return {object_name("link", config.link): self._appended(table, new)}

    @staticmethod
    def _appended(table: Table, new: DataFrame) -> int:
        """How many rows were added; no version is made of none."""
        before = table.latest()
        version = table.commit(new, base=before, skip_empty=True)
        return 0 if before and version.number == before.number else version.note["rows"]

    def _link_lookup(self, config: SourceConfig, rows: DataFrame) -> DataFrame:
        roles = [key_name("hub", r) for r in config.hub_columns]
        return lookup.link_key(rows, self.table("link", config.link).read(), roles, key_name("link", config.link))

    def _satellite(self, config: SourceConfig, rows: DataFrame, name: str, run_type: str, at: datetime, run: int) -> dict[str, int]:
        s: SatelliteConfig = self.registry.get("satellite", name)
        key = key_name(s.parent_kind, s.parent)
        cdc = config.source.load_type in ("DateCdc", "SequenceCdc") and run_type == "Delta"
        extra = [key] + ([CDC_ACTION, config.source.sequence] if cdc else [])
        source = lookup.payload(rows, s.columns, extra) if not config.source_date else lookup.payload(rows.withColumn(SOURCE_TIME, F.col(config.source_date)), s.columns, [*extra, SOURCE_TIME])
        source = computed(source, list(s.computed))
        payload = [*(c.name for c in s.columns.values()), *(n for n, _ in s.computed)]
        shape = satellite.Satellite((key,), tuple(payload))
        table = self.table("sat", name)
        infer = run_type == "Full" and config.source.load_type != "Delta"
        if not cdc:
            source, aside = duplicates.apply_policy(source, [key], s.duplicate_threshold)
            if aside is not None:
                self.journal.write_rows(aside, at, run, object_name("sat", name), "warning", duplicates.REMOVED)
        version = table.latest()
        before = None if version is None else table.read(version, "current") if infer else table.current_of(source, version)
        if before is None:
            before = satellite.initial(shape, source, at, "").limit(0)
        source_name = str(config.source.version)
        if cdc:
            done = satellite.replay(shape, before, source, [config.source.sequence], at, source_name, unchanged=False)
        else:
            done = satellite.merge(shape, before, source, at, source_name, infer, unchanged=False)
        written = table.commit(done, base=version)
        if len(written.runs) > s.runs:
            table.compact(history=False)
        return {object_name("sat", name): written.note["rows"]}


def _order(source: Source) -> str | None:
    """The column in whose order a key's changes are replayed; what a satellite gives has one change for each key."""
    return START if source.kind == "satellite" and source.satellite else source.sequence


_LOADED = "dv_load_date_time timestamp_ntz, dv_record_source string"


def empty_hub(spark: SparkSession, config: HubConfig) -> DataFrame:
    """A hub of no rows, by its declared keys."""
    own = ", ".join(f"`{k}` {config.types.get(k, 'string')}" for k in config.keys)
    return spark.createDataFrame([], f"{key_name('hub', config.name)} long, {_LOADED}, {own}")


def empty_link(spark: SparkSession, config: LinkConfig) -> DataFrame:
    """A link of no rows, by its roles."""
    own = ", ".join(f"`{key_name('hub', r)}` long" for r in config.roles)
    return spark.createDataFrame([], f"{key_name('link', config.name)} long, {_LOADED}, {own}")


def empty_satellite(spark: SparkSession, config: SatelliteConfig) -> DataFrame:
    """A satellite of no rows, by its declared and its computed columns."""
    own = ", ".join(f"`{c.name}` {spark_type(c).simpleString()}" for c in config.columns.values())
    key = key_name(config.parent_kind, config.parent)
    rows = computed(spark.createDataFrame([], f"{key} long, {own}"), list(config.computed))
    payload = tuple(c for c in rows.columns if c != key)
    return satellite.initial(satellite.Satellite((key,), payload), rows, datetime(1900, 1, 1), "")
