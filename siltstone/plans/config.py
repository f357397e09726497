"""Configuration of a vault: what there is, checked when it is put together."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable
from dataclasses import dataclass, field

from siltstone.functions.naming import next_abbreviation
from siltstone.functions.types import ColumnDef
from siltstone.sources.stage import LOAD_TYPES, Source


@dataclass(frozen=True)
class HubConfig:
    """types: declared types of keys that aren't strings, for a hub that is created before its first load."""

    name: str
    keys: tuple[str, ...]
    release: int = 0
    types: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class LinkConfig:
    """roles: role name to hub name; two roles may go to one hub."""

    name: str
    roles: dict[str, str]
    release: int = 0


@dataclass(frozen=True)
class SatelliteConfig:
    """parent: a hub or a link; columns: stage column to declared column; computed: (column, expression) in order.

    buckets: into how many its current rows are dealt, for good. runs: how many loads may lie beside the base before
    they are folded into it.
    """

    name: str
    parent: str
    parent_kind: str
    columns: dict[str, ColumnDef]
    computed: tuple[tuple[str, str], ...] = ()
    duplicate_threshold: int = 0
    release: int = 0
    abbreviation: str | None = None
    buckets: int = 64
    runs: int = 16


@dataclass(frozen=True)
class SourceConfig:
    """hub_columns: hub or role name to (stage column to business key). stages: how many last batches stay readable."""

    source: Source
    hub_columns: dict[str, dict[str, str]]
    link: str | None = None
    satellites: tuple[str, ...] = ()
    source_date: str | None = None
    release: int = 0
    stages: int = 2

    @property
    def name(self) -> str:
        return self.source.name


@dataclass(frozen=True)
class MatchConfig:
    """A comparison of two objects, each (kind, name); columns: (left, right) names that are compared."""

    name: str
    left: tuple[str, str]
    right: tuple[str, str]
    columns: tuple[tuple[str, str], ...]
    release: int = 0


@dataclass(frozen=True)
class ConnectionConfig:
    """Where sources are read from: a format and its reader options. Passwords are no part of it."""

    name: str
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)
    release: int = 0


@dataclass(frozen=True)
class SystemConfig:
    """A source system: what its feeds have in common."""

    name: str
    connection: str | None = None
    time_zone: str = "UTC"
    release: int = 0


@dataclass(frozen=True)
class VersionConfig:
    """A version of a source: from when it holds, and which one is in use."""

    name: str
    source: str
    number: int
    active: bool = True
    release: int = 0


@dataclass(frozen=True)
class FunctionConfig:
    """A named expression template for computed columns."""

    name: str
    template: str
    release: int = 0


@dataclass(frozen=True)
class DefaultConfig:
    """A default value, by its name."""

    name: str
    value: str
    release: int = 0


class ConfigError(ValueError):
    """A configuration that can't be loaded."""


#: Kinds of rows; what others depend on comes first.
KINDS = {
    "default": DefaultConfig, "function": FunctionConfig, "connection": ConnectionConfig, "system": SystemConfig, "hub": HubConfig, "link": LinkConfig,
    "satellite": SatelliteConfig, "source": SourceConfig, "version": VersionConfig, "match": MatchConfig,
}


@dataclass
class Registry:
    """All configuration rows, by kind and name."""

    releases: set[int] = field(default_factory=lambda: {0})
    builds: dict[int, int] = field(default_factory=dict)
    rows: dict[str, dict[str, object]] = field(default_factory=lambda: {k: {} for k in KINDS})

    def add_release(self, number: int) -> None:
        if number in self.releases:
            raise ConfigError(f"release {number} exists")
        self.releases.add(number)

    def drop_release(self, number: int) -> None:
        """Only one that no row belongs to."""
        held = sorted(f"{kind} {name}" for kind, rows in self.rows.items() for name, row in rows.items() if row.release == number)
        if held or number not in self.releases:
            raise ConfigError(f"release {number} holds {held}" if held else f"release {number} does not exist")
        self.releases.discard(number)
        self.builds.pop(number, None)

    def insert(self, kind: str, row) -> object:
        if row.release not in self.releases:
            raise ConfigError(f"release {row.release} does not exist")
        if row.name in self.rows[kind]:
            raise ConfigError(f"{kind} {row.name} exists")
        self.rows[kind][row.name] = row
        return row

    def update(self, kind: str, name: str, **changes) -> object:
        """All fields but the release may change; see ``move``."""
        if "release" in changes:
            raise ConfigError("an update does not move a row to another release")
        self.rows[kind][name] = dataclasses.replace(self.get(kind, name), **changes)
        return self.rows[kind][name]

    def delete(self, kind: str, name: str) -> None:
        self.get(kind, name)
        del self.rows[kind][name]

    def get(self, kind: str, name: str):
        if name not in self.rows[kind]:
            raise ConfigError(f"{kind} {name} does not exist")
        return self.rows[kind][name]

    def move(self, kind: str, name: str, release: int) -> None:
        if release not in self.releases:
            raise ConfigError(f"release {release} does not exist")
        self.rows[kind][name] = dataclasses.replace(self.get(kind, name), release=release)

    def empty(self) -> None:
        """Delete every row, those that others depend on last."""
        for kind in reversed(KINDS):
            self.rows[kind].clear()

    def move_all(self, release: int) -> None:
        """Every row becomes one of this release."""
        for kind, rows in self.rows.items():
            for name in list(rows):
                self.move(kind, name, release)

    def recreate_satellite(self, name: str, stage: list[ColumnDef], **changes) -> SatelliteConfig:
        """The satellite anew, with the columns that its stage has now and the next abbreviation."""
        old: SatelliteConfig = self.get("satellite", name)
        last = max((s.abbreviation for s in self.rows["satellite"].values() if s.abbreviation), default=None)
        gone = [c for c in old.columns if c not in {d.name for d in stage}]
        kept = {c: dataclasses.replace(old.columns[c], retired=True) for c in gone}
        self.rows["satellite"][name] = dataclasses.replace(old, columns=satellite_columns(stage) | kept, abbreviation=next_abbreviation(last), **changes)
        return self.rows["satellite"][name]

    def declare(self, source: str, columns: Iterable[ColumnDef], rerun: bool = False) -> SourceConfig:
        """Set the declared columns of a source. Ones that are there are only replaced on a rerun."""
        old: SourceConfig = self.get("source", source)
        if old.source.declared and not rerun:
            raise ConfigError(f"{source} has {len(old.source.declared)} declared columns; a rerun replaces them")
        return self.update("source", source, source=dataclasses.replace(old.source, declared=tuple(columns)))

    def matches(self) -> list[dict[str, str]]:
        """Every compared column of every match, with the names that both sides have."""
        return [
            {"match": m.name, "left_kind": m.left[0], "left_object": m.left[1], "left_column": a, "right_kind": m.right[0], "right_object": m.right[1], "right_column": b}
            for m in self.rows["match"].values() for a, b in m.columns
        ]

    def stages(self) -> list[dict[str, str | None]]:
        """The sources whose version is in use, or that have no versions, with kind and place."""
        retired = {v.source for v in self.rows["version"].values()} - {v.source for v in self.rows["version"].values() if v.active}
        return [{"source": n, "load_type": s.source.load_type, "kind": s.source.kind, "path": s.source.path} for n, s in sorted(self.rows["source"].items()) if n not in retired]

    def default(self, name: str, otherwise: str | None = None) -> str | None:
        found = self.rows["default"].get(name)
        return found.value if found else otherwise

    def check(self, name: str) -> SourceConfig:
        """A source may feed one link at most; without a link it feeds one hub; everything must exist."""
        found: SourceConfig = self.get("source", name)
        if found.source.load_type not in LOAD_TYPES:
            raise ConfigError(f"{name}: unknown load type {found.source.load_type}")
        if found.link is None:
            if len(found.hub_columns) != 1:
                raise ConfigError(f"{name}: without a link it must feed exactly one hub")
            hubs: Iterable[str] = found.hub_columns
        else:
            link: LinkConfig = self.get("link", found.link)
            if set(link.roles) != set(found.hub_columns):
                raise ConfigError(f"{name}: the roles of link {link.name} are {sorted(link.roles)}")
            hubs = link.roles.values()
        for h in hubs:
            self.get("hub", h)
        kinds = {(self.get("satellite", s).parent_kind, self.get("satellite", s).parent) for s in found.satellites}
        if len({k for k, _ in kinds}) > 1:
            raise ConfigError(f"{name}: satellites of hubs and of links")
        return found


def satellite_columns(stage: list[ColumnDef], retired: Iterable[str] = ()) -> dict[str, ColumnDef]:
    """A satellite's columns from a stage table's: technical ones (``dv_``) first, then by name."""
    ordered = sorted(stage, key=lambda c: (not c.name.startswith("dv_"), c.name))
    return {c.name: dataclasses.replace(c, retired=c.name in set(retired)) for c in ordered}
