"""Releases: the configuration of a release as JSON lines, written, read and applied by key."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import SparkSession

from siltstone.functions.types import ColumnDef
from siltstone.plans.config import KINDS, ConfigError, Registry, SourceConfig
from siltstone.sources.stage import Source

LOAD_ORDER = tuple(KINDS)


def build(registry: Registry, release: int) -> list[dict]:
    """``rows_of`` under the next build number of the release, which the header names."""
    registry.builds[release] = registry.builds.get(release, 0) + 1
    return rows_of(registry, release)


def rows_of(registry: Registry, release: int) -> list[dict]:
    """A header with the expected counts, then the rows of a release. Readers given as Python code stay out."""
    rows = [(kind, row) for kind in LOAD_ORDER for _, row in sorted(registry.rows[kind].items()) if row.release == release]
    counts = {kind: sum(k == kind for k, _ in rows) for kind in LOAD_ORDER}
    out: list[dict] = [{"kind": "header", "release": release, "build": registry.builds.get(release, 0), "counts": counts}]
    for kind, row in rows:
        body = dataclasses.asdict(row)
        if kind == "source":
            body["source"].pop("reader")
        out.append({"kind": kind, "row": body})
    return out


def export(spark: SparkSession, registry: Registry, release: int, path: str) -> None:
    lines = [(k, json.dumps(r, sort_keys=True)) for k, r in enumerate(rows_of(registry, release))]
    spark.createDataFrame(lines, "n int, value string").coalesce(1).sortWithinPartitions("n").select("value").write.text(path)


def load(spark: SparkSession, path: str) -> list[dict]:
    return [json.loads(r[0]) for r in spark.read.text(path).collect()]


def _row(kind: str, body: dict):
    if kind == "satellite":
        body = body | {"columns": {k: ColumnDef(**c) for k, c in body["columns"].items()}, "computed": tuple(map(tuple, body["computed"]))}
    if kind == "source":
        inner = body["source"]
        source = Source(**inner | {"columns": tuple(inner["columns"]) if inner["columns"] else None, "declared": tuple(ColumnDef(**c) for c in inner["declared"])})
        return SourceConfig(**body | {"source": source, "satellites": tuple(body["satellites"])})
    if kind == "hub":
        body = body | {"keys": tuple(body["keys"])}
    if kind == "match":
        body = body | {"left": tuple(body["left"]), "right": tuple(body["right"]), "columns": tuple(map(tuple, body["columns"]))}
    return KINDS[kind](**body)


def apply(registry: Registry, rows: list[dict]) -> dict[str, int]:
    """Insert or replace the rows by name, all or nothing; counts must be those of the header."""
    headers = [r for r in rows if r["kind"] == "header"]
    if len(headers) != 1:
        raise ConfigError("a release has one header")
    header, counts = headers[0], dict.fromkeys(LOAD_ORDER, 0)
    built = []
    for r in sorted((r for r in rows if r["kind"] != "header"), key=lambda r: LOAD_ORDER.index(r["kind"])):
        built.append((r["kind"], _row(r["kind"], r["row"])))
        counts[r["kind"]] += 1
    if counts != header["counts"]:
        raise ConfigError(f"expected {header['counts']}, found {counts}")
    registry.releases.add(header["release"])
    registry.builds[header["release"]] = header.get("build", 0)
    for kind, row in built:
        registry.rows[kind][row.name] = row
    return counts
