"""Task states and the journal, as append-only tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.shared import exists

TASK_SCHEMA = "source string, object string, kind string, run long, rows long, mark string, started timestamp_ntz, ended timestamp_ntz"
JOURNAL_SCHEMA = "at timestamp_ntz, run long, object string, severity int, message string, detail string"
#: Severities are bits, so that a reader can ask for several.
SEVERITIES = {"success": 1, "information": 2, "warning": 4, "error": 8, "unknown": 256}


#: A message that is handed on is cut to this many characters; the journal has it whole.
MESSAGE_LENGTH = 440


@dataclass(frozen=True)
class Log:
    """A folder of parquet files that is only added to."""

    spark: SparkSession
    path: str
    schema: str

    def append(self, rows: list[tuple] | DataFrame) -> None:
        """Rows of the driver are one file; a DataFrame is written by as many tasks as it has."""
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, self.schema).coalesce(1)
        df.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        """All rows; none before the first append."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)


@dataclass(frozen=True)
class Journal:
    """Entries about objects in runs. ``on`` false writes nothing."""

    log: Log
    on: bool = True

    def write(self, at: datetime, run: int, name: str, level: str, message: str, detail: str = "") -> None:
        if self.on:
            self.log.append([(at, run, name, severity(level), message, detail)])

    def write_rows(self, rows: DataFrame, at: datetime, run: int, name: str, level: str, message: str) -> None:
        """An entry for each row, which is its detail as JSON; written by the executors."""
        if self.on:
            fixed = (F.lit(at).cast("timestamp_ntz").alias("at"), F.lit(run).cast("long").alias("run"), F.lit(name).alias("object"), F.lit(severity(level)).alias("severity"), F.lit(message).alias("message"))
            self.log.append(rows.select(*fixed, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("detail")))

    @contextmanager
    def guarded(self, at: datetime, run: int, name: str) -> Iterator[None]:
        """Write down whether what is done within succeeds; an error goes on, with its message whole in the journal."""
        try:
            yield
        except Exception as e:
            self.write(at, run, name, "error", str(e)[:MESSAGE_LENGTH], f"{type(e).__name__}: {e}")
            raise
        self.write(at, run, name, "success", "completed")


def high_water(states: DataFrame, source: str, default: str) -> str:
    """The mark of the state that ended last."""
    found = states.where((F.col("source") == source) & F.col("mark").isNotNull()).agg(F.max_by("mark", "ended")).first()[0]
    return default if found is None else found


def last_mark(states: DataFrame, source: str) -> str | None:
    """The mark of the source's last satellite load, else of its last stage load."""
    own = states.where((F.col("source") == source) & F.col("mark").isNotNull())
    found = {r["kind"]: r["mark"] for r in own.where(F.col("kind").isin("sat", "stage")).groupBy("kind").agg(F.max_by("mark", "ended").alias("mark")).collect()}
    return found.get("sat", found.get("stage"))


def latest_states(states: DataFrame) -> DataFrame:
    """The last state of each object of each source."""
    return states.groupBy("source", "object", "kind").agg(F.max_by(F.struct("run", "rows", "mark", "started", "ended"), "ended").alias("s")).select("source", "object", "kind", "s.*")


def current_states(states: DataFrame, objects: DataFrame) -> DataFrame:
    """``latest_states`` with the full names of objects; objects: (kind, object, name). Unknown ones keep null."""
    return latest_states(states).join(objects, ["kind", "object"], "left")


def severity(name: str) -> int:
    return SEVERITIES.get(name, SEVERITIES["unknown"])


def search(journal: DataFrame, pattern: str | None = None, how: str = "contains", mask: int | None = None, since: datetime | None = None, limit: int = 100, zone: str | None = None) -> DataFrame:
    """The newest entries whose message begins with, ends with or contains a text and whose severity is in a mask.

    Entries of one time are in the order of their other columns. zone: times are given as of this zone instead of UTC.
    """
    if how not in ("begins", "ends", "contains"):
        raise ValueError(f"unknown search {how}")
    if pattern is not None:
        column = F.col("message")
        journal = journal.where({"begins": column.startswith, "ends": column.endswith, "contains": column.contains}[how](pattern))
    if mask is not None:
        journal = journal.where(F.col("severity").bitwiseAND(F.lit(mask)) == F.col("severity"))
    if since is not None:
        journal = journal.where(F.col("at") >= F.lit(since).cast("timestamp_ntz"))
    ties = [c for c in ("run", "object", "severity", "message", "detail") if c in journal.columns]
    found = journal.orderBy(F.desc("at"), *ties).limit(limit)
    return found if zone is None else found.withColumn("at", F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("at")))


def recent(journal: DataFrame, now: datetime, days: int = 7, **how) -> DataFrame:
    """``search`` of the last days."""
    return search(journal, since=now - timedelta(days=days), **how)


def exceptions(journal: DataFrame, now: datetime, days: int = 10, **how) -> DataFrame:
    """``search`` of errors alone, of the last days."""
    return search(journal, mask=SEVERITIES["error"], since=now - timedelta(days=days), **how)


def kept(journal: DataFrame, now: datetime, days: int = 30, exception_days: int = 31) -> DataFrame:
    """What a cleanup leaves: errors stay at least as long as the rest."""
    if exception_days < days:
        raise ValueError("errors must be kept as long as other entries")
    cut = F.when(F.col("severity") == SEVERITIES["error"], F.lit(now - timedelta(days=exception_days))).otherwise(F.lit(now - timedelta(days=days)))
    return journal.where(F.col("at") >= cut.cast("timestamp_ntz"))


def journal_on(module: str, group: str, switches: dict[str, bool], override_off: bool = False) -> bool:
    """Whether to write: an override switches off, else the module's, the group's or the default switch decides."""
    if override_off:
        return False
    return next((switches[k] for k in (module, group, "default") if k in switches), False)
