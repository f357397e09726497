"""Dependency-ordered runs: tasks, legal transitions, what can run, paths and cycles, and reports of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.intervals import points_within
from siltstone.plans.shared import checkpointed
from siltstone.plans.state import SEVERITIES, Log

# States and the state that each one may follow.
FOLLOWS = {"Queued": {"Scheduled"}, "Processing": {"Queued"}, "Completed": {"Processing"}, "Failed": {"Processing"}, "Cancelled": {"Scheduled", "Queued"}}
#: A line for each state that a task of a run takes; the last one counts.
RUN_SCHEMA = "run long, task string, load_type string, priority int, queue string, status string, started timestamp_ntz, ended timestamp_ntz, error string, predecessors array<string>, created timestamp_ntz, noted long"


class IllegalTransition(ValueError):
    """A state that can't follow the one before."""


class CircularReference(ValueError):
    """Tasks that wait for each other, or for themselves."""


class RunFailed(RuntimeError):
    """A run that didn't complete."""


@dataclass
class Task:
    name: str
    load_type: str = "Default"
    priority: int = 0
    queue: str = "001"
    status: str = "Scheduled"
    started: datetime | None = None
    ended: datetime | None = None
    error: str = ""

    def to(self, status: str) -> None:
        if self.status not in FOLLOWS.get(status, set()):
            raise IllegalTransition(f"{self.name}: {self.status} to {status}")
        self.status = status
        if status == "Processing":
            self.started = datetime.now()
        elif status in ("Completed", "Failed"):
            self.ended = datetime.now()


@dataclass
class Schedule:
    """members: task name to task defaults; edges: (task, predecessor)."""

    name: str
    members: dict[str, Task]
    edges: set[tuple[str, str]] = field(default_factory=set)
    cancelled: bool = False


class Schedules:
    """Schedules by name. One that is in use can't be deleted: it must be cancelled first, or forced."""

    def __init__(self) -> None:
        self.rows: dict[str, Schedule] = {}

    def insert(self, row: Schedule) -> Schedule:
        if row.name in self.rows:
            raise ValueError(f"schedule {row.name} exists")
        self.rows[row.name] = row
        return row

    def update(self, name: str, **changes) -> Schedule:
        self.rows[name] = replace(self.rows[name], **changes)
        return self.rows[name]

    def delete(self, name: str, force: bool = False) -> None:
        if not (self.rows[name].cancelled or force):
            raise IllegalTransition(f"schedule {name} is not cancelled")
        del self.rows[name]

    def add_member(self, name: str, task: Task) -> None:
        if task.name in self.rows[name].members:
            raise ValueError(f"{task.name} is in schedule {name}")
        self.rows[name].members[task.name] = task

    def remove_member(self, name: str, task: str) -> None:
        """The task and its edges."""
        schedule = self.rows[name]
        del schedule.members[task]
        schedule.edges = {e for e in schedule.edges if task not in e}

    def add_edge(self, name: str, task: str, predecessor: str) -> None:
        """An edge between members; one that closes a circle is refused."""
        schedule = self.rows[name]
        if {task, predecessor} - set(schedule.members):
            raise ValueError(f"{task}, {predecessor}: not both are in schedule {name}")
        Run(schedule.members, schedule.edges | {(task, predecessor)}).check()
        schedule.edges = schedule.edges | {(task, predecessor)}

    def remove_edge(self, name: str, task: str, predecessor: str) -> None:
        self.rows[name].edges = self.rows[name].edges - {(task, predecessor)}

    def current(self) -> list[Schedule]:
        """Those that aren't cancelled."""
        return [s for s in self.rows.values() if not s.cancelled]

    def edges(self, spark: SparkSession, names: str) -> DataFrame:
        """(task, predecessor) of a comma-separated list of schedules, for ``paths`` and ``cycles``."""
        wanted = {n.strip().lower() for n in names.split(",")}
        rows = sorted({e for s in self.current() if s.name.lower() in wanted for e in s.edges})
        return spark.createDataFrame(rows, "task string, predecessor string")


@dataclass
class Run:
    """The tasks of one run. With a log, every state is noted there, so that another driver can go on."""

    tasks: dict[str, Task]
    edges: set[tuple[str, str]]
    status: str = "Scheduled"
    cancelled: bool = False
    created: datetime = field(default_factory=datetime.now)
    number: int = 0
    log: Log | None = None
    noted: int = 0

    @classmethod
    def of(cls, schedules: list[Schedule], names: str, defaults: dict[str, str] | None = None) -> Run:
        """The tasks of the active schedules of a comma-separated list (in either case), each once.

        Edges count where both ends are in the run. A 'Default' load type becomes the source's own.
        """
        wanted = {n.strip().lower() for n in names.split(",") if n.strip()}
        known = {s.name.lower(): s for s in schedules if not s.cancelled}
        if missing := wanted - set(known):
            raise ValueError(f"no active schedule {sorted(missing)}")
        tasks: dict[str, Task] = {}
        for n in sorted(wanted):
            for m in known[n].members.values():
                kind = (defaults or {}).get(m.name, "Full") if m.load_type == "Default" else m.load_type
                tasks.setdefault(m.name, Task(m.name, kind, m.priority, m.queue))
        edges = {e for n in wanted for e in known[n].edges if e[0] in tasks and e[1] in tasks}
        run = cls(tasks, edges)
        run.check()
        return run

    def check(self) -> None:
        before: dict[str, set[str]] = {n: set() for n in self.tasks}
        for task, predecessor in self.edges:
            before[task].add(predecessor)
        try:
            TopologicalSorter(before).prepare()
        except CycleError as e:
            raise CircularReference(" >>> ".join(e.args[1])) from e

    def waiting(self, accept: tuple[str, ...] = ("Completed",)) -> list[Task]:
        """Scheduled tasks whose predecessors are all in an accepted state, highest priority first."""
        held = {t for t, p in self.edges if self.tasks[p].status not in accept}
        found = [t for t in self.tasks.values() if t.status == "Scheduled" and t.name not in held]
        return sorted(found, key=lambda t: (-t.priority, t.name))

    def runnable(self) -> list[Task]:
        return self.waiting()

    def potential(self) -> list[Task]:
        return self.waiting(("Completed", "Queued", "Processing"))

    def outcome(self) -> str:
        states = {t.status for t in self.tasks.values()}
        if "Failed" in states:
            return "Failed"
        if "Cancelled" in states:
            return "Cancelled"
        return "Completed" if states <= {"Completed"} else "Unknown"

    def note(self, tasks: list[Task]) -> None:
        if self.log is None:
            return
        self.noted += 1
        before = lambda t: sorted(p for x, p in self.edges if x == t.name)
        self.log.append([(self.number, t.name, t.load_type, t.priority, t.queue, t.status, t.started, t.ended, t.error, before(t), self.created, self.noted) for t in tasks])

    @classmethod
    def resumed(cls, log: Log, number: int) -> Run:
        """A run as its log has it; what was going on when its driver ended counts as failed."""
        rows = log.read().where(F.col("run") == number).groupBy("task").agg(F.max_by(F.struct("*"), "noted").alias("s")).select("s.*").collect()
        if not rows:
            raise ValueError(f"no run {number}")
        tasks = {r["task"]: Task(r["task"], r["load_type"], r["priority"], r["queue"], r["status"], r["started"], r["ended"], r["error"]) for r in rows}
        edges = {(r["task"], p) for r in rows for p in r["predecessors"]}
        run = cls(tasks, edges, created=rows[0]["created"], number=number, log=log, noted=max(r["noted"] for r in rows))
        for t in tasks.values():
            if t.status in ("Queued", "Processing"):
                t.status, t.error = "Failed", t.error or "its driver ended"
        run.status = "Scheduled" if all(t.status == "Scheduled" for t in tasks.values()) else run.outcome()
        return run

    def process(self, load: Callable[[Task], None]) -> None:
        """Load one task after another as their predecessors complete; each is one or more Spark jobs, which use the whole cluster.

        A failure holds back its descendants only.
        """
        if self.status != "Scheduled":
            raise IllegalTransition(f"run is {self.status}")
        self.status = "Started"
        self.note(list(self.tasks.values()))
        while ready := self.runnable():
            if self.cancelled:
                waiting = [t for t in self.tasks.values() if t.status == "Scheduled"]
                for t in waiting:
                    t.to("Cancelled")
                self.note(waiting)
                break
            task = ready[0]
            task.to("Queued")
            task.to("Processing")
            self.note([task])
            try:
                load(task)
            except Exception as e:  # noqa: BLE001  whatever a load raises is its task's failure
                task.error = str(e)
                task.to("Failed")
            else:
                task.to("Completed")
            self.note([task])
        self.status = self.outcome()
        if self.status != "Completed":
            raise RunFailed(f"run is {self.status}: " + ", ".join(f"{t.name} {t.status}" for t in self.tasks.values() if t.status != "Completed"))

    def restart(self, failed_too: bool = True, force: bool = False) -> None:
        """Make a failed run ready again; queued tasks and, if asked, failed ones are scheduled anew."""
        if self.status != "Failed" and not force:
            raise IllegalTransition(f"run is {self.status}")
        for t in self.tasks.values():
            if t.status == "Queued" or (failed_too and t.status == "Failed"):
                t.status, t.error = "Scheduled", ""
        self.status = "Scheduled"
        self.note(list(self.tasks.values()))

    def deletable(self, now: datetime) -> bool:
        return self.status in ("Completed", "Failed", "Cancelled") and now - self.created > timedelta(hours=24)


def paths(edges: DataFrame, depth: int = 5000) -> DataFrame:
    """(path) from each root along edges (task, predecessor) to every task, as ``[a] >>> [b]``."""
    return _closure(edges, depth).select("path")


def cycles(edges: DataFrame) -> DataFrame:
    """(task) of tasks that reach themselves, self-loops included.

    Pairs of the transitive closure are joined step by step until none is new; edges are configuration, so few.
    """
    step = checkpointed(edges.select(F.col("predecessor").alias("a"), F.col("task").alias("b")).distinct())
    found = new = step
    while new.limit(1).count():
        longer = new.join(step.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
        new = checkpointed(longer.join(found, ["a", "b"], "left_anti"))
        found = checkpointed(found.union(new))
    return found.where("a = b").select(F.col("a").alias("task"))


def _closure(edges: DataFrame, depth: int) -> DataFrame:
    """(task, path) of all walks from the roots, of ``depth`` steps at most."""
    return edges.sparkSession.sql(
        f"""WITH RECURSIVE walk(task, path) MAX RECURSION LEVEL {depth} AS (
             SELECT DISTINCT predecessor, concat('[', predecessor, ']') FROM {{edges}} WHERE predecessor NOT IN (SELECT task FROM {{edges}})
             UNION ALL
             SELECT e.task, concat(w.path, ' >>> [', e.task, ']') FROM walk w JOIN {{edges}} e ON e.predecessor = w.task
           ) SELECT task, path FROM walk""",
        edges=edges,
    )


def runnable_tasks(tasks: DataFrame, edges: DataFrame, accept: tuple[str, ...] = ("Completed",)) -> DataFrame:
    """The same choice as ``Run.waiting`` for a table of tasks (task, status): for reports."""
    states = tasks.select(F.col("task").alias("predecessor"), F.col("status").alias("before"))
    held = edges.join(states, "predecessor").where(~F.col("before").isin(*accept)).select("task")
    return tasks.where("status = 'Scheduled'").join(held, "task", "left_anti").select("task")


def run_status(tasks: DataFrame) -> DataFrame:
    """(run, status): Failed over Cancelled over Unknown over Completed."""
    any_of = lambda s: F.bool_or(F.col("status") == s)
    whole = F.bool_and(F.col("status") == "Completed")
    status = F.when(any_of("Failed"), "Failed").when(any_of("Cancelled"), "Cancelled").when(whole, "Completed").otherwise("Unknown")
    return tasks.groupBy("run").agg(status.alias("status"))


def current_tasks(log: DataFrame) -> DataFrame:
    """The last state of every task of every run, with the seconds it took; log: as ``RUN_SCHEMA``."""
    last = log.groupBy("run", "task").agg(F.max_by(F.struct("load_type", "priority", "queue", "status", "started", "ended", "error", "created"), "noted").alias("s")).select("run", "task", "s.*")
    return last.withColumn("seconds", F.timestamp_diff("SECOND", F.col("started"), F.col("ended")))


def striped(tasks: DataFrame, by: str, order: str) -> DataFrame:
    """Rows with ``stripe`` 0 and 1 in turn, group by group, for a report: the rank of the group by its first ``order``."""
    first = tasks.groupBy(by).agg(F.min(order).alias("__first"))
    ranked = first.withColumn("stripe", (F.rank().over(Window.orderBy("__first", by)) % 2).cast("int"))  # a row for each group
    return tasks.join(ranked.select(by, "stripe"), by)


def exceptions_within(tasks: DataFrame, journal: DataFrame) -> DataFrame:
    """Errors of the journal that fall into the time of a task of the same run: (run, task, at, message).

    tasks: (run, task, started, ended); a task that hasn't ended takes all since its start. Runs meet by
    equality first, so that only times within a run are compared.
    """
    errors = journal.where(F.col("severity") == SEVERITIES["error"]).select("run", "at", "message")
    within = (F.col("at") >= F.col("started")) & ((F.col("at") <= F.col("ended")) | F.col("ended").isNull())
    return tasks.join(errors, "run").where(within).select("run", "task", "at", "message")


def errors_by_time(tasks: DataFrame, journal: DataFrame) -> DataFrame:
    """(task, started, ended, at, message): errors of the journal with all tasks that ran then, whatever run either belongs to."""
    errors = journal.where(F.col("severity") == SEVERITIES["error"]).select("at", "message")
    return points_within(errors, tasks.select("task", "started", "ended"), "at", "started", "ended").select("task", "started", "ended", "at", "message")


def progress(log: DataFrame, journal: DataFrame, since: datetime, removed: str) -> dict[str, DataFrame]:
    """The four parts of a report: recent runs, tasks that aren't completed, their errors, and rows removed as duplicates."""
    low = F.lit(since).cast("timestamp_ntz")
    tasks = current_tasks(log).where(F.col("created") >= low)
    return {
        "runs": run_status(tasks.select("run", "status")),
        "open_tasks": striped(tasks.where(F.col("status") != "Completed"), "run", "created"),
        "errors": exceptions_within(tasks.select("run", "task", "started", "ended"), journal.where(F.col("at") >= low)),
        "removed": journal.where((F.col("at") >= low) & (F.col("message") == removed)).groupBy("run", "object").agg(F.count("*").alias("rows")),
    }
