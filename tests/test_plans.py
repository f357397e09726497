"""Configuration, storage, whole loads, scheduling, releases, staging and functions."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from siltstone.functions import macros, naming, scalar, types
from siltstone.functions.types import ColumnDef
from siltstone.operators import temporal
from siltstone.operators.satellite import Satellite, initial
from siltstone.plans import config, release, scheduler, state, store
from siltstone.plans.pipeline import NotUnique, Vault
from siltstone.sources import stage
from siltstone.streaming.cdc import into_satellite

T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)


# Functions


def test_scalars(spark):
    one = spark.sql("SELECT 'hELLO wORLD' AS t, 'a,,b' AS l, 20260102 AS d, 20261340 AS e, 9301550 AS h")
    row = one.select(scalar.proper_case(F.col("t")), scalar.int_to_date(F.col("d")), scalar.int_to_date(F.col("e")), scalar.int_to_datetime(F.col("d"), F.col("h")), scalar.int_to_string(F.col("d"))).first()
    assert tuple(row) == (" Hello World", date(2026, 1, 2), None, datetime(2026, 1, 2, 9, 30, 15, 500000), "20260102")
    assert [tuple(r) for r in scalar.split_strings(one, "l", ",").collect()] == [(1, "a"), (2, ""), (3, "b")]
    numbers = [0, 5, 999, 1000, 61_000, 3_600_000, 3_723_000, 90_000_000]
    texts = spark.createDataFrame([(n,) for n in numbers], "n long").select(scalar.elapsed(F.col("n"))).collect()
    assert [r[0] for r in texts] == [scalar.elapsed_text(n) for n in numbers]
    assert [scalar.elapsed_text(x) for x in (5, 61_000, 3_723_000)] == ["5 milliseconds", "1 min and 1 sec", "1 hr, 2 mins and 3 secs"]


def test_macros(spark):
    assert macros.expand("dv_concat(##1, ##2)", ["x", "y"]) == "concat(x, y)"
    assert macros.expand("##10-##1", [str(k) for k in range(1, 11)]) == "10-1"
    macros.register(spark)
    nested = macros.expand("dv_concat(dv_int_to_string(##1), #-, (#, cast(dv_int_to_date(##2) as string))", ["a + 1", "b"])
    assert spark.sql("SELECT 4 AS a, 20260102 AS b").select(F.expr(nested)).first()[0] == "5-, (2026-01-02"
    for bad in ("##3", "dv_other(1)"):
        with pytest.raises(ValueError):
            macros.expand(bad, ["x"])


def test_types():
    assert types.spark_type(ColumnDef("c", "decimal", precision=9, scale=2)) == T.DecimalType(9, 2)
    assert ColumnDef("c", "nvarchar", length=20).characters == 10 and ColumnDef("c", "varchar", length=-1).characters is None
    with pytest.raises(ValueError):
        types.spark_type(ColumnDef("c", "geometry"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DecimalType(5, 1)), T.StructField("c", T.StringType())])
    assert types.schema_of(types.declared(schema)) == schema


def test_names():
    assert naming.key_name("hub", "x") == "h_x_key" and naming.access_name("pit", "x") == "get_x_pit"
    assert naming.next_abbreviation("azzz") == "baaa"
    assert [naming.next_abbreviation(x) for x in (None, "aaaa", "aaaz", "azzz")] == ["aaaa", "aaab", "aaba", "baaa"]


# Staging


def test_staging(spark, tmp_path):
    rows = [(1, 1, 10, "x"), (2, 2, 20, "x"), (3, 3, 30, "x"), (4, 4, 40, "y")]
    spark.createDataFrame(rows, "k long, op int, lsn long, v string").write.parquet(str(tmp_path / "t"))
    source = stage.Source("t", "SequenceCdc", path=str(tmp_path / "t"), columns=("k", "v"), operation="op", sequence="lsn", derived={"d": "k * 2"}, row_filter="v < 'z'")
    got = stage.stage(spark, source, "Delta", T1, after=5, until=30, keys=["k"])
    assert sorted((r["k"], r["v"], r["dv_cdc_action"], r["d"]) for r in got.collect()) == [(1, None, "D", 2), (2, "x", "U", 4)]
    assert stage.stage(spark, source, "Full", T1).count() == 3
    called = stage.Source("c", kind="callable", reader=lambda s, run: s.range(2 if run == "Full" else 1))
    assert stage.stage(spark, called, "Delta", T1).count() == 1
    for bad in (stage.Source("b", "Other"), stage.Source("b", kind="other"), stage.Source("b")):
        with pytest.raises(ValueError):
            stage.stage(spark, bad, "Full", T1)
    states = spark.createDataFrame([("t", "sat", 7, T1), ("t", "stage", 9, T2)], "source string, kind string, mark int, ended timestamp")
    marks = spark.createDataFrame([(3,)], "lsn int")
    assert stage.high_water(marks, "lsn", states, "t") == 3
    assert stage.high_water(marks.limit(0), "lsn", states, "t") == 7
    assert stage.high_water(marks.limit(0), "lsn", states, "u") is None


# Storage, state, whole loads


def test_store_versions_and_conflicts(spark, tmp_path):
    table = store.Table(spark, str(tmp_path), "hub/h")
    assert table.latest() is None and table.read() is None and table.versions() == []
    table.commit(spark.range(2))
    base = table.commit(spark.range(2, 3), note={"by": "a test"})
    assert base.number == 2 and base.note == {"rows": 1, "by": "a test"} and table.read().count() == 3
    table.commit(spark.range(5, 6))
    assert table.read(base).count() == 3 and table.read().count() == 4
    with pytest.raises(store.Conflict):
        table.commit(spark.range(1), base=base)
    assert table.latest().number == 3 and table.read().count() == 4  # what the other writer left isn't read
    table.compact()
    assert table.read().count() == 4 and len(table.latest().history) == 1 and table.read(base).count() == 3


def size_of(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_current_rows_are_merged_when_read(spark, tmp_path):
    table = store.Table(spark, str(tmp_path), "sat/s", ("k",), 8, "now", "gone")
    rows = lambda *v: spark.createDataFrame(v, "k long, now boolean, gone boolean, v string")
    assert table.commit(rows().limit(0)).number == 1 and table.read().count() == 0
    base = table.commit(rows(*((k, True, False, "a" * 50 + str(k)) for k in range(5000))))
    whole = size_of(tmp_path)
    table.commit(rows((7, False, False, "a"), (7, True, False, "b"), (8, False, False, "a"), (8, False, True, None)))
    assert size_of(tmp_path) - whole < whole / 5  # a load's bytes follow what it changes
    table.commit(rows((9, True, False, "c"), (8, True, False, "d"), (6000, True, False, "new")))
    table.commit(rows((8, False, False, "d"), (8, False, True, None)))
    state = lambda v=None: {r["k"]: r["v"] for r in table.read(v, "current").collect()}
    assert {k: state().get(k) for k in (7, 8, 9, 6000)} == {7: "b", 8: None, 9: "c", 6000: "new"} and len(state()) == 5000
    assert len(state(base)) == 5000 and state(base)[8].startswith("a")
    assert sorted(r["k"] for r in table.read(part="history").collect()) == [7, 8, 8, 8, 8]
    asked = spark.createDataFrame([(7,), (8,), (8,), (9,), (77,), (7000,)], "k long")
    assert sorted(r["k"] for r in table.current_of(asked).collect()) == [7, 9, 77]
    assert [x for x in above_base(no_broadcast(spark, table.current_of(asked))) if x != "Other"][0] == "Join"  # the base is filtered where it lies
    joined = table.read(part="current").join(asked.distinct(), "k", "full_outer")
    assert [x for x in above_base(no_broadcast(spark, joined)) if x != "Other"] == ["Join", "Join"]  # and joined there
    folded = table.compact(history=False)
    assert folded.runs == () and len(state()) == 5000 and table.read(part="history").count() == 5
    assert {r["k"] for r in table.changes(base).collect()} == {7, 8, 9, 6000}  # folding is no change
    table.commit(rows((10, True, False, "c")))
    assert table.compact(history=False).history == folded.history
    assert table.vacuum(keep=1) == 5 and len(state()) == 5000 and table.read().count() == 5005 and [v.kind for v in table.versions()] == [store.FOLD]
    table.compact()
    assert table.vacuum() and len(table.versions()) == 1 and table.read(part="history").count() == 5 and len(state()) == 5000
    assert table.vacuum() == 0


def no_broadcast(spark, df):
    """The plan without broadcasts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def above_base(plan):
    """Joins and exchanges on the way from the first scan, which is that of the base, up to the root."""
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(k for k, line in enumerate(lines) if "FileScan" in line)
    found, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            found.append(next((x for x in ("Join", "Exchange") if x in line), "Other"))
    return found


def test_changes_between_versions(spark, tmp_path):
    table = store.Table(spark, str(tmp_path), "sat/s", ("k",), 4, "now", "gone")
    rows = lambda *v: spark.createDataFrame(v, "k long, now boolean, gone boolean, v string")
    one = table.commit(rows((1, True, False, "a"), (2, True, False, "a"), (3, True, False, "a")))
    table.commit(rows((1, False, False, "a"), (1, True, False, "b"), (4, True, False, "x"), (2, False, False, "a"), (2, False, True, None)))
    two = table.commit(rows((1, False, False, "b"), (1, True, False, "a"), (4, False, False, "x"), (4, False, True, None), (3, False, False, "a"), (3, True, False, "c")))
    found = lambda *a, **k: sorted(tuple(r) for r in table.changes(*a, **k).select("k", "now", "v").collect())
    assert found(one, two) == [(1, True, "a"), (2, False, None), (3, True, "c"), (4, False, None)]
    assert found(one, two, net=True) == [(2, False, None), (3, True, "c")]
    assert found(two, two) == [] and found(None, one) == [(1, True, "a"), (2, True, "a"), (3, True, "a")]
    table.compact(history=False)
    assert found(one, net=True) == [(2, False, None), (3, True, "c")]
    table.commit(rows((3, True, False, "c"), (5, True, False, "n")), store.WHOLE)
    assert found(two) == [(1, False, "a"), (5, True, "n")]


@pytest.fixture
def vault(spark, tmp_path):
    out = Vault(spark, str(tmp_path / "vault"))
    frames = {"Full": [(1, "a", 5), (2, "b", 6)]}
    reader = lambda s, run: s.createDataFrame(frames[run], "id long, name string, boss long")
    r = out.registry
    r.insert("hub", config.HubConfig("person", ("pk",)))
    r.insert("link", config.LinkConfig("reports", {"person": "person", "boss": "person"}))
    r.insert("satellite", config.SatelliteConfig("pay", "reports", "link", {"name": ColumnDef("name", "varchar", length=5)}, (("loud", "upper(name)"),), buckets=4))
    r.insert("source", config.SourceConfig(stage.Source("people", kind="callable", reader=reader), {"person": {"id": "pk"}, "boss": {"boss": "pk"}}, "reports", ("pay",)))
    return out, frames


def test_a_source_from_end_to_end(spark, vault):
    v, frames = vault
    v.load("people", "Full", T1, run=1)
    assert sorted(r["pk"] for r in v.table("hub", "person").read().collect()) == [1, 2, 5, 6]
    frames["Full"] = [(1, "c", 5), (3, "d", 6)]
    v.load("people", "Full", T2, run=2)
    assert v.table("hub", "person").read().count() == 5 and v.table("link", "reports").read().count() == 3
    sat = v.table("sat", "pay").read()
    assert sorted((r["name"], r["loud"]) for r in temporal.point_in_time(sat).collect()) == [("c", "C"), ("d", "D")]
    assert sorted(r["name"] for r in temporal.point_in_time(sat, T1).collect()) == ["a", "b"]
    before = sat.count()
    v.load("people", "Full", T2 + timedelta(1), run=3)
    assert v.table("sat", "pay").read().count() == before
    assert v.states.read().where("run = 3 and kind <> 'stage'").agg(F.sum("rows")).first()[0] == 0
    assert {(r["object"], r["kind"], r["rows"]) for r in v.states.read().where("run = 2").collect()} == {("people", "stage", 2), ("h_person", "hub", 1), ("l_reports", "link", 1), ("s_pay", "sat", 2 + 2 + 1)}
    assert v.journal.log.read().where(f"severity = {state.severity('success')}").count() == 3


def test_duplicates_and_errors_go_to_the_journal(spark, vault):
    v, frames = vault
    v.registry.update("satellite", "pay", duplicate_threshold=2)
    frames["Full"] = [(1, "a", 5), (1, "b", 5), (2, "c", 5)]
    v.load("people", "Full", T1, run=1)
    assert [r["name"] for r in v.table("sat", "pay").read().collect()] == ["c"]
    kept = v.journal.log.read().where("message = 'Duplicate Key Removed'").select(F.get_json_object("detail", "$.name").alias("name"), "object", "run").collect()
    assert sorted(tuple(r) for r in kept) == [("a", "s_pay", 1), ("b", "s_pay", 1)]
    frames["Full"] = [(1, "x" * 3, 5)] * 3
    with pytest.raises(ValueError, match="Duplicate Keys"):
        v.load("people", "Full", T2, run=2)
    errors = state.exceptions(v.journal.log.read(), T2).collect()
    assert [(r["run"], r["object"]) for r in errors] == [(2, "people")] and "Duplicate Keys" in errors[0]["message"]
    assert state.exceptions(v.journal.log.read(), T2 + timedelta(days=40)).count() == 0


def test_a_delta_goes_on_after_the_last_mark(spark, tmp_path):
    v, path = Vault(spark, str(tmp_path / "vault")), str(tmp_path / "changes")
    schema = "id long, name string, op int, lsn long"
    put = lambda *rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    put((1, "a", 2, 1), (2, "b", 2, 2))
    r = v.registry
    r.insert("hub", config.HubConfig("person", ("pk",)))
    r.insert("satellite", config.SatelliteConfig("names", "person", "hub", {"name": ColumnDef("name", "varchar", length=5)}, buckets=4))
    r.insert("source", config.SourceConfig(stage.Source("people", "SequenceCdc", path=path, columns=("id", "name"), operation="op", sequence="lsn"), {"person": {"id": "pk"}}, satellites=("names",)))
    v.load("people", "Delta", T1, run=1)
    put((2, None, 1, 3), (1, "c", 4, 4))
    v.load("people", "Delta", T2, run=2)
    assert [r["mark"] for r in v.states.read().where("kind = 'sat'").orderBy("run").collect()] == ["2", "4"]
    assert [r["name"] for r in temporal.point_in_time(v.table("sat", "names").read()).collect()] == ["c"]
    assert v.states.read().where("kind = 'stage' and run = 2").first()["rows"] == 2
    v.load("people", "Delta", T2 + timedelta(1), run=3)  # nothing new: the mark stays
    assert v.states.read().where("kind = 'sat' and run = 3").first()["mark"] == "4"
    empty = config.SourceConfig(stage.Source("none", "SequenceCdc", path=path, row_filter="lsn > 99", sequence="lsn", operation="op"), {"person": {"id": "pk"}}, satellites=("names",))
    r.insert("source", empty)
    with pytest.raises(ValueError, match="high-water"):
        v.load("none", "Delta", T2)


def test_tables_are_created_and_checked(spark, vault):
    v, _ = vault
    v.registry.update("hub", "person", types={"pk": "bigint"})
    for kind, name in (("hub", "person"), ("link", "reports"), ("sat", "pay")):
        assert v.create(kind, name).read().count() == 0
        v.create(kind, name)
        v.check_unique(kind, name)
    v.load("people", "Full", T1)
    assert v.table("hub", "person").read().count() == 4 and v.table("sat", "pay").read().count() == 2
    twice = v.table("hub", "person").read().where("pk = 1")
    v.table("hub", "person").commit(twice)
    with pytest.raises(NotUnique, match="h_person"):
        v.check_unique("hub", "person")
    with pytest.raises(config.ConfigError):
        Vault(spark, v.root + "-none", v.registry).read_object("hub", "person")


def test_a_comparison_is_a_source(spark, vault):
    v, frames = vault
    v.load("people", "Full", T1)
    frames["Full"] = [(1, "a", 5), (3, "d", 6)]
    r = v.registry
    r.insert("match", config.MatchConfig("people_pay", ("stage", "people"), ("sat", "pay"), (("name", "name"),)))
    r.insert("hub", config.HubConfig("difference", ("name",)))
    r.insert("source", config.SourceConfig(stage.Source("differences", kind="match", match="people_pay"), {"difference": {"name": "name"}}))
    assert sorted(tuple(x) for x in v.compared("people_pay").collect()) == [("people", "d"), ("s_pay", "b")]
    v.load("differences", "Full", T2)
    assert sorted(x["name"] for x in v.table("hub", "difference").read().collect()) == ["b", "d"]
    assert r.matches() == [{"match": "people_pay", "left_kind": "stage", "left_object": "people", "left_column": "name", "right_kind": "sat", "right_object": "pay", "right_column": "name"}]
    assert v.read_object("link", "reports").columns[-2:] == ["person__pk", "boss__pk"]
    columns = v.column_list("hub", "person", "h")
    assert [c["qualified"] for c in columns] == ["h.h_person_key", "h.dv_load_date_time", "h.dv_record_source", "h.pk"] and columns[-1]["type"] == "bigint"
    assert v.column_list("sat", "pay")[-1] == {"name": "loud", "qualified": "s_pay.loud", "type": "string", "nullable": True}


def test_the_other_kinds_of_configuration(vault):
    r = vault[0].registry
    r.insert("connection", config.ConnectionConfig("files", "csv", {"header": "true"}))
    r.insert("system", config.SystemConfig("erp", "files"))
    r.insert("function", config.FunctionConfig("shout", "upper(##1)"))
    r.insert("default", config.DefaultConfig("Prefix", "h_"))
    r.insert("version", config.VersionConfig("people_1", "people", 1, active=False))
    assert r.default("Prefix") == "h_" and r.default("Other", "x") == "x" and r.stages() == []
    r.update("version", "people_1", active=True)
    assert [s["source"] for s in r.stages()] == ["people"]
    again = r.recreate_satellite("pay", [ColumnDef("boss", "bigint")])
    assert list(again.columns) == ["boss", "name"] and again.columns["name"].retired and again.abbreviation == "aaaa"
    assert r.recreate_satellite("pay", [ColumnDef("boss", "bigint")]).abbreviation == "aaab"
    r.add_release(3)
    r.move_all(3)
    for bad in (lambda: r.add_release(3), lambda: r.drop_release(3), lambda: r.drop_release(9)):
        with pytest.raises(config.ConfigError):
            bad()
    r.drop_release(0)
    assert r.releases == {3}
    assert {row.release for rows in r.rows.values() for row in rows.values()} == {3}


def test_a_failed_load_leaves_the_satellite(vault):
    v, frames = vault
    v.load("people", "Full", T1)
    before = v.table("sat", "pay").latest()
    frames["Full"] = [(1, "a", 5), (1, "b", 5)]
    with pytest.raises(ValueError, match="Duplicate Keys"):
        v.load("people", "Full", T2)
    assert v.table("sat", "pay").latest() == before


def test_configuration_checks(vault):
    r = vault[0].registry
    for bad in (
        lambda: r.insert("hub", config.HubConfig("person", ("pk",))),
        lambda: r.insert("hub", config.HubConfig("other", ("pk",), release=9)),
        lambda: r.update("hub", "person", release=1),
        lambda: r.get("hub", "nobody"),
        lambda: r.move("hub", "person", 9),
    ):
        with pytest.raises(config.ConfigError):
            bad()
    source = r.get("source", "people")
    r.insert("source", config.SourceConfig(stage.Source("two", path="x"), source.hub_columns))
    with pytest.raises(config.ConfigError, match="exactly one hub"):
        r.check("two")
    r.delete("source", "two")
    assert r.update("hub", "person", keys=("id",)).keys == ("id",)
    columns = config.satellite_columns([ColumnDef("z", "int"), ColumnDef("dv_x", "int"), ColumnDef("a", "int")], retired=["a"])
    assert list(columns) == ["dv_x", "a", "z"] and columns["a"].retired
    r.empty()
    assert not any(r.rows.values())


def test_releases_round_trip(spark, vault, tmp_path):
    r = vault[0].registry
    r.declare("people", [ColumnDef("id", "bigint"), ColumnDef("name", "varchar", length=9, default="'x'")])
    release.export(spark, r, 0, str(tmp_path / "release"))
    rows = release.load(spark, str(tmp_path / "release"))
    other = config.Registry()
    assert {k: n for k, n in release.apply(other, rows).items() if n} == {"hub": 1, "link": 1, "satellite": 1, "source": 1}
    assert release.build(r, 0)[0]["build"] == 1 and release.build(r, 0)[0]["build"] == 2
    assert other.rows["hub"] == r.rows["hub"] and other.rows["satellite"] == r.rows["satellite"]
    with pytest.raises(config.ConfigError, match="expected"):
        release.apply(config.Registry(), rows[:-1])


def test_journal(spark):
    rows = [(T1 + timedelta(days=k), 1, "o", 8 if k % 2 else 2, f"m{k}", "") for k in range(40)]
    journal = spark.createDataFrame(rows, state.JOURNAL_SCHEMA)
    assert [r["message"] for r in state.search(journal, "m3", "begins", 12, limit=2).collect()] == ["m39", "m37"]
    assert state.kept(journal, T1 + timedelta(days=40), 10, 20).count() == 15
    with pytest.raises(ValueError):
        state.kept(journal, T1, 10, 5)
    assert state.journal_on("m", "g", {"g": True}) and not state.journal_on("m", "g", {}) and not state.journal_on("m", "g", {"m": True}, True)
    assert state.severity("other") == 256


# Scheduling


def a_run(edges, names="abcd", **kw):
    return scheduler.Run({n: scheduler.Task(n) for n in names}, set(edges), **kw)


DIAMOND = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")]


def test_runnable_and_potential():
    run = a_run(DIAMOND)
    names = lambda ts: [t.name for t in ts]
    assert names(run.runnable()) == ["a"]
    run.tasks["a"].to("Queued")
    run.tasks["a"].to("Processing")
    assert names(run.runnable()) == [] and names(run.potential()) == ["b", "c"]
    run.tasks["a"].to("Completed")
    assert names(run.runnable()) == ["b", "c"]


def test_process_order_failure_and_restart():
    run, done = a_run(DIAMOND), []
    run.process(lambda t: done.append(t.name))
    assert done[0] == "a" and done[-1] == "d" and run.status == "Completed"
    run, broken = a_run([("b", "a"), ("c", "b")]), {"b"}

    def load(t):
        if t.name in broken:
            raise RuntimeError("no")

    with pytest.raises(scheduler.RunFailed):
        run.process(load)
    assert [run.tasks[n].status for n in "abcd"] == ["Completed", "Failed", "Scheduled", "Completed"]
    broken.clear()
    run.restart()
    run.process(load)
    assert run.status == "Completed"
    assert not run.deletable(run.created) and run.deletable(run.created + timedelta(hours=25))


def test_a_run_survives_its_driver(spark, tmp_path):
    log = state.Log(spark, str(tmp_path / "runs"), scheduler.RUN_SCHEMA)
    run, done = a_run([("b", "a"), ("c", "b")], number=7, log=log), []

    def load(t):
        if t.name == "b":
            raise KeyboardInterrupt  # the driver ends
        done.append(t.name)

    with pytest.raises(KeyboardInterrupt):
        run.process(load)
    again = scheduler.Run.resumed(log, 7)
    assert {n: t.status for n, t in again.tasks.items()} == {"a": "Completed", "b": "Failed", "c": "Scheduled", "d": "Scheduled"} and again.status == "Failed"
    again.restart()
    again.process(lambda t: done.append(t.name))
    assert done == ["a", "b", "c", "d"] or done == ["a", "b", "d", "c"]
    tasks = scheduler.current_tasks(log.read())
    assert {r["task"]: r["status"] for r in tasks.collect()} == dict.fromkeys("abcd", "Completed")
    assert scheduler.run_status(tasks.select("run", "status")).first()["status"] == "Completed"
    with pytest.raises(ValueError, match="no run 8"):
        scheduler.Run.resumed(log, 8)


def test_a_report(spark, tmp_path):
    log = state.Log(spark, str(tmp_path / "runs"), scheduler.RUN_SCHEMA)
    at = lambda h: T1 + timedelta(hours=h)
    log.append([(1, "a", "Full", 0, "001", "Completed", at(1), at(2), "", [], at(0), 1), (1, "b", "Full", 0, "001", "Failed", at(2), at(3), "x", ["a"], at(0), 2), (2, "a", "Full", 0, "001", "Processing", at(5), None, "", [], at(4), 1)])
    journal = spark.createDataFrame([(at(2.5), 1, "b", 8, "no", ""), (at(9), 1, "b", 8, "late", ""), (at(6), 2, "a", 8, "odd", ""), (at(6), 2, "s", 4, "gone", ""), (at(6), 2, "s", 4, "gone", "")], state.JOURNAL_SCHEMA)
    found = {k: sorted(tuple(r) for r in df.collect()) for k, df in scheduler.progress(log.read(), journal, T1, "gone").items()}
    assert found["runs"] == [(1, "Failed"), (2, "Unknown")] and found["errors"] == [(1, "b", at(2.5), "no"), (2, "a", at(6), "odd")] and found["removed"] == [(2, "s", 2)]
    assert sorted(r[-1] for r in found["open_tasks"]) == [0, 1]


def test_schedules_are_edited():
    all_ = scheduler.Schedules()
    all_.insert(scheduler.Schedule("One", {}))
    for n in "ab":
        all_.add_member("One", scheduler.Task(n))
    all_.add_edge("One", "b", "a")
    for bad, error in ((lambda: all_.add_edge("One", "a", "b"), scheduler.CircularReference), (lambda: all_.add_edge("One", "a", "z"), ValueError), (lambda: all_.insert(scheduler.Schedule("One", {})), ValueError), (lambda: all_.delete("One"), scheduler.IllegalTransition), (lambda: all_.add_member("One", scheduler.Task("a")), ValueError)):
        with pytest.raises(error):
            bad()
    assert all_.rows["One"].edges == {("b", "a")}
    all_.remove_member("One", "a")
    assert all_.rows["One"].edges == set() and list(all_.rows["One"].members) == ["b"]
    all_.update("One", cancelled=True)
    assert all_.current() == []
    all_.delete("One")
    assert all_.rows == {}


def test_cycles_transitions_and_cancel():
    for edges in ([("a", "b"), ("b", "a")], [("a", "a")]):
        with pytest.raises(scheduler.CircularReference):
            a_run(edges).check()
    with pytest.raises(scheduler.IllegalTransition):
        scheduler.Task("a").to("Completed")
    run = a_run([])
    run.cancelled = True
    with pytest.raises(scheduler.RunFailed):
        run.process(lambda t: None)
    assert run.status == "Cancelled"


def test_schedules_to_runs():
    one = scheduler.Schedule("One", {"a": scheduler.Task("a"), "b": scheduler.Task("b", "Delta")}, {("b", "a"), ("b", "z")})
    run = scheduler.Run.of([one, scheduler.Schedule("Off", {}, cancelled=True)], "one", {"a": "Full"})
    assert {t.name: t.load_type for t in run.tasks.values()} == {"a": "Full", "b": "Delta"} and run.edges == {("b", "a")}
    for bad in ("two", "off"):
        with pytest.raises(ValueError):
            scheduler.Run.of([one], bad)


def test_paths(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b")], "task string, predecessor string")
    assert sorted(r[0] for r in scheduler.paths(edges).collect()) == ["[a]", "[a] >>> [b]", "[a] >>> [b] >>> [c]"]
    assert scheduler.cycles(edges).count() == 0


# Streaming


def test_changes_stream_into_a_satellite(spark, tmp_path):
    sat, table = Satellite(("k",), ("v",)), store.Table(spark, str(tmp_path), "sat/s", ("k",), 4)
    empty = spark.createDataFrame([], "k long, v string")
    table.commit(initial(sat, empty, T1, ""))
    schema = "k long, v string, dv_cdc_action string, n int"
    spark.createDataFrame([(1, "a", "U", 0), (1, "b", "U", 1), (2, "c", "U", 0)], schema).write.parquet(str(tmp_path / "in"))
    for rows in ([], [(1, None, "D", 2), (2, "d", "U", 3)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        into_satellite(stream, sat, table, ["n"], str(tmp_path / "cp"), "s", lambda: T2).awaitTermination()
    whole = table.read()
    assert [(r["k"], r["v"]) for r in temporal.point_in_time(whole).collect()] == [(2, "d")]
    assert whole.where("dv_is_tombstone").count() == 1
