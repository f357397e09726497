"""Joins in time, incremental profiles, marks, typed stages, partitioned reads and streams that share a satellite."""

import os
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from siltstone.functions import marks
from siltstone.functions.naming import HIGH_DATE
from siltstone.functions.types import ColumnDef
from siltstone.operators import intervals, metrics, temporal
from siltstone.operators.satellite import Satellite, initial
from siltstone.plans import config, store
from siltstone.plans.pipeline import Vault
from siltstone.plans.shared import shared_folder, sweep
from siltstone.sources import jdbc, stage
from siltstone.streaming.cdc import into_satellite, load_batch, stream_id

T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)
at = lambda minutes: T1 + timedelta(minutes=minutes)


# As-of and interval joins


def facts_and_versions(spark, seed, hot):
    r = random.Random(seed)
    facts = [(n, None if r.random() < 0.02 else 0 if r.random() < hot else r.randrange(6), None if r.random() < 0.02 else at(r.randrange(300))) for n in range(400)]
    versions = []
    for k in range(5):
        starts = sorted(r.sample(range(0, 300, 3), 25))
        for n, s in enumerate(starts):
            end = starts[n + 1] if n + 1 < len(starts) else None
            gone, gap = r.random() < 0.2, r.random() < 0.2
            end = s if gone else s + 1 if gap else end
            versions.append((k, at(s), HIGH_DATE if end is None else at(end), gone, None if gone else f"v{k}.{s}", False))
    df = spark.createDataFrame(versions, "k int, dv_rowstartdate timestamp_ntz, dv_rowenddate timestamp_ntz, dv_is_tombstone boolean, v string, dv_row_is_current boolean")
    return facts, versions, spark.createDataFrame(facts, "n int, k int, t timestamp_ntz").repartition(3), df


@pytest.mark.parametrize("hot_rows", [10**6, 20])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_as_of_against_a_loop(spark, hot_rows, how):
    facts, versions, df, sat = facts_and_versions(spark, 3, 0.6)
    got = sorted(tuple(r) for r in temporal.as_of(df, sat, ["k"], "t", {"v": "state"}, how, hot_rows).select("n", "state").collect())
    want = []
    for n, k, t in facts:
        valid = [v for key, s, e, gone, v, _ in versions if key == k and t is not None and s <= t < e and not gone]
        want += [(n, valid[0] if valid else None)] if valid or how == "left" else []
    assert got == sorted(want)


def test_as_of_has_no_range_join_and_takes_empty_tables(spark):
    _, _, df, sat = facts_and_versions(spark, 4, 0.6)
    joined = temporal.as_of(df, sat, ["k"], "t", {"v": "state"}, hot_rows=20)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert temporal.as_of(df.limit(0), sat, ["k"], "t", {"v": "state"}).count() == 0
    assert temporal.as_of(df, sat.limit(0), ["k"], "t", {"v": "state"}).where("state is null").count() == 400
    with pytest.raises(ValueError):
        temporal.as_of(df, sat, ["k"], "t", {}, "outer")
    with pytest.raises(ValueError, match="already"):
        temporal.as_of(df, sat, ["k"], "t", {"v": "n"})


def test_points_and_overlaps_against_loops(spark):
    r = random.Random(5)
    spans = [(n, None if n == 3 else a, None if n % 9 == 0 else a + r.choice([0, 0, 1, 7, 100, 5000, 2**40, -5])) for n, a in enumerate(r.choices(range(-300, 900), k=120))]
    points = [(n, None if n == 5 else r.randrange(-400, 1200)) for n in range(150)]
    i, p = spark.createDataFrame(spans, "i int, lo long, hi long"), spark.createDataFrame(points, "p int, x long")
    want = sorted((n, k) for n, x in points for k, a, b in spans if None not in (x, a) and a <= x and (b is None or x <= b))
    joined = intervals.points_within(p, i, "x", "lo", "hi")
    assert sorted(tuple(x) for x in joined.select("p", "i").collect()) == want
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    closed = [(n, a, b) for n, a, b in spans if None not in (a, b) and a <= b]
    one = spark.createDataFrame(closed, "i int, lo long, hi long")
    two = one.toDF("j", "from", "to")
    got = sorted(tuple(x) for x in intervals.overlapping(one, two, ("lo", "hi"), ("from", "to")).select("i", "j").collect())
    assert got == sorted((n, m) for n, a, b in closed for m, c, d in closed if a <= d and c <= b)
    for left, right in ((p.limit(0), i), (p, i.limit(0))):
        assert intervals.points_within(left, right, "x", "lo", "hi").count() == 0


def test_points_in_small_blocks_with_ties_against_a_loop(spark, monkeypatch):
    """Blocks that begin and end within equal times, more blocks than one interval meets, several units to a block."""
    for name, v in {"POINTS": 4, "UNIT": 3, "PAIRS": 50}.items():
        monkeypatch.setattr(intervals, name, v)
    r = random.Random(6)
    points = [(n, r.choice([7, 7, 7, 20, r.randrange(-30, 60)])) for n in range(90)]
    spans = [(n, a, None if n % 8 == 0 else a + r.choice([0, 0, 1, 5, 40])) for n, a in enumerate(r.choices([-40, 6, 7, 7, 8, 20, 21, 33, 70], k=60))]
    p, i = spark.createDataFrame(points, "p int, x long").repartition(3), spark.createDataFrame(spans, "i int, lo long, hi long")
    for open_low in (False, True):
        got = intervals.points_within(p, i, "x", "lo", "hi", open_low).select("p", "i").collect()
        assert sorted(map(tuple, got)) == sorted((n, k) for n, x in points for k, a, b in spans if (a < x or a == x and not open_low) and (b is None or x <= b))


def test_pairs_of_long_intervals_spread_over_tasks(spark):
    """Intervals that haven't ended meet nearly all points: no task gets most of the pairs, also where neither side is broadcast."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    p = spark.range(16_000).select(F.col("id").alias("x"))
    i = spark.range(4_000).select(F.col("id").alias("lo"), F.lit(None).cast("long").alias("hi"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sizes = [r["count"] for r in intervals.points_within(p, i, "x", "lo", "hi").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert sum(sizes) == sum(16_000 - k for k in range(4_000)) and max(sizes) <= 0.75 * sum(sizes)


# Profiles


def test_merged_profile(spark):
    rows = spark.range(60_000).select(F.col("id").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.when(F.col("id") % 3 != 0, F.repeat(F.lit(" x"), (F.col("id") % 5).cast("int"))).alias("c"))
    columns = ["a", "b", "c"]
    parts = [metrics.profile_part(rows.where(F.col("a") % 4 == k), columns) for k in range(4)]
    merged = metrics.merged_profile(parts[0].union(parts[1]).union(parts[2]).union(parts[3]), columns)
    plain = lambda df: {r["column_name"]: {k: v for k, v in r.asDict().items() if k != "domain"} for r in df.collect()}
    exact = metrics.column_profile(rows, columns)
    assert plain(merged) == plain(exact)
    domain = lambda df: {r["column_name"]: r["domain"] for r in df.collect()}
    for c, n in domain(exact).items():
        assert abs(domain(merged)[c] - n) <= 0.049 * n
    assert plain(metrics.merged_profile(metrics.profile_part(rows.limit(0), columns), columns))["a"]["nulls"] == 0


def test_a_profile_reads_what_is_new(spark, tmp_path):
    v = Vault(spark, str(tmp_path / "vault"))
    v.registry.insert("hub", config.HubConfig("thing", ("id",)))
    with pytest.raises(config.ConfigError, match="never loaded"):
        v.profile("hub", "thing", ["id"])
    hub, columns = v.table("hub", "thing"), ["id", "name"]
    rows = lambda a, b: spark.range(a, b).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    plain = lambda df: {r["column_name"]: {k: x for k, x in r.asDict().items() if k != "domain"} for r in df.collect()}
    exact = lambda: plain(metrics.column_profile(hub.read(), columns))
    hub.commit(rows(0, 50))
    first = hub.latest()
    assert plain(v.profile("hub", "thing", columns)) == exact()
    hub.commit(rows(90, 200))
    assert hub.added(first, hub.latest()).count() == 110
    for _ in range(2):
        assert plain(v.profile("hub", "thing", columns)) == exact()
    assert store.Table(spark, v.root, "profile/h_thing").read().count() == 2  # a row for each load, none for the call that found nothing new
    hub.compact()
    assert plain(v.profile("hub", "thing", columns)) == exact() and list(plain(v.profile("hub", "thing", ["id"]))) == ["id"]


# Marks


def test_marks_keep_every_byte(spark):
    values = [bytes.fromhex(x) for x in ("00", "0080", "00EF", "7FFF", "80", "FFFF", "00000000000000000000", "0000002A000001B000FF")]
    df = spark.createDataFrame([(v,) for v in values], "v binary")
    for r in df.select("v", marks.as_text(F.col("v"), df.schema["v"].dataType).alias("m"), F.hex(marks.next_lsn(F.col("v"))).alias("n")).collect():
        back = spark.range(1).select(marks.from_text(r["m"], df.schema["v"].dataType)).first()[0]
        up = int.from_bytes(r["v"], "big") + 1
        assert bytes(back) == bytes(r["v"])
        assert r["n"] == (None if up >= 256 ** len(r["v"]) else up.to_bytes(len(r["v"]), "big").hex().upper())
    assert spark.range(1).select(marks.zero_lsn()).first()[0] == bytes(10)
    assert spark.range(1).select(marks.from_text("17", spark.range(1).schema["id"].dataType)).first()[0] == 17


def test_a_delta_goes_on_after_a_binary_mark(spark, tmp_path):
    """The marks that lost bytes as text: a load up to 0080 is followed by one that takes 0081 to 00EF."""
    v, path = Vault(spark, str(tmp_path / "vault")), str(tmp_path / "changes")
    put = lambda *rows: spark.createDataFrame([(i, n, 2, bytes.fromhex(x)) for i, n, x in rows], "id long, name string, op int, lsn binary").write.mode("append").parquet(path)
    put((1, "a", "0001"), (2, "b", "0080"))
    v.registry.insert("hub", config.HubConfig("person", ("pk",)))
    v.registry.insert("satellite", config.SatelliteConfig("names", "person", "hub", {"name": ColumnDef("name", "varchar", length=5)}, buckets=4))
    source = stage.Source("people", "SequenceCdc", path=path, columns=("id", "name"), operation="op", sequence="lsn")
    v.registry.insert("source", config.SourceConfig(source, {"person": {"id": "pk"}}, satellites=("names",)))
    v.load("people", "Full", T1)
    put((1, "c", "0081"), (2, "d", "00EF"))
    v.load("people", "Delta", T2)
    assert sorted(r["name"] for r in temporal.point_in_time(v.table("sat", "names").read()).collect()) == ["c", "d"]
    assert {r["mark"] for r in v.states.read().where("kind = 'stage'").collect()} == {"0x0080", "0x00EF"}


# Stages


def test_a_stage_is_read_once_and_stays(spark, tmp_path):
    """A reader that gives other rows each time: hub and satellite see the same ones."""
    v, seen = Vault(spark, str(tmp_path / "vault")), []

    def reader(s, run):
        seen.append(1)
        return s.range(5).select(F.expr("cast(rand() * 1e15 as bigint)").alias("id"), F.lit("x").alias("name"))

    v.registry.insert("hub", config.HubConfig("thing", ("id",)))
    v.registry.insert("satellite", config.SatelliteConfig("thing", "thing", "hub", {"id": ColumnDef("own", "bigint"), "name": ColumnDef("name", "varchar", length=5)}, buckets=4))
    v.registry.insert("source", config.SourceConfig(stage.Source("things", kind="callable", reader=reader), {"thing": {"id": "id"}}, satellites=("thing",)))
    counts = v.load("things", "Full", T1)
    both = v.table("hub", "thing").read().join(v.table("sat", "thing").read(), "h_thing_key").where("id = own").count()
    assert counts == {"things": 5, "h_thing": 5, "s_thing": 5} and both == 5 and len(seen) == 1


def test_typed_stages(spark):
    rows = spark.createDataFrame([(1, "abc", None), (2, None, 5)], "a int, b string, z int")
    columns = [ColumnDef("a", "bigint", nullable=False), ColumnDef("b", "varchar", length=2, default="'?'"), ColumnDef("c", "int", default="7"), ColumnDef("d", "date"), ColumnDef("z", "int", retired=True)]
    out = stage.typed(rows, columns)
    assert [f.simpleString() for f in out.schema] == ["a:bigint", "b:string", "c:int", "d:date", "z:int"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "ab", 7, None, None), (2, "?", 7, None, None)]
    with pytest.raises(Exception, match="column b is null"):
        stage.typed(rows, [ColumnDef("b", "varchar", length=2, nullable=False)]).collect()


def test_declared_columns_are_only_replaced_on_a_rerun():
    r = config.Registry()
    r.insert("source", config.SourceConfig(stage.Source("s", path="x"), {}))
    r.declare("s", [ColumnDef("a", "int")])
    with pytest.raises(config.ConfigError, match="rerun"):
        r.declare("s", [ColumnDef("a", "bigint")])
    assert r.declare("s", [ColumnDef("a", "bigint")], rerun=True).source.declared[0].type == "bigint"


def test_reads_in_parts(spark):
    spark._jvm.System.setProperty("derby.stream.error.file", "/dev/null")
    options = {"url": "jdbc:derby:memory:parts;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "dbtable": "t"}
    spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).write.format("jdbc").options(**options).save()
    df = jdbc.read_parts(spark, options, "k", 4, after=899, until=979)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 80 and len(sizes) == 4 and max(sizes) < 25  # ranges of the window, not of the table
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(k,899)" in plan and "LessThanOrEqual(k,979)" in plan
    assert jdbc.read_parts(spark, options, "k", 4, after=5000).count() == 0
    assert jdbc.read_parts(spark, options, "k", 4).count() == 1000


def test_the_shared_folder_is_swept(spark):
    path = shared_folder(spark)
    for name in ("postings-" + "0" * 32, "postings-" + "1" * 32, "other-name", "9" * 32):
        spark.range(1).write.parquet(f"{path}/{name}")
    local = Path(path.removeprefix("file:"))
    for name in ("postings-" + "0" * 32, "other-name", "9" * 32):
        os.utime(local / name, (0, 0))
    assert sweep(spark, 24) == ["postings-" + "0" * 32]
    assert {"postings-" + "1" * 32, "other-name", "9" * 32} <= set(os.listdir(local))


# Streams


def test_streams_share_a_satellite(spark, tmp_path):
    """A second stream, a checkpoint that is reset, a load in between and a batch that comes twice."""
    sat, table = Satellite(("k",), ("v",)), store.Table(spark, str(tmp_path), "sat/s", ("k",), 4)
    schema = "k long, v string, dv_cdc_action string, n int"
    rows = lambda *v: spark.createDataFrame(v, schema)
    table.commit(initial(sat, rows(), T1, ""))
    days = iter(T1 + timedelta(days=d) for d in range(1, 20))

    def run(name, checkpoint):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / name))
        into_satellite(stream, sat, table, ["n"], str(tmp_path / checkpoint), "s", lambda: next(days)).awaitTermination()

    state = lambda: {r["k"]: r["v"] for r in table.read(part="current").collect()}
    rows((1, "a", "U", 0), (2, "b", "U", 0)).write.parquet(str(tmp_path / "one"))
    run("one", "cp1")
    rows((3, "c", "U", 0)).write.parquet(str(tmp_path / "two"))
    run("two", "cp2")
    assert state() == {1: "a", 2: "b", 3: "c"}
    table.commit(table.read(part="history"), note={"by": "another load"})
    table.compact()
    again, first = rows((1, "z", "U", 9)), stream_id(spark, str(tmp_path / "cp1"))
    assert not load_batch(again, first, 0, sat, table, ["n"], "s", T2)  # the ledger outlives other loads and compaction
    assert load_batch(again, first, 1, sat, table, ["n"], "s", T2) and not load_batch(again, first, 1, sat, table, ["n"], "s", T2)
    rows((3, None, "D", 1)).write.mode("append").parquet(str(tmp_path / "two"))
    run("two", "cp3")  # begun anew: all of it is another stream's
    assert state() == {1: "z", 2: "b"}
