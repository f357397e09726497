"""Loads and reads on small literal frames."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from siltstone.functions.naming import END, HIGH_DATE, IS_CURRENT, IS_TOMBSTONE, START
from siltstone.operators import compare, duplicates, hub, keys, link, lookup, metrics, satellite, temporal

T1, T2, T3 = datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)
SAT = satellite.Satellite(("k",), ("a", "b"))


def source(spark, rows):
    return spark.createDataFrame(rows, "k long, a int, b string")


def versions(table):
    return sorted((r["k"], r[IS_CURRENT], r[IS_TOMBSTONE], r[START], r[END], (r["a"], r["b"])) for r in table.collect())


def load(spark, table, rows, t, infer=True):
    return satellite.merge(SAT, table, source(spark, rows), t, "v", infer)


# Hubs and links


def test_hub_keys(spark):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "bk string")
    new = lambda roles, old=None: hub.new_rows(roles, old, "x", ["bk"], T1, "1")
    first = new([rows("a", "b", "b")])
    assert [(r["h_x_key"], r["bk"]) for r in first.orderBy("bk").collect()] == [(1, "a"), (2, "b")]
    assert new([rows("a", "b")], first).count() == 0
    assert sorted(r["bk"] for r in new([rows("a", "b"), rows("c", "a")]).collect()) == ["a", "b", "c"]
    assert [r["bk"] for r in new([rows("a", None)]).collect()] == ["a"]
    assert hub.rejected_keys([rows("a", None)], ["bk"]).first()[0] == 1
    later = new([rows("0", "a", "z")], first)
    assert [(r["h_x_key"], r["bk"]) for r in later.orderBy("bk").collect()] == [(3, "0"), (4, "z")]
    assert sorted(r["bk"] for r in hub.new_rows_by_except([rows("0", "a", None)], first, "x", ["bk"], T1, "1").collect()) == ["0"]


def test_composite_roles_match_by_name(spark):
    one = spark.createDataFrame([(1, "x")], "p int, q string")
    two = spark.createDataFrame([("x", 1)], "q string, p int")
    assert hub.business_keys([one, two], ["p", "q"]).count() == 1


def test_links(spark):
    rows = lambda *v: spark.createDataFrame(v, "r1 long, r2 long")
    first = link.new_rows(rows((1, 9), (1, 9), (2, 9)), None, "l", ["r1", "r2"], T1, "1")
    assert first.count() == 2
    assert link.new_rows(rows((1, 9)), first, "l", ["r1", "r2"], T1, "1").count() == 0
    assert link.new_rows(rows((1, 2), (2, 1), (None, 1)), None, "l", ["r1", "r2"], T1, "1").count() == 2


def test_numbers_follow_the_order_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), F.lit("x").alias("b"))
    out = keys.numbered(df, ["a", "b"], "n", after=5)
    assert sorted((r["a"], r["n"]) for r in out.collect()) == [(k, k + 6) for k in range(1000)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hash" not in plan and "SinglePartition" not in plan
    assert keys.numbered(df.limit(0), ["a", "b"], "n").count() == 0


def test_lookup_defaults(spark):
    hubs = spark.createDataFrame([("a", 1)], "bk string, h_x_key long")
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert [r[1] for r in lookup.hub_key(rows, hubs, {"s": "bk"}, "h_x_key").orderBy("s").collect()] == [-999, 1, -999]


# Satellites


def test_full_loads(spark):
    first = satellite.initial(SAT, source(spark, [(1, 1, "x"), (2, 1, None)]), T1, "v")
    assert versions(first) == [(1, True, False, T1, HIGH_DATE, (1, "x")), (2, True, False, T1, HIGH_DATE, (1, None))]
    assert versions(load(spark, first, [(1, 1, "x"), (2, 1, None)], T2)) == versions(first)
    second = load(spark, first, [(1, 1, None)], T2)
    assert versions(second) == [
        (1, False, False, T1, T2, (1, "x")), (1, True, False, T2, HIGH_DATE, (1, None)),
        (2, False, False, T1, T2, (1, None)), (2, False, True, T2, T2, (None, None)),
    ]
    assert versions(load(spark, second, [(1, 1, None)], T3)) == versions(second)
    third = load(spark, second, [(1, 1, None), (2, 5, "n")], T3)
    assert versions(third) == sorted([*versions(second), (2, True, False, T3, HIGH_DATE, (5, "n"))])


def test_a_merge_is_one_join(spark):
    first = satellite.initial(SAT, source(spark, [(1, 1, "x"), (2, 1, "y")]), T1, "v")
    plan = load(spark, first, [(1, 2, "x")], T2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan


def test_payload_types_are_the_satellites_own(spark):
    first = satellite.initial(SAT, source(spark, [(1, 1, "x")]), T1, "v")
    other = spark.createDataFrame([(1, "1", "x"), (2, "7", "y")], "k long, a string, b string")
    done = satellite.merge(SAT, first, other, T2, "v", True)
    assert done.schema["a"].dataType == first.schema["a"].dataType
    assert versions(done) == [(1, True, False, T1, HIGH_DATE, (1, "x")), (2, True, False, T2, HIGH_DATE, (7, "y"))]


def test_delta_keeps_missing_keys(spark):
    first = satellite.initial(SAT, source(spark, [(1, 1, "x"), (2, 1, "y")]), T1, "v")
    assert versions(load(spark, first, [(1, 1, "x")], T2, infer=False)) == versions(first)


def test_change_at_the_same_instant(spark):
    first = satellite.initial(SAT, source(spark, [(1, 1, "x")]), T1, "v")
    after = T1 + timedelta(milliseconds=1)
    assert versions(load(spark, first, [(1, 2, "x")], T1)) == [(1, False, False, T1, after, (1, "x")), (1, True, False, after, HIGH_DATE, (2, "x"))]


def slow_replay(current, changes):
    """States kept after the current one, row by row; None is a tombstone."""
    state, kept = current, []
    for action, value in changes:
        new = None if action == "D" else value
        if new != state:
            kept.append(new)
            state = new
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_replay_like_row_by_row(spark, seed):
    rng = random.Random(seed)
    start = {k: rng.choice([None, 1, 2]) for k in range(40)}
    changes = {k: [(rng.choice("UUD"), rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 7))] for k in start}
    table = satellite.initial(SAT, source(spark, [(k, v, "s") for k, v in start.items() if v is not None]), T1, "v")
    rows = [(k, a, None if a == "D" else v, None if a == "D" else "s", n) for k, own in changes.items() for n, (a, v) in enumerate(own)]
    frame = spark.createDataFrame(rows, "k long, dv_cdc_action string, a int, b string, n int")
    done = satellite.replay(SAT, table, frame, ["n"], T2, "w")
    whole = versions(done)
    for k in start:
        own = sorted((r for r in whole if r[0] == k), key=lambda r: (r[3], not r[2]))
        got = [None if r[2] else r[5][0] for r in own]
        assert got == [v for v in [start[k]] if v is not None] + slow_replay(start[k], changes[k])
        assert sum(r[1] for r in own) == (bool(got) and got[-1] is not None)
        for one, two in zip(own, own[1:]):
            assert one[4] == two[3] if not one[2] else one[4] == one[3]


@pytest.mark.parametrize("seed", range(2))
def test_histories_are_sound_and_reproduce_every_snapshot(spark, seed):
    rng = random.Random(seed)
    table, fed = None, []
    for n in range(4):
        t = T1 + timedelta(days=n)
        rows = [(k, rng.randint(1, 2), rng.choice(["x", None])) for k in range(25) if rng.random() < 0.8]
        fed.append((t, rows))
        table = satellite.initial(SAT, source(spark, rows), t, "v") if table is None else load(spark, table, rows, t)
    whole = versions(table)
    for k in range(25):
        own = sorted((r for r in whole if r[0] == k and not r[2]), key=lambda r: r[3])
        assert sum(r[1] for r in own) <= 1
        assert all(a[4] <= b[3] for a, b in zip(own, own[1:]))
    for t, rows in fed:
        assert sorted((r["k"], r["a"], r["b"] or "") for r in temporal.point_in_time(table, t).collect()) == sorted((k, a, b or "") for k, a, b in rows)
    assert satellite.duplicate_versions(SAT, table).count() == 0


# Reads, comparison, metrics


@pytest.fixture
def history(spark):
    first = satellite.initial(SAT, source(spark, [(1, 1, "x")]), T1, "v")
    return load(spark, load(spark, first, [(1, 2, "x")], T2), [], T3)


def test_reads_in_time(history):
    at = lambda t: [r["a"] for r in temporal.point_in_time(history, t).collect()]
    assert [at(t) for t in (None, T1, T2 - timedelta(microseconds=1), T2, T3)] == [[], [1], [1], [2], []]
    assert sorted((r[IS_TOMBSTONE], r["a"]) for r in temporal.changes_between(history, T1, T3).collect()) == [(False, 2), (True, None)]


def test_days(spark, history):
    assert [r[0] for r in temporal.day_ends(spark, date(2024, 1, 1), date(2024, 1, 3)).collect()] == [datetime(2024, 1, d, 23, 59, 59, 999000) for d in (1, 2, 3)]
    grid = {r["pit_date"]: r["a"] for r in temporal.daily_grid(history, date(2023, 12, 30), date(2024, 3, 5)).collect()}
    days = [r[0] for r in temporal.day_ends(spark, date(2023, 12, 30), date(2024, 3, 5)).collect()]
    assert grid == {d: rows[0]["a"] for d in days if (rows := temporal.point_in_time(history, d).collect())}


def test_left_right(spark):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "c int")
    found = compare.left_right(rows(1, 2, None, 1), rows(2, 3, None, 3).withColumnRenamed("c", "d").select(F.col("d").cast("string").alias("d")), [("c", "d")])
    assert sorted(tuple(r) for r in found.collect()) == [("left", 1), ("right", 3)]


def test_duplicate_policy(spark):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "k long")
    with pytest.raises(duplicates.DuplicateKeys):
        duplicates.apply_policy(rows(1, 1, 2), ["k"], 0)
    with pytest.raises(duplicates.DuplicateKeys):
        duplicates.apply_policy(rows(1, 1, 1, 2), ["k"], 2)
    clean, aside = duplicates.apply_policy(rows(1, 1, 2, 2, 3), ["k"], 4)
    assert [r[0] for r in clean.collect()] == [3] and aside.count() == 4
    assert duplicates.apply_policy(rows(1, 2), ["k"], 0)[1] is None


def test_metrics(spark, history):
    assert tuple(metrics.satellite_counts(history).first()) == (3, 0, 2, 1)
    df = spark.createDataFrame([(1, " "), (1, "ab "), (None, None)], "n int, s string")
    mixed = spark.createDataFrame([(1, 2.5, "b", T1, b"x", True), (10, -1.0, "B", T2, None, False), (9, None, None, T1, b"x", True)], "i long, d double, s string, t timestamp, b binary, f boolean")
    rows = {r["column_name"]: tuple(r)[1:] for r in metrics.column_profile(mixed, mixed.columns).collect()}
    assert rows["i"] == ("1", "10", 3, 0, 0, 0, 0) and rows["d"] == ("-1.0", "2.5", 2, 1, 0, 0, 0) and rows["s"] == ("B", "b", 2, 1, 0, 1, 1)
    assert rows["b"] == (None, None, 1, 1, 0, 0, 0) and rows["f"] == ("false", "true", 2, 0, 0, 0, 0) and rows["t"][2:] == (2, 0, 0, 0, 0)
    numbers = metrics.column_profile(mixed, ["i", "d"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in numbers and "SortAggregate" not in numbers
    assert [k for k in range(1, 15) if metrics.profiled_today(k, date(2024, 1, 7))] == [7, 14]  # a Sunday
    assert metrics.profiled_today(3, date(2024, 1, 7), "Full") and metrics.profiled_today(3, date(2024, 1, 7), only=3) and not metrics.profiled_today(4, date(2024, 1, 7), only=3)
    assert [tuple(r)[:4] for r in metrics.satellite_profile(history, ["a"], T2).collect()] == [("a", "2", "2", 1)]
    got = {r["column_name"]: tuple(r)[1:] for r in metrics.column_profile(df, ["n", "s"]).collect()}
    assert got == {"n": ("1", "1", 1, 1, 0, 0, 0), "s": (" ", "ab ", 2, 1, 1, 0, 2)}
