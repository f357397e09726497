"""The engine's queries over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import macros, marks, naming, scalar
from siltstone.functions.naming import END, IS_CURRENT, IS_TOMBSTONE, LOAD_TIME, RECORD_SOURCE, SOURCE_TIME, START
from siltstone.functions.types import ColumnDef
from siltstone.operators import compare, duplicates, hub, intervals, link, lookup, metrics, satellite, temporal
from siltstone.plans import config, release, scheduler, state
from siltstone.plans.pipeline import Vault
from siltstone.plans.shared import checkpointed, shared_folder
from siltstone.plans.store import Table
from siltstone.sources import stage
from siltstone.streaming.cdc import into_satellite, load_batch, stream_id

T1, T2, T3 = datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)
CUSTOMER = satellite.Satellite(("h_customer_key",), ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
USER = satellite.Satellite(("user_id",), ("event_type", "value"))
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame, drop: tuple[str, ...] = (SOURCE_TIME,)) -> DataFrame:
    """Times as dates (all loads are at midnight), so that the high date is comparable everywhere."""
    out = df.drop(*drop)
    return out.withColumns({c: F.to_date(c) for c in (START, END, LOAD_TIME) if c in out.columns})


# Hubs and links


def customer_hub(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return hub.new_rows([table(spark, sf_dir, "customer").where(where)], None, "customer", ["c_custkey"], T1, "1")


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS h_customer_key, DATE '2024-01-01' AS dv_load_date_time, '1' AS dv_record_source, c_custkey FROM (SELECT DISTINCT c_custkey FROM customer)")
def hub_customer_initial(spark, sf_dir):
    return plain(customer_hub(spark, sf_dir))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS h_nation_key, DATE '2024-01-01' AS dv_load_date_time, '1' AS dv_record_source, n_nationkey FROM (SELECT c_nationkey AS n_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def hub_nation_two_roles(spark, sf_dir):
    roles = [table(spark, sf_dir, t).select(F.col(c).alias("n_nationkey")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return plain(hub.new_rows(roles, None, "nation", ["n_nationkey"], T1, "1"))


_LATER = """WITH old AS (SELECT row_number() OVER (ORDER BY c_custkey) AS k, c_custkey FROM customer WHERE c_custkey % 3 = 0)
SELECT (SELECT max(k) FROM old) + row_number() OVER (ORDER BY c_custkey) AS h_customer_key, DATE '2024-02-01' AS dv_load_date_time, '2' AS dv_record_source, c_custkey
FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM old)"""


@query(_LATER)
def hub_incremental_insert(spark, sf_dir):
    old = customer_hub(spark, sf_dir, "c_custkey % 3 = 0")
    return plain(hub.new_rows([table(spark, sf_dir, "customer")], old, "customer", ["c_custkey"], T2, "2"))


@query(_LATER)
def hub_except_variant(spark, sf_dir):
    old = customer_hub(spark, sf_dir, "c_custkey % 3 = 0")
    return plain(hub.new_rows_by_except([table(spark, sf_dir, "customer")], old, "customer", ["c_custkey"], T2, "2"))


@query("SELECT CAST(count(*) AS BIGINT) AS rejected FROM customer WHERE c_custkey % 5 = 0")
def hub_rejected_null_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("c_custkey"))
    return hub.rejected_keys([rows], ["c_custkey"])


_H = "h AS (SELECT row_number() OVER (ORDER BY c_custkey) AS h_customer_key, c_custkey FROM (SELECT DISTINCT c_custkey FROM customer)), o AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS h_orders_key, o_orderkey FROM (SELECT DISTINCT o_orderkey FROM orders))"


def orders_hub(spark, sf_dir) -> DataFrame:
    return hub.new_rows([table(spark, sf_dir, "orders")], None, "orders", ["o_orderkey"], T1, "1")


def order_links(spark, sf_dir, where: str = "true") -> DataFrame:
    rows = table(spark, sf_dir, "orders").where(where)
    rows = lookup.hub_key(rows, orders_hub(spark, sf_dir), {"o_orderkey": "o_orderkey"}, "h_orders_key", default=None)
    return lookup.hub_key(rows, customer_hub(spark, sf_dir), {"o_custkey": "c_custkey"}, "h_customer_key", default=None)


@query(f"WITH {_H} SELECT row_number() OVER (ORDER BY h_orders_key, h_customer_key) AS l_order_customer_key, DATE '2024-01-01' AS dv_load_date_time, '1' AS dv_record_source, h_orders_key, h_customer_key FROM (SELECT DISTINCT h_orders_key, h_customer_key FROM orders JOIN o USING (o_orderkey) JOIN h ON c_custkey = o_custkey)")
def link_order_customer(spark, sf_dir):
    return plain(link.new_rows(order_links(spark, sf_dir), None, "order_customer", ["h_orders_key", "h_customer_key"], T1, "1"))


@query(f"WITH {_H}, k AS (SELECT DISTINCT h_orders_key, h_customer_key, o_orderkey % 4 <> 0 AS was FROM orders JOIN o USING (o_orderkey) JOIN h ON c_custkey = o_custkey) SELECT (SELECT count(*) FROM k WHERE was) + row_number() OVER (ORDER BY h_orders_key, h_customer_key) AS l_order_customer_key, DATE '2024-02-01' AS dv_load_date_time, '2' AS dv_record_source, h_orders_key, h_customer_key FROM k WHERE NOT was")
def link_incremental_insert(spark, sf_dir):
    roles = ["h_orders_key", "h_customer_key"]
    old = link.new_rows(order_links(spark, sf_dir, "o_orderkey % 4 <> 0"), None, "order_customer", roles, T1, "1")
    return plain(link.new_rows(order_links(spark, sf_dir), old, "order_customer", roles, T2, "2"))


@query("SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey) AS l_lineitem_key, DATE '2024-01-01' AS dv_load_date_time, '1' AS dv_record_source, l_orderkey, l_partkey, l_suppkey FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)")
def link_lineitem_three_roles(spark, sf_dir):
    return plain(link.new_rows(table(spark, sf_dir, "lineitem"), None, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey"], T1, "1"))


@query("WITH n AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS k, n_nationkey FROM nation) SELECT row_number() OVER (ORDER BY a, b) AS l_nation_peer_key, a AS h_buyer_key, b AS h_seller_key FROM (SELECT DISTINCT x.k AS a, y.k AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN n x ON x.n_nationkey = c_nationkey JOIN n y ON y.n_nationkey = s_nationkey)")
def link_same_as(spark, sf_dir):
    nations = hub.new_rows([table(spark, sf_dir, "nation")], None, "nation", ["n_nationkey"], T1, "1")
    pairs = (
        table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .select("c_nationkey", "s_nationkey").distinct()
    )
    rows = lookup.hub_key(pairs, nations, {"c_nationkey": "n_nationkey"}, "h_nation_key", "h_buyer_key", None)
    rows = lookup.hub_key(rows, nations, {"s_nationkey": "n_nationkey"}, "h_nation_key", "h_seller_key", None)
    return link.new_rows(rows, None, "nation_peer", ["h_buyer_key", "h_seller_key"], T1, "1").drop(LOAD_TIME, RECORD_SOURCE)


# Lookups, casts, computed columns, duplicates


@query("WITH h AS (SELECT row_number() OVER (ORDER BY c_custkey) AS k, c_custkey FROM customer WHERE c_custkey % 2 = 0) SELECT o_orderkey, coalesce(k, -999) AS h_customer_key FROM orders LEFT JOIN h ON c_custkey = o_custkey")
def lookup_failed_key_default(spark, sf_dir):
    half = customer_hub(spark, sf_dir, "c_custkey % 2 = 0")
    return lookup.hub_key(table(spark, sf_dir, "orders"), half, {"o_custkey": "c_custkey"}, "h_customer_key").select("o_orderkey", "h_customer_key")


@query(f"WITH {_H}, k AS (SELECT o_orderkey, h_orders_key, h_customer_key FROM orders JOIN o USING (o_orderkey) JOIN h ON c_custkey = o_custkey), l AS (SELECT row_number() OVER (ORDER BY h_orders_key, h_customer_key) AS lk, * FROM (SELECT DISTINCT h_orders_key, h_customer_key FROM k WHERE o_orderkey % 4 <> 0)) SELECT o_orderkey, coalesce(lk, -999) AS l_order_customer_key FROM k LEFT JOIN l USING (h_orders_key, h_customer_key)")
def lookup_link_key(spark, sf_dir):
    roles = ["h_orders_key", "h_customer_key"]
    links = link.new_rows(order_links(spark, sf_dir, "o_orderkey % 4 <> 0"), None, "order_customer", roles, T1, "1")
    return lookup.link_key(order_links(spark, sf_dir), links, roles, "l_order_customer_key").select("o_orderkey", "l_order_customer_key")


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, substr(p_name, 1, 8) AS p_name, CAST(p_retailprice AS DECIMAL(12,2)) AS p_retailprice, CAST(NULL AS VARCHAR) AS p_brand FROM part")
def payload_cast_and_retired(spark, sf_dir):
    columns = {
        "p_size": ColumnDef("p_size", "bigint"), "p_name": ColumnDef("p_name", "varchar", length=8),
        "p_retailprice": ColumnDef("p_retailprice", "decimal", precision=12, scale=2), "p_brand": ColumnDef("p_brand", "varchar", length=-1, retired=True),
    }
    return lookup.payload(table(spark, sf_dir, "part"), columns, ["p_partkey"])


@query("SELECT o_orderkey, o_orderstatus || '-' || o_orderpriority AS label, CAST(length(o_orderstatus || '-' || o_orderpriority) AS INT) AS label_size, CAST(length(o_orderstatus || '-' || o_orderpriority) * 2 AS INT) AS twice FROM orders")
def computed_columns_chain(spark, sf_dir):
    label = macros.expand("dv_concat(##1, #-#, ##2)", ["o_orderstatus", "o_orderpriority"])
    rows = macros.computed(table(spark, sf_dir, "orders"), [("label", label), ("label_size", "length(label)"), ("twice", "label_size * 2")])
    return rows.select("o_orderkey", "label", "label_size", "twice")


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys_detected(spark, sf_dir):
    return duplicates.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
def dup_keys_removed(spark, sf_dir):
    clean, _ = duplicates.apply_policy(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], 2**62)
    return clean.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 4 AS severity, 'Duplicate Key Removed' AS message FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def dup_rows_journaled(spark, sf_dir):
    """What is set aside goes to the journal, and is read back from there."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    _, aside = duplicates.apply_policy(rows, ["l_orderkey", "l_linenumber"], 2**62)
    journal = state.Journal(state.Log(spark, f"{shared_folder(spark)}/journal-{uuid4().hex}", state.JOURNAL_SCHEMA))
    journal.write_rows(rows.limit(0) if aside is None else aside, T1, 1, "s_lineitem", "warning", duplicates.REMOVED)
    kept = journal.log.read()
    return kept.select(F.from_json("detail", rows.schema).alias("d"), "severity", "message").select("d.*", "severity", "message")


# Satellites


def customer_rows(spark, sf_dir, version: int = 1, hubs: DataFrame | None = None) -> DataFrame:
    """Snapshots of customers with their hub key; the second has changed, emptied and missing rows."""
    rows = table(spark, sf_dir, "customer")
    if version == 2:
        k = F.col("c_custkey")
        rows = rows.where(k % 11 != 0).withColumns(
            {"c_acctbal": F.when(k % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")), "c_mktsegment": F.when(k % 13 != 0, F.col("c_mktsegment"))}
        )
    return lookup.hub_key(rows, customer_hub(spark, sf_dir) if hubs is None else hubs, {"c_custkey": "c_custkey"}, "h_customer_key")


def loads(spark, sf_dir, upto: int, infer: bool = True) -> DataFrame:
    """The customer satellite after one, two or three loads."""
    hubs = customer_hub(spark, sf_dir)
    whole = satellite.initial(CUSTOMER, customer_rows(spark, sf_dir, 1, hubs), T1, "1")
    for k, (version, t) in enumerate(((2, T2), (1, T3)), 2):
        if k <= upto:
            whole = satellite.merge(CUSTOMER, whole, customer_rows(spark, sf_dir, version, hubs), t, str(k), infer)
    return whole


_P = "c_name, c_nationkey, c_acctbal, c_mktsegment"
_SAT = f"""WITH h AS (SELECT row_number() OVER (ORDER BY c_custkey) AS h_customer_key, * FROM customer),
v2 AS (SELECT h_customer_key, c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS c_mktsegment FROM h WHERE c_custkey % 11 <> 0),
ch AS (SELECT h_customer_key FROM v2 WHERE c_custkey % 7 = 0 OR c_custkey % 13 = 0), gone AS (SELECT h_customer_key FROM h WHERE c_custkey % 11 = 0),
d AS (SELECT DATE '2024-01-01' AS t1, DATE '2024-02-01' AS t2, DATE '2024-03-01' AS t3, DATE '9999-12-31' AS hd),
one AS (SELECT h_customer_key, '1' AS dv_record_source, h_customer_key NOT IN (FROM ch) AND h_customer_key NOT IN (FROM gone) AS dv_row_is_current, false AS dv_is_tombstone, t1 AS dv_rowstartdate, CASE WHEN h_customer_key IN (FROM ch) OR h_customer_key IN (FROM gone) THEN t2 ELSE hd END AS dv_rowenddate, {_P} FROM h, d),
two AS (SELECT h_customer_key, '2' AS dv_record_source, true AS dv_row_is_current, false AS dv_is_tombstone, t2 AS dv_rowstartdate, hd AS dv_rowenddate, {_P} FROM v2, d WHERE h_customer_key IN (FROM ch)),
tomb AS (SELECT h_customer_key, '2' AS dv_record_source, false AS dv_row_is_current, true AS dv_is_tombstone, t2 AS dv_rowstartdate, t2 AS dv_rowenddate, NULL AS c_name, NULL AS c_nationkey, NULL AS c_acctbal, NULL AS c_mktsegment FROM gone, d)
"""
_AFTER2 = "(FROM one UNION ALL FROM two UNION ALL FROM tomb)"
_AFTER3 = f"""(FROM one UNION ALL SELECT * REPLACE (false AS dv_row_is_current, DATE '2024-03-01' AS dv_rowenddate) FROM two UNION ALL FROM tomb
UNION ALL SELECT h_customer_key, '3', true, false, t3, hd, {_P} FROM h, d WHERE h_customer_key IN (FROM ch) OR h_customer_key IN (FROM gone))"""


@query(f"SELECT row_number() OVER (ORDER BY c_custkey) AS h_customer_key, '1' AS dv_record_source, true AS dv_row_is_current, false AS dv_is_tombstone, DATE '2024-01-01' AS dv_rowstartdate, DATE '9999-12-31' AS dv_rowenddate, {_P} FROM customer")
def sat_initial_load(spark, sf_dir):
    return plain(loads(spark, sf_dir, 1))


@query(_SAT + "FROM two")
def sat_changed_rows(spark, sf_dir):
    return plain(loads(spark, sf_dir, 2).where((F.col(START) == F.lit(T2).cast("timestamp_ntz")) & ~F.col(IS_TOMBSTONE)))


@query(_SAT + "SELECT CAST(count(*) AS BIGINT) AS n_changed FROM ch")
def sat_null_safe_change(spark, sf_dir):
    first = loads(spark, sf_dir, 2)
    again = satellite.merge(CUSTOMER, first, customer_rows(spark, sf_dir, 2), T3, "3", True)
    return again.agg(F.count_if((F.col(RECORD_SOURCE) != "1") & ~F.col(IS_TOMBSTONE)).alias("n_changed"))


@query(_SAT + f"FROM {_AFTER2}")
def sat_inferred_delete(spark, sf_dir):
    return plain(loads(spark, sf_dir, 2))


@query(_SAT + "SELECT * REPLACE (CASE WHEN h_customer_key IN (FROM ch) THEN false ELSE true END AS dv_row_is_current, CASE WHEN h_customer_key IN (FROM ch) THEN DATE '2024-02-01' ELSE DATE '9999-12-31' END AS dv_rowenddate) FROM one UNION ALL FROM two")
def sat_delta_no_delete(spark, sf_dir):
    return plain(loads(spark, sf_dir, 2, infer=False))


@query(_SAT + f"FROM {_AFTER3}")
def sat_reappearing_key(spark, sf_dir):
    return plain(loads(spark, sf_dir, 3))


@query("SELECT c_custkey AS k, CAST(CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_versions, CAST(CASE WHEN c_custkey % 7 = 0 THEN 1 END AS BIGINT) AS closed_after_ms FROM customer")
def sat_same_instant_guard(spark, sf_dir):
    shape = satellite.Satellite(("k",), ("v",))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    first = satellite.initial(shape, rows, T1, "1")
    new = rows.withColumn("v", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    whole = satellite.merge(shape, first, new, T1, "2", True)
    closed = F.when(~F.col(IS_CURRENT), F.timestamp_diff("MILLISECOND", F.col(START), F.col(END)))
    return whole.groupBy("k").agg(F.count("*").alias("n_versions"), F.max(closed).alias("closed_after_ms"))


def event_changes(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "error", "D").otherwise("U")
    coarse = F.floor(F.col("value") / 50).cast("long")
    rows = rows.select("user_id", "ts", action.alias("dv_cdc_action"), "event_type", coarse.alias("value"))
    return stage.nullify_deleted(rows, ["user_id"], ["ts"])


def replayed(spark, sf_dir) -> DataFrame:
    changes = event_changes(spark, sf_dir)
    empty = satellite.initial(USER, changes, T1, "").limit(0)
    return satellite.replay(USER, empty, changes, ["ts"], T1, "1")


_REPLAY = """WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn, event_type = 'error' AS gone, CASE WHEN event_type <> 'error' THEN event_type END AS e, CASE WHEN event_type <> 'error' THEN CAST(floor(value / 50) AS BIGINT) END AS v FROM events),
p AS (SELECT *, lag(gone, 1, true) OVER w AS pg, lag(e) OVER w AS pe, lag(v) OVER w AS pv FROM c WINDOW w AS (PARTITION BY user_id ORDER BY rn)),
k AS (SELECT * FROM p WHERE gone IS DISTINCT FROM pg OR e IS DISTINCT FROM pe OR v IS DISTINCT FROM pv),
f AS (SELECT *, lead(rn) OVER (PARTITION BY user_id ORDER BY rn) AS nx FROM k),
r AS (SELECT user_id, NOT gone AND nx IS NULL AS dv_row_is_current, gone AS dv_is_tombstone, CAST(rn AS BIGINT) AS start_us, CAST(CASE WHEN gone THEN rn ELSE nx END AS BIGINT) AS end_us, e AS event_type, v AS value FROM f)
"""


def _micro(df: DataFrame) -> DataFrame:
    since = lambda c: F.timestamp_diff("MICROSECOND", F.lit(T1).cast("timestamp_ntz"), F.col(c))
    return df.select("user_id", IS_CURRENT, IS_TOMBSTONE, since(START).alias("start_us"), F.when(~F.col(IS_CURRENT), since(END)).alias("end_us"), "event_type", "value")


@query(_REPLAY + "FROM r")
def sat_cdc_replay(spark, sf_dir):
    return _micro(replayed(spark, sf_dir))


@query(_REPLAY + "SELECT CAST(count(*) AS BIGINT) AS n_leading_tombstones FROM r WHERE dv_is_tombstone AND start_us = 1")
def sat_cdc_delete_unknown(spark, sf_dir):
    first = F.col(IS_TOMBSTONE) & (F.col("start_us") == 1)
    return _micro(replayed(spark, sf_dir)).agg(F.count_if(first).alias("n_leading_tombstones"))


@query(_SAT + f"SELECT h_customer_key, dv_rowstartdate AS dv_start, CAST(2 AS BIGINT) AS n FROM {_AFTER2} WHERE dv_row_is_current AND h_customer_key % 5 = 0")
def sat_duplicate_versions(spark, sf_dir):
    """A satellite into which some current versions were put twice."""
    whole = loads(spark, sf_dir, 2)
    spoiled = whole.unionByName(whole.where(F.col(IS_CURRENT) & (F.col("h_customer_key") % 5 == 0)))
    return plain(satellite.duplicate_versions(CUSTOMER, spoiled)).withColumnRenamed(START, "dv_start")


# Reads in time


@query(_SAT + f"SELECT h_customer_key, {_P} FROM {_AFTER3} WHERE dv_row_is_current")
def pit_current(spark, sf_dir):
    return temporal.point_in_time(loads(spark, sf_dir, 3)).select("h_customer_key", *CUSTOMER.payload)


@query(_SAT + f"SELECT h_customer_key, {_P} FROM {_AFTER3} WHERE NOT dv_is_tombstone AND dv_rowstartdate <= DATE '2024-02-15' AND dv_rowenddate > DATE '2024-02-15'")
def pit_as_of(spark, sf_dir):
    return temporal.point_in_time(loads(spark, sf_dir, 3), datetime(2024, 2, 15)).select("h_customer_key", *CUSTOMER.payload)


@query(_SAT + f"FROM {_AFTER3} WHERE dv_rowstartdate > DATE '2024-01-01' AND dv_rowstartdate <= DATE '2024-02-01'")
def net_changes_window(spark, sf_dir):
    return plain(temporal.changes_between(loads(spark, sf_dir, 3), T1, T2))


@query(_SAT + f"SELECT h_customer_key, c_acctbal, CAST(g AS DATE) AS day FROM {_AFTER3}, generate_series(TIMESTAMP '2024-01-25', TIMESTAMP '2024-02-05', INTERVAL 1 DAY) AS s(g) WHERE NOT dv_is_tombstone AND dv_rowstartdate <= g + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AND dv_rowenddate > g + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND")
def pit_daily_grid(spark, sf_dir):
    grid = temporal.daily_grid(loads(spark, sf_dir, 3), date(2024, 1, 25), date(2024, 2, 5))
    return grid.select("h_customer_key", "c_acctbal", F.to_date("pit_date").alias("day"))


# Comparison and metrics


@query("(SELECT 'left' AS _master_table, * FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) UNION ALL (SELECT 'right', * FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents))")
def compare_stage_stage(spark, sf_dir):
    return compare.left_right(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), [("doc_id", "doc_id")])


@query(_SAT + f", s AS (FROM {_AFTER3}), a AS (SELECT h_customer_key, c_acctbal, c_mktsegment FROM s WHERE NOT dv_is_tombstone AND dv_rowstartdate <= DATE '2024-01-10' AND dv_rowenddate > DATE '2024-01-10'), b AS (SELECT h_customer_key, c_acctbal, c_mktsegment FROM s WHERE NOT dv_is_tombstone AND dv_rowstartdate <= DATE '2024-02-10' AND dv_rowenddate > DATE '2024-02-10') SELECT *, row_number() OVER (ORDER BY _master_table, h_customer_key, c_acctbal, c_mktsegment) AS _match_row FROM (SELECT 'left' AS _master_table, * FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'right', * FROM (FROM b EXCEPT FROM a))")
def compare_sat_sat_pit(spark, sf_dir):
    whole = checkpointed(loads(spark, sf_dir, 3))  # both sides read it
    sides = [temporal.point_in_time(whole, datetime(2024, m, 10)) for m in (1, 2)]
    columns = ["h_customer_key", "c_acctbal", "c_mktsegment"]
    return compare.with_match_row(compare.left_right(*sides, [(c, c) for c in columns]))


@query("SELECT 'left' AS _master_table, o_orderkey AS orders__o_orderkey, o_custkey AS customer__c_custkey FROM orders WHERE o_orderkey % 4 = 0 GROUP BY ALL")
def compare_link_business_keys(spark, sf_dir):
    roles = ["h_orders_key", "h_customer_key"]
    hubs = {"h_orders_key": (orders_hub(spark, sf_dir), "h_orders_key", ["o_orderkey"]), "h_customer_key": (customer_hub(spark, sf_dir), "h_customer_key", ["c_custkey"])}
    sides = [compare.link_business_keys(link.new_rows(order_links(spark, sf_dir, w), None, "oc", roles, T1, "1"), hubs) for w in ("true", "o_orderkey % 4 <> 0")]
    return compare.left_right(*sides, [(c, c) for c in ("orders__o_orderkey", "customer__c_custkey")])


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE '2' END AS dv_record_source, CAST(count(*) AS BIGINT) AS n_rows, CASE WHEN c_custkey % 3 = 0 THEN 'thirds' ELSE 'rest' END AS source_name FROM customer GROUP BY ALL")
def metrics_hub(spark, sf_dir):
    old = customer_hub(spark, sf_dir, "c_custkey % 3 = 0")
    new = hub.new_rows([table(spark, sf_dir, "customer")], old, "customer", ["c_custkey"], T2, "2")
    names = spark.sql("SELECT '1' AS dv_record_source, 'thirds' AS source_name UNION ALL SELECT '2', 'rest'")
    return metrics.by_record_source(old.unionByName(new), names, F.lit(T3).cast("timestamp_ntz"))


@query("SELECT '1' AS dv_record_source, CAST(count(*) AS BIGINT) AS n_rows FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)")
def metrics_link(spark, sf_dir):
    rows = link.new_rows(table(spark, sf_dir, "lineitem"), None, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey"], T1, "1")
    return metrics.by_record_source(rows)


@query(_SAT + f"SELECT CAST(count(*) AS BIGINT) AS n_total, CAST(count(*) FILTER (dv_row_is_current) AS BIGINT) AS n_current, CAST(count(*) FILTER (NOT dv_row_is_current AND NOT dv_is_tombstone) AS BIGINT) AS n_versioned, CAST(count(*) FILTER (dv_is_tombstone) AS BIGINT) AS n_tombstones FROM {_AFTER3}")
def metrics_sat(spark, sf_dir):
    return metrics.satellite_counts(loads(spark, sf_dir, 3))


def _profile_sql(name: str, columns: dict[str, bool]) -> str:
    part = lambda c, text: (
        f"SELECT '{c}' AS column_name, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest, CAST(count(DISTINCT {c}) AS BIGINT) AS domain, CAST(count(*) - count({c}) AS BIGINT) AS nulls, "
        + (f"CAST(count(*) FILTER (trim({c}) = '') AS BIGINT) AS blanks, CAST(min(length(rtrim({c}))) AS BIGINT) AS least_length, CAST(max(length(rtrim({c}))) AS BIGINT) AS greatest_length" if text else "CAST(0 AS BIGINT) AS blanks, CAST(0 AS BIGINT) AS least_length, CAST(0 AS BIGINT) AS greatest_length")
        + f" FROM {name}"
    )
    return " UNION ALL ".join(part(c, t) for c, t in columns.items())


@query(_profile_sql("lineitem", {"l_orderkey": False, "l_partkey": False, "l_linenumber": False, "l_returnflag": True, "l_linestatus": True}))
def metrics_columns(spark, sf_dir):
    return metrics.column_profile(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"])


@query(_SAT + f", p AS (FROM {_AFTER3} WHERE NOT dv_is_tombstone AND dv_rowstartdate <= DATE '2024-02-15' AND dv_rowenddate > DATE '2024-02-15') " + _profile_sql("p", {"c_name": True, "c_nationkey": False, "c_mktsegment": True}))
def metrics_sat_columns(spark, sf_dir):
    return metrics.satellite_profile(loads(spark, sf_dir, 3), ["c_name", "c_nationkey", "c_mktsegment"], datetime(2024, 2, 15))


@query("(SELECT 'documents' AS _master_table, * FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) UNION ALL (SELECT 'labels', * FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents))")
def compare_match_source(spark, sf_dir):
    """A configured match of two staged sources."""
    vault = Vault(spark, f"{shared_folder(spark)}/vault-{uuid4().hex}")
    for name in ("documents", "labels"):
        vault.registry.insert("source", config.SourceConfig(stage.Source(name, path=f"{sf_dir}/{name}.parquet"), {"doc": {"doc_id": "doc_id"}}))
    vault.registry.insert("match", config.MatchConfig("texts", ("stage", "documents"), ("stage", "labels"), (("doc_id", "doc_id"),)))
    return vault.compared("texts")


# Whole loads


def loaded_orders(spark, sf_dir, checked: bool = False) -> Vault:
    """Orders loaded twice into two hubs, a link and two satellites of it: first three of four, then all of them.

    checked: the tables are made empty before, and their keys are looked at afterwards.
    """
    vault = Vault(spark, f"{shared_folder(spark)}/vault-{uuid4().hex}")
    r = vault.registry
    r.insert("hub", config.HubConfig("orders", ("o_orderkey",), types={"o_orderkey": "bigint"}))
    r.insert("hub", config.HubConfig("customer", ("c_custkey",), types={"c_custkey": "bigint"}))
    r.insert("link", config.LinkConfig("order_customer", {"orders": "orders", "customer": "customer"}))
    price = {"o_totalprice": ColumnDef("price", "decimal", precision=14, scale=2)}
    r.insert("satellite", config.SatelliteConfig("order_price", "order_customer", "link", price, (("dear", "price > 100000"),), buckets=8))
    r.insert("satellite", config.SatelliteConfig("order_status", "order_customer", "link", {"o_orderstatus": ColumnDef("status", "varchar", length=1)}, buckets=8))
    for k, where in ((1, "o_orderkey % 4 <> 0"), (2, None)):
        source = stage.Source(f"orders_{k}", path=f"{sf_dir}/orders.parquet", columns=("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), row_filter=where, version=k)
        hubs = {"orders": {"o_orderkey": "o_orderkey"}, "customer": {"o_custkey": "c_custkey"}}
        r.insert("source", config.SourceConfig(source, hubs, "order_customer", ("order_price", "order_status")))
    for kind, name in (("hub", "orders"), ("hub", "customer"), ("link", "order_customer"), ("sat", "order_price"), ("sat", "order_status")) if checked else ():
        vault.create(kind, name)
    vault.load("orders_1", "Full", T1, run=1)
    vault.load("orders_2", "Full", T2, run=2)
    for kind, name in (("hub", "orders"), ("hub", "customer"), ("link", "order_customer"), ("sat", "order_price")) if checked else ():
        vault.check_unique(kind, name)
    return vault


@query("SELECT o_orderkey AS orders__o_orderkey, o_custkey AS customer__c_custkey, CAST(o_totalprice AS DECIMAL(14, 2)) AS price, CAST(o_totalprice AS DECIMAL(14, 2)) > 100000 AS dear, o_orderstatus AS status, CASE WHEN o_orderkey % 4 <> 0 THEN DATE '2024-01-01' ELSE DATE '2024-02-01' END AS dv_rowstartdate FROM orders")
def load_end_to_end(spark, sf_dir):
    """Two loads, read back by business key with both satellites of the link."""
    vault = loaded_orders(spark, sf_dir, checked=True)
    key = "l_order_customer_key"
    price, status = (vault.read_object("sat", n) for n in ("order_price", "order_status"))
    rows = vault.read_object("link", "order_customer").join(price.select(key, "price", "dear", START), key).join(status.select(key, "status"), key)
    return plain(rows.select("orders__o_orderkey", "customer__c_custkey", "price", "dear", "status", START))


@query("WITH l AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 4 <> 0) AS m, count(DISTINCT o_custkey) AS c, count(DISTINCT o_custkey) FILTER (o_orderkey % 4 <> 0) AS d FROM orders) SELECT run, kind, object, CAST(rows AS BIGINT) AS rows FROM (SELECT unnest([1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2]) AS run, unnest(['stage', 'stage', 'hub', 'hub', 'hub', 'hub', 'link', 'link', 'sat', 'sat', 'sat', 'sat']) AS kind, unnest(['orders_1', 'orders_2', 'h_orders', 'h_orders', 'h_customer', 'h_customer', 'l_order_customer', 'l_order_customer', 's_order_price', 's_order_price', 's_order_status', 's_order_status']) AS object, unnest([m, n, m, n - m, d, c - d, m, n - m, m, n - m, m, n - m]) AS rows FROM l)")
def load_task_states(spark, sf_dir):
    return loaded_orders(spark, sf_dir).states.read().select("run", "kind", "object", "rows")


# Staging and functions


@query("SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'D' ELSE 'U' END AS dv_cdc_action FROM events WHERE event_id % 5 IN (1, 2, 4)")
def cdc_operation_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5).alias("operation"))
    return stage.decode_operations(rows, "operation")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS dv_cdc_action, CASE WHEN event_type <> 'error' THEN value END AS value FROM events")
def cdc_nullify_deletes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "D").otherwise("U").alias("dv_cdc_action"), "value")
    return stage.nullify_deleted(rows, ["event_id"])


@query("SELECT o_orderkey, o_totalprice, 1 AS dv_source_version_key FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 100 AND o_orderkey <= 5000")
def stage_delta_extract(spark, sf_dir):
    source = stage.Source("orders", "SequenceCdc", path=f"{sf_dir}/orders.parquet", columns=("o_orderkey", "o_totalprice"), row_filter="o_orderstatus = 'F'", sequence="o_orderkey")
    return stage.stage(spark, source, "Delta", T1, 100, 5000).drop("dv_stage_date_time")


_STATES = "s AS (SELECT event_type AS source, user_id AS rows, CASE WHEN event_id % 3 <> 0 THEN event_id END AS mark, CASE WHEN event_type IN ('view', 'error') THEN 'stage' ELSE 'sat' END AS kind, event_id AS ended FROM events)"


def event_states(spark, sf_dir) -> DataFrame:
    """Events as states of loads: of some types stage loads, of the others satellite loads; some have no mark."""
    kind = F.when(F.col("event_type").isin("view", "error"), "stage").otherwise("sat")
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.col("event_type").alias("source"), F.concat(F.lit("o"), (F.col("user_id") % 5).cast("string")).alias("object"), kind.alias("kind"), F.lit(0).cast("long").alias("run"),
        F.col("user_id").alias("rows"), F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("mark"), F.col("ts").alias("started"), F.col("event_id").alias("ended"),
    )


@query(f"WITH {_STATES}, b AS (SELECT event_type AS source, min(event_id) AS mark FROM events WHERE event_type = 'click' AND event_id % 2 = 0 GROUP BY ALL), m AS (SELECT source, max_by(mark, ended) FILTER (kind = 'sat' AND mark IS NOT NULL) AS sat, max_by(mark, ended) FILTER (kind = 'stage' AND mark IS NOT NULL) AS stage FROM s GROUP BY source) SELECT source, coalesce(b.mark, sat, stage) AS mark FROM (SELECT source FROM m UNION SELECT 'none') LEFT JOIN b USING (source) LEFT JOIN m USING (source)")
def high_water_resolution(spark, sf_dir):
    """A source with staged rows, sources with loads only, and one with neither."""
    states = event_states(spark, sf_dir)
    batch = table(spark, sf_dir, "events").where("event_type = 'click' AND event_id % 2 = 0").select(F.col("event_type").alias("source"), F.col("event_id").alias("mark"))
    sources = states.select("source").distinct().union(spark.sql("SELECT 'none'"))
    return stage.high_water_marks(sources, batch, states)


@query(f"WITH {_STATES} SELECT source, kind, 'o' || (rows % 5) AS object, 'object ' || (rows % 5) AS name, max_by(CAST(rows AS BIGINT), ended) AS rows, max(ended) AS ended FROM s GROUP BY source, kind, rows % 5")
def load_state_current(spark, sf_dir):
    kinds = spark.sql("SELECT explode(array('sat', 'stage')) AS kind").crossJoin(spark.range(5))
    objects = kinds.select("kind", F.concat(F.lit("o"), F.col("id").cast("string")).alias("object"), F.concat(F.lit("object "), F.col("id").cast("string")).alias("name"))
    return state.current_states(event_states(spark, sf_dir), objects).select("source", "kind", "object", "name", "rows", "ended")


@query(_SAT + f"SELECT h_customer_key, 'U' AS dv_cdc_action, {_P} FROM {_AFTER2} WHERE dv_row_is_current")
def stage_date_cdc_full(spark, sf_dir):
    return _from_satellite(spark, sf_dir, "Full")


@query(_SAT + f"SELECT h_customer_key, CASE WHEN dv_is_tombstone THEN 'D' ELSE 'U' END AS dv_cdc_action, {_P} FROM {_AFTER2} WHERE dv_rowstartdate > DATE '2024-01-01' AND dv_rowstartdate <= DATE '2024-02-01'")
def stage_date_cdc_delta(spark, sf_dir):
    return _from_satellite(spark, sf_dir, "Delta")


def _from_satellite(spark, sf_dir, run_type: str) -> DataFrame:
    """What a stored satellite gives to a source that reads it by date."""
    path = f"{shared_folder(spark)}/satellite-{uuid4().hex}"
    loads(spark, sf_dir, 2).write.parquet(path)
    source = stage.Source("customers", "DateCdc", kind="satellite", path=path, columns=("h_customer_key", *CUSTOMER.payload))
    return stage.stage(spark, source, run_type, T3, T1, T2).drop("dv_stage_date_time", "dv_source_version_key")


@query("SELECT doc_id, CAST(i AS INT) AS item_number, parts[i] AS item FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), generate_series(1, len(parts)) AS g(i)")
def split_strings(spark, sf_dir):
    return scalar.split_strings(table(spark, sf_dir, "documents"), "text", "\n", ("doc_id",))


@query("SELECT o_orderkey, try_cast(substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) || ' ' || substr(t, 1, 2) || ':' || substr(t, 3, 2) || ':' || substr(t, 5, 2) || '.' || substr(t, 7, 2) AS TIMESTAMP) AS moment, CAST(o_orderkey AS VARCHAR) AS number FROM (SELECT o_orderkey, CAST(20240101 + o_orderkey % 28 AS VARCHAR) AS d, lpad(CAST(o_orderkey * 7919 % 25000000 AS VARCHAR), 8, '0') AS t FROM orders)")
def int_to_datetime(spark, sf_dir):
    k = F.col("o_orderkey")
    moment = scalar.int_to_datetime(F.lit(20240101) + k % 28, k * 7919 % 25000000)
    return table(spark, sf_dir, "orders").select(k, moment.cast("timestamp_ntz").alias("moment"), scalar.int_to_string(k).alias("number"))


@query("SELECT s_suppkey, ' ' || array_to_string(list_transform(string_split(lower(s_name), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS name FROM supplier")
def proper_case(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalar.proper_case(F.col("s_name")).alias("name"))


@query("SELECT o_orderkey, try_cast(substr(n, 1, 4) || '-' || substr(n, 5, 2) || '-' || substr(n, 7, 2) AS DATE) AS day FROM (SELECT o_orderkey, CAST(20240000 + (o_orderkey % 13) * 100 + o_orderkey % 32 AS VARCHAR) AS n FROM orders)")
def int_to_date(spark, sf_dir):
    value = 20240000 + (F.col("o_orderkey") % 13) * 100 + F.col("o_orderkey") % 32
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.int_to_date(value).alias("day"))


# Scheduling and logs


_NODES = "SELECT 'n' || n_nationkey AS task, 'n' || (n_nationkey // 2) AS predecessor FROM nation WHERE n_nationkey > 0"


def _edges(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").where(k > 0).select(F.concat(F.lit("n"), k.cast("string")).alias("task"), F.concat(F.lit("n"), F.floor(k / 2).cast("string")).alias("predecessor"))


@query(f"WITH RECURSIVE e AS ({_NODES} UNION ALL SELECT 'n1', 'n2'), r(a, b) AS (SELECT predecessor, task FROM e UNION SELECT a, task FROM r JOIN e ON predecessor = b) SELECT a AS task FROM r WHERE a = b")
def dag_cycle_check(spark, sf_dir):
    back = spark.sql("SELECT 'n1' AS task, 'n2' AS predecessor")
    return scheduler.cycles(_edges(spark, sf_dir).unionByName(back))


@query(f"WITH RECURSIVE e AS ({_NODES}), w(t, path) AS (SELECT DISTINCT predecessor, '[' || predecessor || ']' FROM e WHERE predecessor NOT IN (SELECT task FROM e) UNION ALL SELECT task, path || ' >>> [' || task || ']' FROM w JOIN e ON predecessor = t) SELECT path FROM w")
def dag_paths(spark, sf_dir):
    return scheduler.paths(_edges(spark, sf_dir))


_TASKS = "SELECT 'n' || n_nationkey AS task, CASE WHEN n_nationkey < 4 THEN 'Completed' WHEN n_nationkey = 4 THEN 'Processing' ELSE 'Scheduled' END AS status FROM nation"


@query(f"WITH e AS ({_NODES}), t AS ({_TASKS}) SELECT task FROM t WHERE status = 'Scheduled' AND task NOT IN (SELECT e.task FROM e JOIN t p ON p.task = predecessor WHERE p.status <> 'Completed')")
def dag_runnable_tasks(spark, sf_dir):
    k = F.col("n_nationkey")
    tasks = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), k.cast("string")).alias("task"), F.when(k < 4, "Completed").when(k == 4, "Processing").otherwise("Scheduled").alias("status"))
    return scheduler.runnable_tasks(tasks, _edges(spark, sf_dir))


@query("SELECT user_id || ' ' || CAST(ts AS DATE) || ' ' || date_part('hour', ts) AS run, CASE WHEN bool_or(event_type = 'error') THEN 'Failed' WHEN bool_or(event_type = 'signup') THEN 'Cancelled' WHEN bool_and(event_type = 'view') THEN 'Completed' ELSE 'Unknown' END AS status FROM events GROUP BY 1")
def run_status_rollup(spark, sf_dir):
    """Each hour of a user is a run, each event a task of it."""
    names = F.create_map(*(F.lit(x) for x in ("error", "Failed", "signup", "Cancelled", "view", "Completed")))
    run = F.concat_ws(" ", F.col("user_id").cast("string"), F.to_date("ts").cast("string"), F.hour("ts").cast("string"))
    tasks = table(spark, sf_dir, "events").select(run.alias("run"), F.coalesce(names[F.col("event_type")], F.lit("Processing")).alias("status"))
    return scheduler.run_status(tasks)


@query("SELECT user_id AS run, event_type AS task, max_by(CASE WHEN value > 50 THEN 'Completed' ELSE 'Failed' END, event_id) AS status, CAST(max_by(event_id % 100, event_id) AS BIGINT) AS seconds FROM events GROUP BY ALL")
def run_current_tasks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_type").alias("task"), F.lit("Full").alias("load_type"), F.lit(0).alias("priority"), F.lit("001").alias("queue"),
        F.when(F.col("value") > 50, "Completed").otherwise("Failed").alias("status"), F.col("ts").alias("started"),
        F.timestamp_add("SECOND", F.col("event_id") % 100, F.col("ts")).alias("ended"), F.lit("").alias("error"), F.col("ts").alias("created"), F.col("event_id").alias("noted"),
    )
    return scheduler.current_tasks(rows).select("run", "task", "status", "seconds")


@query("WITH t AS (SELECT user_id AS run, event_id AS task, ts AS started, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 6 HOUR END AS ended FROM events WHERE event_type = 'signup') SELECT t.run, t.task, e.event_id FROM t JOIN events e ON e.user_id = t.run AND e.event_type = 'error' AND e.ts >= t.started AND (e.ts <= t.ended OR t.ended IS NULL)")
def report_errors_within_tasks(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    ended = F.when(F.col("event_id") % 3 != 0, F.timestamp_add("HOUR", F.lit(6), F.col("ts")))
    tasks = rows.where("event_type = 'signup'").select(F.col("user_id").alias("run"), F.col("event_id").alias("task"), F.col("ts").alias("started"), ended.alias("ended"))
    level = F.when(F.col("event_type") == "error", 8).otherwise(2)
    journal = rows.select(F.col("user_id").alias("run"), F.col("ts").alias("at"), level.alias("severity"), F.col("event_id").cast("string").alias("message"))
    return scheduler.exceptions_within(tasks, journal).select("run", "task", F.col("message").cast("long").alias("event_id"))


@query("WITH f AS (SELECT user_id, CAST(rank() OVER (ORDER BY min(ts), user_id) % 2 AS INT) AS stripe FROM events GROUP BY user_id) SELECT event_id, stripe FROM events JOIN f USING (user_id)")
def report_striping(spark, sf_dir):
    return scheduler.striped(table(spark, sf_dir, "events"), "user_id", "ts").select("event_id", "stripe")


@query("SELECT event_id, CAST(CASE event_type WHEN 'error' THEN 8 ELSE 2 END AS INT) AS severity FROM events, (SELECT max(ts) AS now FROM events) WHERE ts >= now - CASE event_type WHEN 'error' THEN INTERVAL 5 DAY ELSE INTERVAL 2 DAY END")
def journal_cleanup(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    journal = rows.select("event_id", F.col("ts").alias("at"), F.when(F.col("event_type") == "error", 8).otherwise(2).alias("severity"))
    return state.kept(journal, rows.agg(F.max("ts")).first()[0], 2, 5).select("event_id", "severity")


@query("SELECT event_id FROM events, (SELECT max(ts) AS now FROM events) WHERE event_type = 'error' AND ts >= now - INTERVAL 1 DAY ORDER BY ts DESC LIMIT 100")
def journal_exceptions(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    journal = rows.select("event_id", F.col("ts").alias("at"), F.when(F.col("event_type") == "error", 8).otherwise(2).alias("severity"), F.col("event_type").alias("message"))
    return state.exceptions(journal, rows.agg(F.max("ts")).first()[0], days=1, limit=100).select("event_id")


@query("SELECT event_id, severity FROM (SELECT event_id, CAST(CASE event_type WHEN 'error' THEN 8 WHEN 'signup' THEN 4 WHEN 'view' THEN 2 ELSE 1 END AS INT) AS severity, event_type FROM events) WHERE severity & 12 = severity AND event_type LIKE '%r%' ORDER BY event_id DESC LIMIT 100")
def journal_severity_mask(spark, sf_dir):
    level = F.when(F.col("event_type") == "error", 8).when(F.col("event_type") == "signup", 4).when(F.col("event_type") == "view", 2).otherwise(1)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), level.alias("severity"), F.col("event_type").alias("message"))
    return state.search(rows, "r", "contains", 12, limit=100).select(F.col("at").alias("event_id"), "severity")


# Bespoke and external stages, stored tables and streams


@query("SELECT l_linenumber AS k, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY l_linenumber")
def stage_bespoke_reader(spark, sf_dir):
    """A source that is a function, by run type; its stage has the filter and the columns of its configuration."""
    reader = lambda s, run: table(s, sf_dir, "lineitem") if run == "Full" else table(s, sf_dir, "lineitem").limit(0)
    source = stage.Source("lines", kind="callable", reader=reader, columns=("l_linenumber",), row_filter="l_linenumber > 2", derived={"k": "l_linenumber"})
    return stage.stage(spark, source, "Full", T1).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1")
def stage_external(spark, sf_dir):
    """A stage that something else filled."""
    path = f"{shared_folder(spark)}/external-{uuid4().hex}"
    table(spark, sf_dir, "orders").where("o_orderkey % 2 = 1").write.parquet(path)
    source = stage.Source("orders", kind="external", path=path, columns=("o_orderkey", "o_orderstatus"))
    return stage.stage(spark, source, "Full", T1).drop("dv_stage_date_time", "dv_source_version_key")


@query(_REPLAY + "FROM r")
def sat_stream_replay(spark, sf_dir):
    """The changes of ``sat_cdc_replay`` as a stream, in one batch, into a stored satellite."""
    folder = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    changes = event_changes(spark, sf_dir)
    changes.write.parquet(f"{folder}/changes")
    target = user_table(spark, folder, changes)
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/changes")
    into_satellite(stream, USER, target, ["ts"], f"{folder}/checkpoint", "1", lambda: T1).awaitTermination()
    return _micro(target.read())


def user_table(spark, folder: str, changes: DataFrame) -> Table:
    """An empty stored satellite of users."""
    target = Table(spark, folder, "sat/s_user", ("user_id",), 8)
    target.commit(satellite.initial(USER, changes, T1, "").limit(0))
    return target


@query(_REPLAY + "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_us) AS BIGINT) AS n, dv_row_is_current, dv_is_tombstone, event_type, value FROM r")
def sat_two_streams(spark, sf_dir):
    """Users of even and of odd numbers as two streams of three batches each into one satellite; the last batch of one is delivered twice."""
    folder = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    changes, at = event_changes(spark, sf_dir), F.unix_micros(F.col("ts").cast("timestamp"))
    target = user_table(spark, folder, changes)
    bounds = [0, *changes.agg(F.percentile_approx(at, F.array(F.lit(1 / 3), F.lit(2 / 3)))).first()[0], 2**62]
    for odd in (0, 1):
        for low, high, day in zip(bounds, bounds[1:], (T1, T2, T3), strict=False):
            batch = changes.where((F.col("user_id") % 2 == odd) & (at > low) & (at <= high))
            batch.write.mode("append").parquet(f"{folder}/changes-{odd}")
            stream = spark.readStream.schema(changes.schema).parquet(f"{folder}/changes-{odd}")
            into_satellite(stream, USER, target, ["ts"], f"{folder}/checkpoint-{odd}", "1", lambda day=day: day).awaitTermination()
    load_batch(batch, stream_id(spark, f"{folder}/checkpoint-1"), 2, USER, target, ["ts"], "1", T3)
    order = Window.partitionBy("user_id").orderBy(START)
    return target.read().select("user_id", F.row_number().over(order).cast("long").alias("n"), IS_CURRENT, IS_TOMBSTONE, "event_type", "value")


@query("SELECT c_custkey, c_acctbal, c_custkey % 7 = 0 AS replaced FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 1, true FROM customer WHERE c_custkey % 7 = 0")
def table_current_buckets(spark, sf_dir):
    """Current rows of some keys are replaced by a run beside the base, which is merged when it is read."""
    target = Table(spark, f"{shared_folder(spark)}/table-{uuid4().hex}", "sat/s_customer", ("c_custkey",), 8, current="now")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(False).alias("replaced"), F.lit(True).alias("now"))
    target.commit(rows)
    target.commit(rows.where("c_custkey % 7 = 0").withColumns({"c_acctbal": F.col("c_acctbal") + 1, "replaced": F.lit(True)}))
    return target.read().drop("now")


def customer_vault(spark, sf_dir) -> Vault:
    """Customers loaded three times in full, as ``loads`` has them; after the second the satellite is folded."""
    vault = Vault(spark, f"{shared_folder(spark)}/vault-{uuid4().hex}")
    r = vault.registry
    r.insert("hub", config.HubConfig("customer", ("c_custkey",)))
    kinds = {"c_name": "varchar", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "varchar"}
    columns = {c: ColumnDef(c, t, length=-1 if t == "varchar" else None) for c, t in kinds.items()}
    r.insert("satellite", config.SatelliteConfig("customer", "customer", "hub", columns, buckets=8))
    for n, at in enumerate((T1, T2, T3), 1):
        reader = lambda s, run, n=n: customer_rows(s, sf_dir, 2 if n == 2 else 1, table(s, sf_dir, "customer").select("c_custkey", F.lit(0).alias("h_customer_key"))).drop("h_customer_key")
        r.insert("source", config.SourceConfig(stage.Source(f"customer_{n}", kind="callable", reader=reader, version=n), {"customer": {"c_custkey": "c_custkey"}}, satellites=("customer",)))
        vault.load(f"customer_{n}", "Full", at, run=n)
        if n == 2:
            vault.table("sat", "customer").compact(history=False)
    return vault


@query(_SAT + f"FROM {_AFTER3}")
def sat_merge_on_read(spark, sf_dir):
    """The stored satellite after three loads: a base that was folded, a run beside it, and what ended."""
    return plain(customer_vault(spark, sf_dir).table("sat", "customer").read())


@query(_SAT + f"SELECT h_customer_key, 'D' AS dv_cdc_action, {_P}, true AS first FROM tomb UNION ALL SELECT h_customer_key, 'U', {_P}, true FROM two UNION ALL SELECT h_customer_key, 'U', {_P}, false FROM h WHERE h_customer_key IN (FROM ch) OR h_customer_key IN (FROM gone)")
def stage_vault_delta(spark, sf_dir):
    """What a vault's satellite gives to a next layer: net changes from its first version to its second, and from there to its last."""
    sat = customer_vault(spark, sf_dir).table("sat", "customer")
    one, two, *_, last = sat.versions()
    rows = [stage.vault_rows(sat, "Delta", a, b).withColumn("first", F.lit(a is one)) for a, b in ((one, two), (two, last))]
    return rows[0].unionByName(rows[1]).select("h_customer_key", "dv_cdc_action", *CUSTOMER.payload, "first")


@query(_SAT + "SELECT c_custkey, c_acctbal, c_mktsegment, h_customer_key IN (FROM ch) OR h_customer_key IN (FROM gone) AS changed FROM h")
def load_next_layer(spark, sf_dir):
    """A satellite that is fed from another one, by its versions: each delta takes what has changed since the last one."""
    vault = customer_vault(spark, sf_dir)
    r, first, second, *_ = vault.registry, *vault.table("sat", "customer").versions()
    r.insert("hub", config.HubConfig("account", ("h_customer_key",)))
    columns = {"c_acctbal": ColumnDef("c_acctbal", "float"), "c_mktsegment": ColumnDef("c_mktsegment", "varchar", length=-1)}
    r.insert("satellite", config.SatelliteConfig("account", "account", "hub", columns, buckets=8))
    source = stage.Source("accounts", "DateCdc", kind="satellite", satellite="customer", columns=("h_customer_key", "c_acctbal", "c_mktsegment"))
    r.insert("source", config.SourceConfig(source, {"account": {"h_customer_key": "h_customer_key"}}, satellites=("account",)))
    vault.load("accounts", "Full", T1, until=first.number)
    vault.load("accounts", "Delta", T2, until=second.number)
    vault.load("accounts", "Delta", T3)
    found = vault.read_object("sat", "account").join(vault.table("hub", "account").read().select("h_account_key", "h_customer_key"), "h_account_key")
    keys = vault.table("hub", "customer").read().select("h_customer_key", "c_custkey")
    return found.join(keys, "h_customer_key").select("c_custkey", "c_acctbal", "c_mktsegment", (F.col(START) >= F.lit(T3).cast("timestamp_ntz")).alias("changed"))


@query("WITH e AS (SELECT *, lpad(printf('%X', event_id * 40503 + 255), 20, '0') AS lsn FROM events) SELECT lsn, lpad(printf('%X', event_id * 40503 + 256), 20, '0') AS next_lsn, event_id, CASE WHEN event_id % 5 = 1 THEN 'D' ELSE 'U' END AS dv_cdc_action, CASE WHEN event_id <= (SELECT max(event_id) // 2 FROM events) THEN 1 ELSE 2 END AS batch FROM e WHERE event_id % 5 IN (1, 2, 4)")
def stage_binary_lsn(spark, sf_dir):
    """Changes in the order of binary sequence numbers, staged by two loads; the second goes on where the first has ended."""
    folder = f"{shared_folder(spark)}/vault-{uuid4().hex}"
    vault, rows = Vault(spark, folder), table(spark, sf_dir, "events")
    lsn = F.unhex(F.lpad(F.hex(F.col("event_id") * 40503 + 255), 20, "0"))
    changes = rows.select("event_id", "user_id", "event_type", (F.col("event_id") % 5).alias("operation"), lsn.alias("lsn"))
    half = rows.agg(F.max("event_id")).first()[0] // 2
    r = vault.registry
    r.insert("hub", config.HubConfig("event", ("event_id",)))
    r.insert("satellite", config.SatelliteConfig("event", "event", "hub", {"event_type": ColumnDef("event_type", "varchar", length=-1)}, buckets=8))
    source = stage.Source("changes", "SequenceCdc", path=f"{folder}/changes", operation="operation", sequence="lsn", columns=("event_id", "event_type"))
    r.insert("source", config.SourceConfig(source, {"event": {"event_id": "event_id"}}, satellites=("event",)))
    found = []
    for k, own in enumerate((changes.where(F.col("event_id") <= half), changes.where(F.col("event_id") > half)), 1):
        own.write.mode("append").parquet(f"{folder}/changes")
        vault.load("changes", "Delta", (T1, T2)[k - 1], run=k)
        found.append(vault.table("stage", "changes").read().withColumn("batch", F.lit(k)))
    return found[0].unionByName(found[1]).select(F.hex("lsn").alias("lsn"), F.hex(marks.next_lsn(F.col("lsn"))).alias("next_lsn"), "event_id", "dv_cdc_action", "batch")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_totalprice AS DECIMAL(16, 2)) AS o_totalprice, CASE WHEN o_orderkey % 2 = 1 THEN CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE 'none' END END AS o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus FROM orders")
def stage_typed_versions(spark, sf_dir):
    """Two versions of a source: the second widens key and price, adds a column with a default and retires one. Both batches are read by the later columns."""
    vault = Vault(spark, f"{shared_folder(spark)}/vault-{uuid4().hex}")
    r, orders = vault.registry, table(spark, sf_dir, "orders")
    status = ColumnDef("o_orderstatus", "varchar", length=1)
    one = (ColumnDef("o_orderkey", "int"), ColumnDef("o_totalprice", "decimal", precision=12, scale=2), status)
    two = (ColumnDef("o_orderkey", "bigint", nullable=False), ColumnDef("o_totalprice", "decimal", precision=16, scale=2), ColumnDef("o_orderpriority", "varchar", length=-1, default="'none'"), replace(status, retired=True))
    later = orders.where("o_orderkey % 2 = 1").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
    feeds = iter((orders.where("o_orderkey % 2 = 0"), later))
    r.insert("hub", config.HubConfig("orders", ("o_orderkey",)))
    r.insert("source", config.SourceConfig(stage.Source("orders", kind="callable", reader=lambda s, run: next(feeds)), {"orders": {"o_orderkey": "o_orderkey"}}))
    staged = vault.table("stage", "orders")
    for columns, at in ((one, T1), (two, T2)):
        r.declare("orders", columns, rerun=True)
        vault.load("orders", "Full", at)
    first, last = staged.versions()
    rows = [staged.read(v, schema=last.schema) for v in (first, last)]
    return rows[0].unionByName(rows[1]).select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey > 100 AND c_nationkey < 20")
def stage_jdbc_parts(spark, sf_dir):
    """Customers in an embedded relational database, read from there after a mark, in four parts."""
    spark._jvm.System.setProperty("derby.stream.error.file", "/dev/null")
    options = {"url": f"jdbc:derby:memory:{uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    table(spark, sf_dir, "customer").write.format("jdbc").options(**options, dbtable="customer").save()
    source = stage.Source("customer", "SequenceCdc", path="customer", format="jdbc", options=options | {"parts": "4"}, sequence="c_custkey", columns=("c_custkey", "c_name", "c_acctbal"), row_filter="c_nationkey < 20")
    return stage.stage(spark, source, "Delta", T1, after=100).drop("dv_stage_date_time", "dv_source_version_key")


# Joins in time


def user_states(spark, sf_dir) -> DataFrame:
    """A satellite of users whose versions begin with sign-ups and purchases, and end in tombstones with errors."""
    rows = table(spark, sf_dir, "events").where("event_type IN ('signup', 'purchase', 'error')")
    until = F.coalesce(F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts")), F.lit(naming.HIGH_DATE).cast("timestamp_ntz"))
    gone = F.col("event_type") == "error"
    return rows.select("user_id", gone.alias(IS_TOMBSTONE), F.col("ts").alias(START), F.when(gone, F.col("ts")).otherwise(until).alias(END), F.when(~gone, F.col("event_id")).alias("state_id"))


_STATE = "s AS (SELECT user_id, ts, event_type = 'error' AS gone, event_id AS state_id FROM events WHERE event_type IN ('signup', 'purchase', 'error'))"


@query(f"WITH {_STATE} SELECT e.event_id, CASE WHEN NOT s.gone THEN s.state_id END AS state_id FROM events e ASOF LEFT JOIN s ON s.user_id = e.user_id AND s.ts <= e.ts")
def asof_events_satellite(spark, sf_dir):
    """Every event with the version of its user that was valid then."""
    facts = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return temporal.as_of(facts, user_states(spark, sf_dir), ["user_id"], "ts", {"state_id": "state_id"}).select("event_id", "state_id")


@query(f"WITH {_STATE} SELECT e.event_id, s.state_id FROM events e ASOF JOIN s ON s.user_id = e.user_id AND s.ts <= e.ts WHERE NOT s.gone")
def asof_events_hot_users(spark, sf_dir):
    """The same without events for which nothing was valid, and with every user split by time, as a hot key is."""
    facts = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return temporal.as_of(facts, user_states(spark, sf_dir), ["user_id"], "ts", {"state_id": "state_id"}, "inner", hot_rows=10).select("event_id", "state_id")


@query("WITH t AS (SELECT event_id AS task, ts AS started, CASE WHEN event_id % 97 <> 0 THEN ts + INTERVAL 1 HOUR END AS ended FROM events WHERE event_type = 'signup') SELECT t.task, e.event_id FROM t JOIN events e ON e.event_type = 'error' AND e.ts >= t.started AND (e.ts <= t.ended OR t.ended IS NULL)")
def report_errors_by_time(spark, sf_dir):
    """Errors with all tasks that ran then, without a run that both belong to."""
    rows = table(spark, sf_dir, "events")
    ended = F.when(F.col("event_id") % 97 != 0, F.timestamp_add("HOUR", F.lit(1), F.col("ts")))
    tasks = rows.where("event_type = 'signup'").select(F.col("event_id").alias("task"), F.col("ts").alias("started"), ended.alias("ended"))
    journal = rows.select(F.col("ts").alias("at"), F.when(F.col("event_type") == "error", 8).otherwise(2).alias("severity"), F.col("event_id").alias("message"))
    return scheduler.errors_by_time(tasks, journal).select("task", F.col("message").alias("event_id"))


_SPANS = "SELECT event_id AS {n}, ts AS {n}_from, ts + INTERVAL 1 MINUTE * (event_id % 50) AS {n}_to FROM events WHERE event_type = '{t}'"


@query(f"SELECT a, b FROM ({_SPANS.format(n='a', t='purchase')}) JOIN ({_SPANS.format(n='b', t='error')}) ON a_from <= b_to AND b_from <= a_to")
def interval_overlaps(spark, sf_dir):
    """Pairs of a purchase and an error whose times overlap."""
    rows = table(spark, sf_dir, "events")
    to = F.timestamp_add("MINUTE", (F.col("event_id") % 50).cast("int"), F.col("ts"))
    sides = [rows.where(F.col("event_type") == t).select(F.col("event_id").alias(n), F.col("ts").alias(f"{n}_from"), to.alias(f"{n}_to")) for n, t in (("a", "purchase"), ("b", "error"))]
    return intervals.overlapping(*sides, ("a_from", "a_to"), ("b_from", "b_to")).select("a", "b")


_PROFILED = {"l_orderkey": False, "l_partkey": False, "l_linenumber": False, "l_returnflag": True, "l_linestatus": True}


@query(f"SELECT * EXCLUDE (domain) FROM ({_profile_sql('lineitem', _PROFILED)})")
def metrics_columns_by_load(spark, sf_dir):
    """Line items that arrive in three loads: each is profiled by itself, and the profile of all comes from the three rows."""
    columns, rows = list(_PROFILED), table(spark, sf_dir, "lineitem")
    parts = Table(spark, f"{shared_folder(spark)}/profile-{uuid4().hex}", "profile/lineitem")
    for k in range(3):
        parts.commit(metrics.profile_part(rows.where(F.col("l_orderkey") % 3 == k), columns))
    return metrics.merged_profile(parts.read(), columns).drop("domain")


@query("SELECT * EXCLUDE (domain) FROM (" + _profile_sql("(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey % 4 = 0, o_orderkey) AS h_orders_key FROM orders)", {"h_orders_key": False, "o_orderkey": False}) + ")")
def metrics_hub_by_load(spark, sf_dir):
    """The profile of a hub after two loads: the second call reads what the second load has added."""
    vault, columns = loaded_orders(spark, sf_dir), ["h_orders_key", "o_orderkey"]
    table_, parts = vault.table("hub", "orders"), Table(spark, vault.root, "profile/h_orders")
    first = table_.versions()[0]
    parts.commit(metrics.profile_part(table_.read(first), columns), note={"upto": first.number, "columns": columns})
    return vault.profile("hub", "orders", columns).drop("domain")


# Names, days and texts by column


@query("SELECT CAST(d AS DATE) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS pit_date FROM (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events), generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY) AS g(d)")
def day_ends_of_events(spark, sf_dir):
    """The ends of all days from the first event to the last."""
    first, last = table(spark, sf_dir, "events").agg(F.min("ts"), F.max("ts")).first()
    return temporal.day_ends(spark, first.date(), last.date())


@query("SELECT o_orderkey, o_orderkey % 7 = isodow(o_orderdate) % 7 AS profiled FROM orders")
def metrics_profiled_days(spark, sf_dir):
    """On which of their days objects would be profiled by a weekly run."""
    return table(spark, sf_dir, "orders").select("o_orderkey", metrics.profiled_on(F.col("o_orderkey"), F.to_date("o_orderdate")).alias("profiled"))


@query("""WITH m AS (SELECT event_id, event_id * 7919 % 20000000 AS ms FROM events), s AS (SELECT event_id, ms, ms // 1000 // 3600 AS h, ms // 1000 // 60 % 60 AS m, ms // 1000 % 60 AS s FROM m),
w AS (SELECT *, CASE WHEN h > 0 THEN h || ' hr' || CASE WHEN h <> 1 THEN 's' ELSE '' END END AS hw, CASE WHEN m > 0 THEN m || ' min' || CASE WHEN m <> 1 THEN 's' ELSE '' END END AS mw, s || ' sec' || CASE WHEN s <> 1 THEN 's' ELSE '' END AS sw FROM s)
SELECT event_id, CASE WHEN ms < 1000 THEN ms || ' milliseconds' WHEN h = 0 AND m = 0 THEN sw ELSE concat_ws(', ', hw, mw) || ' and ' || sw END AS elapsed FROM w""")
def elapsed_of_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.elapsed(F.col("event_id") * 7919 % 20_000_000).alias("elapsed"))


@query("SELECT p_partkey, chr(CAST(97 + p_partkey // 17576 % 26 AS INT)) || chr(CAST(97 + p_partkey // 676 % 26 AS INT)) || chr(CAST(97 + p_partkey // 26 % 26 AS INT)) || chr(CAST(97 + p_partkey % 26 AS INT)) AS abbreviation FROM part WHERE p_partkey < 456976")
def abbreviations_of_parts(spark, sf_dir):
    found = table(spark, sf_dir, "part").select("p_partkey", naming.abbreviation(F.col("p_partkey")).alias("abbreviation"))
    return found.where("abbreviation IS NOT NULL")


# Configuration, releases and runs whose rows come from tables


def rows_of(spark, sf_dir, name: str, *columns: str) -> list:
    """Rows of a small table (suppliers, nations) as they configure something: configuration lives on the driver."""
    return table(spark, sf_dir, name).select(*columns).orderBy(columns[0]).collect()


@query("SELECT s_suppkey AS number, CASE WHEN s_suppkey % 7 = 0 THEN 'no hub' WHEN s_suppkey % 5 = 0 THEN 'two hubs' ELSE 'ok' END AS found FROM supplier")
def config_checks(spark, sf_dir):
    """A source for each supplier, checked: some feed a hub that isn't there, some two hubs without a link."""
    r, out = config.Registry(), []
    for name in ("supplier", "nation"):
        r.insert("hub", config.HubConfig(name, ("key",)))
    for (k,) in rows_of(spark, sf_dir, "supplier", "s_suppkey"):
        hubs = {"nobody": {"a": "key"}} if k % 7 == 0 else {"supplier": {"a": "key"}} | ({"nation": {"b": "key"}} if k % 5 == 0 else {})
        r.insert("source", config.SourceConfig(stage.Source(f"s{k}", path="x"), hubs))
        try:
            r.check(f"s{k}")
            out.append((k, "ok"))
        except config.ConfigError as e:
            out.append((k, "two hubs" if "exactly one hub" in str(e) else "no hub"))
    return spark.createDataFrame(out, "number long, found string")


@query("SELECT 's' || s_suppkey AS source, 'Full' AS load_type, 'table' AS kind, 'p' || s_nationkey AS path FROM supplier WHERE s_suppkey % 3 <> 0")
def config_stages(spark, sf_dir):
    """The stages in use, of a source for each supplier; versions of every third one are out of use."""
    r = config.Registry()
    for k, n in rows_of(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"):
        r.insert("source", config.SourceConfig(stage.Source(f"s{k}", path=f"p{n}"), {"h": {"a": "b"}}))
        r.insert("version", config.VersionConfig(f"s{k}_1", f"s{k}", 1, active=k % 3 != 0))
    return spark.createDataFrame(r.stages(), "source string, load_type string, kind string, path string")


@query("SELECT 'm' || s_suppkey AS match, 'stage' AS left_kind, 'a' || s_nationkey AS left_object, 'k' || i AS left_column, 'sat' AS right_kind, 'b' || s_suppkey AS right_object, 'v' || i AS right_column FROM supplier, generate_series(0, s_suppkey % 3) AS g(i)")
def config_matches(spark, sf_dir):
    """Compared columns of a match for each supplier, of one to three columns."""
    r = config.Registry()
    for k, n in rows_of(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"):
        r.insert("match", config.MatchConfig(f"m{k}", ("stage", f"a{n}"), ("sat", f"b{k}"), tuple((f"k{i}", f"v{i}") for i in range(k % 3 + 1))))
    return spark.createDataFrame(r.matches())


@query("SELECT CASE WHEN s_suppkey % 4 = 1 THEN 6 ELSE s_nationkey % 5 + 1 END AS release, 'h' || s_suppkey AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'changed' ELSE 'key' END AS key FROM supplier WHERE s_suppkey % 6 <> 2")
def release_round_trip_of_rows(spark, sf_dir):
    """A hub for each supplier in a release of its nation's; some are changed, moved or deleted. Every release is written, read and applied elsewhere."""
    path, r, other = f"{shared_folder(spark)}/release-{uuid4().hex}", config.Registry(), config.Registry()
    for number in range(1, 7):
        r.add_release(number)
    for k, n in rows_of(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"):
        r.insert("hub", config.HubConfig(f"h{k}", ("key",), n % 5 + 1))
        if k % 6 == 2:
            r.delete("hub", f"h{k}")
        elif k % 4 == 0:
            r.update("hub", f"h{k}", keys=("changed",))
        elif k % 4 == 1:
            r.move("hub", f"h{k}", 6)
    for number in sorted({h.release for h in r.rows["hub"].values()}):
        release.export(spark, r, number, f"{path}/{number}")
        release.apply(other, release.load(spark, f"{path}/{number}"))
    found = [(h.release, h.name, h.keys[0]) for h in other.rows["hub"].values()]
    return spark.createDataFrame(found, "release int, name string, key string")


@query("WITH c AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'dv_' ELSE '' END || lower(replace(n_name, ' ', '_')) AS name, n_nationkey % 3 = 0 AS retired FROM nation) SELECT name, retired, CAST(CASE WHEN retired THEN -1 ELSE row_number() OVER (PARTITION BY retired ORDER BY NOT starts_with(name, 'dv_'), name) END AS BIGINT) AS place, 'aaaa' AS abbreviation FROM c")
def config_recreated_satellite(spark, sf_dir):
    """A satellite with a column for each nation, made anew when every third one has left its stage."""
    names = [("dv_" if k % 5 == 0 else "") + n.lower().replace(" ", "_") for k, n in rows_of(spark, sf_dir, "nation", "n_nationkey", "n_name")]
    columns = [ColumnDef(n, "int") for n in names]
    r = config.Registry()
    r.insert("satellite", config.SatelliteConfig("s", "h", "hub", config.satellite_columns(columns)))
    again = r.recreate_satellite("s", [c for k, c in enumerate(columns) if k % 3])
    found = [(n, c.retired, -1 if c.retired else place, again.abbreviation) for place, (n, c) in enumerate(again.columns.items(), 1)]
    return spark.createDataFrame(found, "name string, retired boolean, place long, abbreviation string")


def schedule_of(spark, sf_dir, name: str, key: str) -> scheduler.Schedules:
    """A task for each row of a small table, which waits for the one of half its number; edges that would close a circle are refused as they are added."""
    schedules = scheduler.Schedules()
    schedules.insert(scheduler.Schedule("Nightly", {}))
    keys = [k for (k,) in rows_of(spark, sf_dir, name, key)]
    for k in keys:
        schedules.add_member("Nightly", scheduler.Task(f"n{k}"))
    for k in keys[1:]:
        schedules.add_edge("Nightly", f"n{k}", f"n{k // 2}")
    return schedules


@query(f"WITH RECURSIVE e AS ({_NODES}), w(t, path) AS (SELECT DISTINCT predecessor, '[' || predecessor || ']' FROM e WHERE predecessor NOT IN (SELECT task FROM e) UNION ALL SELECT task, path || ' >>> [' || task || ']' FROM w JOIN e ON predecessor = t) SELECT path FROM w")
def dag_schedule_paths(spark, sf_dir):
    """Paths of a schedule that was put together task by task."""
    return scheduler.paths(schedule_of(spark, sf_dir, "nation", "n_nationkey").edges(spark, "nightly"))


@query("SELECT 'n' || r_regionkey AS task, 'Completed' AS status, CASE WHEN r_regionkey IN (3, 4) THEN 2 ELSE 1 END AS times, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS loaded, true AS in_order FROM region")
def run_schedule(spark, sf_dir):
    """A run of a task for each region, each a Spark job; two fail at first, the run goes on from its log and is restarted."""
    log = state.Log(spark, f"{shared_folder(spark)}/runs-{uuid4().hex}", scheduler.RUN_SCHEMA)
    schedules, done = schedule_of(spark, sf_dir, "region", "r_regionkey"), []
    run = scheduler.Run.of(schedules.current(), "nightly")
    run.number, run.log = 1, log

    def load(task):
        nations = table(spark, sf_dir, "nation").where(F.concat(F.lit("n"), F.col("n_regionkey").cast("string")) == task.name).count()
        done.append((task.name, nations))
        if task.name in ("n3", "n4") and done.count(done[-1]) == 1:
            raise RuntimeError("the first try")

    try:
        run.process(load)
    except scheduler.RunFailed:
        run = scheduler.Run.resumed(log, 1)
        run.restart()
        run.process(load)
    last = {n: i for i, (n, _) in enumerate(done)}
    before = dict(schedules.rows["Nightly"].edges)
    rows = [(n, sum(x == n for x, _ in done), loaded, n not in before or last[before[n]] < done.index((n, loaded))) for n, loaded in dict(done).items()]
    times = spark.createDataFrame(rows, "task string, times int, loaded long, in_order boolean")
    return scheduler.current_tasks(log.read()).select("task", "status").join(times, "task")


# Loads that fail, and their times and marks


@query("SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS dv_source_date_time, DATE '2024-01-01' AS dv_rowstartdate FROM orders")
def load_source_times(spark, sf_dir):
    """A satellite whose source times are a column of its source."""
    vault = Vault(spark, f"{shared_folder(spark)}/vault-{uuid4().hex}")
    r = vault.registry
    r.insert("hub", config.HubConfig("orders", ("o_orderkey",)))
    r.insert("satellite", config.SatelliteConfig("orders", "orders", "hub", {"o_orderstatus": ColumnDef("status", "varchar", length=1)}, buckets=8))
    r.insert("source", config.SourceConfig(stage.Source("orders", path=f"{sf_dir}/orders.parquet"), {"orders": {"o_orderkey": "o_orderkey"}}, satellites=("orders",), source_date="o_orderdate"))
    vault.load("orders", "Full", T1)
    found = vault.read_object("sat", "orders").join(vault.table("hub", "orders").read().select("h_orders_key", "o_orderkey"), "h_orders_key")
    return plain(found.select("o_orderkey", SOURCE_TIME, START), drop=())


@query("SELECT 1 AS run, 'error' AS level, CAST((SELECT sum(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1)) AS BIGINT) AS duplicates UNION ALL SELECT 2, 'success', NULL")
def journal_of_loads(spark, sf_dir):
    """A load that fails on duplicate keys, and one that doesn't: how both ended is in the journal."""
    vault = Vault(spark, f"{shared_folder(spark)}/vault-{uuid4().hex}")
    r = vault.registry
    r.insert("hub", config.HubConfig("user", ("user_id",)))
    r.insert("satellite", config.SatelliteConfig("user", "user", "hub", {"event_type": ColumnDef("event_type", "varchar", length=-1)}, buckets=8))
    latest = lambda s, run: table(s, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))
    for name, reader in (("all", lambda s, run: table(s, sf_dir, "events")), ("last", latest)):
        r.insert("source", config.SourceConfig(stage.Source(name, kind="callable", reader=reader), {"user": {"user_id": "user_id"}}, satellites=("user",)))
    try:
        vault.load("all", "Full", T1, run=1)
    except duplicates.DuplicateKeys:
        vault.load("last", "Full", T2, run=2)
    levels = F.when(F.col("severity") == state.severity("error"), "error").otherwise("success")
    number = F.regexp_extract("message", r"(\d+) rows", 1)
    return vault.journal.log.read().select(F.col("run").cast("int").alias("run"), levels.alias("level"), F.when(number != "", number).cast("long").alias("duplicates"))


@query("WITH m AS (SELECT max(o_orderkey) // 2 AS half, max(o_orderkey) AS whole FROM orders) SELECT run, kind, CAST(mark AS VARCHAR) AS mark, CAST((SELECT count(*) FROM orders WHERE o_orderkey > low AND o_orderkey <= high) AS BIGINT) AS rows FROM (SELECT 1 AS run, half AS mark, -1 AS low, half AS high FROM m UNION ALL SELECT 2, whole, half, whole FROM m), (VALUES ('stage'), ('hub')) AS k(kind)")
def load_marks(spark, sf_dir):
    """Two deltas of orders in the order of their keys: the second begins where the first was told to end."""
    vault = Vault(spark, f"{shared_folder(spark)}/vault-{uuid4().hex}")
    r = vault.registry
    r.insert("hub", config.HubConfig("orders", ("o_orderkey",)))
    source = stage.Source("orders", "SequenceCdc", path=f"{sf_dir}/orders.parquet", sequence="o_orderkey", columns=("o_orderkey",))
    r.insert("source", config.SourceConfig(source, {"orders": {"o_orderkey": "o_orderkey"}}))
    vault.load("orders", "Delta", T1, run=1, until=table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] // 2)
    vault.load("orders", "Delta", T2, run=2)
    return vault.states.read().select(F.col("run").cast("int").alias("run"), "kind", "mark", "rows")
