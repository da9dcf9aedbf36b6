"""Queries that take, restore, verify and compare table snapshots."""

import datetime

from pyspark.sql import functions as F

from tablekeeper.operators import retention
from tablekeeper.operators import snapshot as sn
from tablekeeper.plans.fixtures import load
from tablekeeper.plans.registry import query
from tablekeeper.session import work_dir
from tablekeeper.sources import event_log
from tablekeeper.sources import tables as st

START = datetime.datetime(2024, 1, 1, 12)
COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


SHOWN = "* REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate)"


def _shown(df):
    """Times without a zone as text, to compare with other engines."""
    return df.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


def _versions(spark, folder):
    """Orders as loaded, then with rows changed and removed, then with rows repeated."""
    orders = load(spark, folder, "orders").select(*COLUMNS.split(", "))
    price = F.col("o_totalprice") + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    second = orders.filter(F.col("o_orderstatus") != "P").withColumn("o_totalprice", price)
    third = second.unionAll(second.filter(F.col("o_orderpriority") == "5-LOW"))
    return orders, second, third


VERSIONS = f"""
first_v AS (SELECT {COLUMNS} FROM orders),
second_v AS (SELECT * REPLACE (o_totalprice + CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END
  AS o_totalprice) FROM first_v WHERE o_orderstatus <> 'P'),
third_v AS (SELECT * FROM second_v UNION ALL
  SELECT * FROM second_v WHERE o_orderpriority = '5-LOW')"""


def _history(spark, folder):
    """A folder with a full, a differential and an incremental snapshot of the orders."""
    root = work_dir(spark, "snapshots")
    modes = ["differential", "differential", "incremental"]
    ids = [
        sn.snapshot(spark, df, "orders", root, START + datetime.timedelta(hours=i), mode)
        for i, (df, mode) in enumerate(zip(_versions(spark, folder), modes))
    ]
    return root, ids


@query("table_snapshot_full", f"WITH {VERSIONS} SELECT {SHOWN} FROM first_v")
def table_snapshot_full(spark, folder):
    root = work_dir(spark, "snapshots")
    orders = st.read_table(spark, f"{folder}/orders.parquet").select(*COLUMNS.split(", "))
    run = sn.snapshot(spark, orders, "orders", root, START)
    return _shown(sn.contents(spark, root, "orders", run))


ITEMS = "lineitem"
ITEM_TIMES = "* REPLACE (CAST(l_shipdate AS VARCHAR) AS l_shipdate)"
MARKED = "* REPLACE (CASE WHEN l_discount > 0.05 THEN 'X' ELSE l_linestatus END AS l_linestatus)"


def _marked(items):
    line = F.when(F.col("l_discount") > 0.05, "X").otherwise(F.col("l_linestatus"))
    return items.withColumn("l_linestatus", line)


@query("table_snapshot_delta", f"""SELECT * EXCLUDE (n), CAST(sum(n) AS BIGINT) AS _change FROM (
  SELECT {ITEM_TIMES}, 1 AS n FROM (SELECT {MARKED} FROM lineitem)
  UNION ALL SELECT {ITEM_TIMES}, -1 FROM lineitem)
GROUP BY ALL HAVING sum(n) <> 0""")
def table_snapshot_delta(spark, folder):
    """What a differential snapshot of the whole lineitem table stores after its full one."""
    root, items = work_dir(spark, "snapshots"), load(spark, folder, ITEMS)
    sn.snapshot(spark, items, ITEMS, root, START)
    run = sn.snapshot(spark, _marked(items), ITEMS, root, START + datetime.timedelta(hours=1), "differential")
    stored = sn.stored_changes(spark, root, ITEMS, run)
    return stored.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


# One order in a hundred changes its price, and one in 250 goes.
FEW = """few AS (SELECT * REPLACE (CASE WHEN o_orderkey % 100 = 7 THEN o_totalprice + 1 ELSE o_totalprice END
  AS o_totalprice) FROM first_v WHERE o_orderkey % 250 <> 3)"""


def _few(orders):
    key = F.col("o_orderkey")
    price = F.when(key % 100 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return orders.filter(key % 250 != 3).withColumn("o_totalprice", price)


def _few_history(spark, folder):
    root = work_dir(spark, "snapshots")
    orders, _, _ = _versions(spark, folder)
    ids = [sn.snapshot(spark, df, "orders", root, START + datetime.timedelta(hours=i), "incremental")
           for i, df in enumerate((orders, _few(orders), _few(orders)))]
    return root, ids, orders


@query("table_restore_small_delta", f"WITH {VERSIONS}, {FEW} SELECT {SHOWN} FROM few")
def table_restore_small_delta(spark, folder):
    """Full snapshot, small change, no change: the newest restored."""
    root, ids, _ = _few_history(spark, folder)
    target = work_dir(spark, "restored")
    sn.restore(spark, root, "orders", ids[-1], target)
    return _shown(st.read_table(spark, target))


@query("table_compare_snapshots", f"""WITH {VERSIONS}, {FEW},
moved AS (SELECT * EXCLUDE (n), CAST(sum(n) AS BIGINT) AS _change FROM (
  SELECT {SHOWN}, 1 AS n FROM few UNION ALL SELECT {SHOWN}, -1 FROM first_v) GROUP BY ALL HAVING sum(n) <> 0)
SELECT *, CAST(0 AS BIGINT) AS buckets_read_again FROM moved""")
def table_compare_snapshots(spark, folder):
    """Rows by which the first and the second snapshot differ; the second and the third read no bucket."""
    root, ids, _ = _few_history(spark, folder)
    changed, _ = sn.changes_between(spark, root, "orders", ids[0], ids[1])
    _, again = sn.changes_between(spark, root, "orders", ids[1], ids[2])
    return _shown(changed).withColumn("buckets_read_again", F.lit(len(again)).cast("bigint"))


@query("table_source_drift", f"""WITH {VERSIONS}, {FEW}
SELECT * EXCLUDE (n), CAST(sum(n) AS BIGINT) AS _change FROM (
  SELECT {SHOWN}, 1 AS n FROM first_v UNION ALL SELECT {SHOWN}, -1 FROM few) GROUP BY ALL HAVING sum(n) <> 0""")
def table_source_drift(spark, folder):
    """Rows by which the live table differs from its newest snapshot."""
    root, ids, orders = _few_history(spark, folder)
    changed, _ = sn.changes_since(spark, root, "orders", ids[-1], orders)
    return _shown(changed)


@query("table_restore_chain", f"WITH {VERSIONS} SELECT {SHOWN} FROM third_v")
def table_restore_chain(spark, folder):
    root, ids = _history(spark, folder)
    target = work_dir(spark, "restored")
    orders, _, _ = _versions(spark, folder)
    sn.restore(spark, root, "orders", ids[-1], target, like=orders)
    return _shown(st.read_table(spark, target))


@query("table_restore_after_pruning", f"""WITH {VERSIONS}
SELECT {SHOWN}, CAST(2 AS BIGINT) AS snapshots, CAST(1 AS BIGINT) AS logged FROM third_v""")
def table_restore_after_pruning(spark, folder):
    """The full snapshot goes, and the newest one is restored all the same."""
    root, ids = _history(spark, folder)
    log, target = work_dir(spark, "log"), work_dir(spark, "restored")
    catalog = sn.catalog_of(spark, root)
    policies = retention.resolve_policies(
        catalog.select("profile").distinct(), [{"profile": "orders", "keep_last": 2}])
    plan = retention.deletion_plan(catalog, policies, ["profile"], 0)
    left = sn.prune(spark, root, plan, log, "00:00:00 2024-01-31").count()
    sn.restore(spark, root, "orders", ids[-1], target)
    logged = event_log.scan_events(spark, log).filter("event = 'retention.deleted'").count()
    return _shown(st.read_table(spark, target)).select(
        "*", F.lit(left).cast("bigint").alias("snapshots"), F.lit(logged).cast("bigint").alias("logged"))


@query("table_restore_selected", """SELECT 'nation' AS restored, count(*) AS n FROM nation
UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def table_restore_selected(spark, folder):
    root, target = work_dir(spark, "snapshots"), work_dir(spark, "restored")
    for name in ("nation", "supplier", "customer"):
        sn.snapshot(spark, load(spark, folder, name), name, root, START)
    names = sn.select_names([" nation", "", "supplier "])
    restored = sn.restore_selected(spark, root, target, names)
    parts = [
        spark.read.parquet(f"{target}/{name}").select(F.lit(name).alias("restored"))
        for name in restored
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    return rows.groupBy("restored").agg(F.count(F.lit(1)).alias("n"))


SETTINGS = {"orders": ("table", "orders-check"), "orders-check": ("table", None), "spare": ("table", None)}
RESULT = ["profile", "target_profile", "db_type", "backup_type", "row_count", "buckets_checked", "buckets_differing",
          "restore_status", "comparison_status", "status"]


@query("table_verify_latest", f"""WITH {VERSIONS}
SELECT 'orders' AS profile, 'orders-check' AS target_profile, 'table' AS db_type, 'incremental' AS backup_type,
  count(*) AS row_count, 32 AS buckets_checked, 0 AS buckets_differing, 'completed' AS restore_status,
  'same' AS comparison_status, 'verified' AS status,
  'verification.started,verification.completed' AS events FROM third_v""")
def table_verify_latest(spark, folder):
    """The newest snapshot restored in the configured target and compared with the live table."""
    root, _ = _history(spark, folder)
    _, _, third = _versions(spark, folder)
    log = work_dir(spark, "log")
    result = sn.verify_profile(
        spark, root, "orders", SETTINGS, {"orders-check": work_dir(spark, "verified")}, table_now=third, log=log)
    return _with_events(spark, result, log)


def _with_events(spark, result, log):
    events = event_log.scan_events(spark, log).agg(F.array_join(F.sort_array(F.collect_list("event"), asc=False), ",").alias("events"))
    return result.select(*RESULT, events.scalar().alias("events"))


@query("table_verify_differing", f"""WITH {VERSIONS}
SELECT 'orders' AS profile, 'spare' AS target_profile, 'table' AS db_type, 'incremental' AS backup_type,
  count(*) AS row_count, 32 AS buckets_checked, (SELECT count(*) > 0 FROM first_v WHERE o_orderkey % 100 = 7)
  AS differs, 'completed' AS restore_status, 'differs' AS comparison_status, 'failed' AS status,
  'verification.started,verification.failed' AS events FROM third_v""")
def table_verify_differing(spark, folder):
    """The live table has moved on since; the target is named and goes before the configured one."""
    root, _ = _history(spark, folder)
    _, _, third = _versions(spark, folder)
    log = work_dir(spark, "log")
    result = sn.verify_profile(
        spark, root, "orders", SETTINGS, {"spare": work_dir(spark, "verified")}, "spare", _few(third), log)
    return _with_events(spark, result, log).withColumn("differs", F.col("buckets_differing") > 0).drop(
        "buckets_differing")


@query("table_compare_rows", f"""WITH {VERSIONS}
SELECT {SHOWN}, CAST(1 AS BIGINT) AS _change FROM (SELECT * FROM third_v EXCEPT ALL SELECT * FROM first_v)
UNION ALL
SELECT {SHOWN}, CAST(-1 AS BIGINT) FROM (SELECT * FROM first_v EXCEPT ALL SELECT * FROM third_v)""")
def table_compare_rows(spark, folder):
    first, _, third = _versions(spark, folder)
    change = sn.difference(first, third)
    more = sn.expand_copies(change.filter("_change > 0")).withColumn("_change", F.lit(1))
    less = change.filter("_change < 0").withColumn("_change", -F.col("_change"))
    less = sn.expand_copies(less).withColumn("_change", F.lit(-1))
    return _shown(more.unionByName(less)).withColumn("_change", F.col("_change").cast("bigint"))


@query("table_compare_keys", f"""WITH {VERSIONS}
SELECT o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS kind
FROM first_v o LEFT JOIN second_v n USING (o_orderkey)
WHERE n.o_orderkey IS NULL OR n.o_totalprice <> o.o_totalprice""")
def table_compare_keys(spark, folder):
    first, second, _ = _versions(spark, folder)
    return sn.keyed_changes(first, second, ["o_orderkey"])


@query("table_same_contents", f"""WITH {VERSIONS}
SELECT (SELECT count(*) FROM first_v) AS left_rows, (SELECT count(*) FROM second_v) AS right_rows,
  false AS same""")
def table_same_contents(spark, folder):
    first, second, _ = _versions(spark, folder)
    return sn.same_contents(first, second)


@query("table_compressed_sink", f"""SELECT 'gzip' AS codec, {SHOWN} FROM (SELECT {COLUMNS} FROM orders)
UNION ALL SELECT 'none', {SHOWN} FROM (SELECT {COLUMNS} FROM orders)""")
def table_compressed_sink(spark, folder):
    """All written values, read back with the codec of their files."""
    orders = load(spark, folder, "orders").select(*COLUMNS.split(", "))
    parts = []
    for codec in (st.compression_for(), st.compression_for(disabled=True)):
        path = work_dir(spark, "lines")
        st.write_lines(orders, path, codec)
        parts.append(spark.read.schema(orders.schema).json(path).select(st.file_codec().alias("codec"), "*"))
    return _shown(parts[0].unionAll(parts[1]))
