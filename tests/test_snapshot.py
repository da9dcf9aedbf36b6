import datetime
import shutil

import pytest
from pyspark.sql import functions as F

from tablekeeper.errors import KeeperError
from tablekeeper.operators import digest_index as index
from tablekeeper.operators import retention
from tablekeeper.operators import snapshot as sn
from tablekeeper.sources import event_log, files
from tablekeeper.sources import tables as st

T0 = datetime.datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, data):
    return spark.createDataFrame(data, "a int, b string")


def test_differential_and_incremental(spark, tmp_path):
    root = str(tmp_path / "snap")
    states = [[(1, "x"), (1, "x"), (2, None)], [(1, "x"), (2, None), (2, None), (3, "y")], [(3, "y"), (3, "y")], []]
    modes = ["differential", "differential", "incremental", "incremental"]
    ids = [sn.snapshot(spark, frame(spark, s), "t", root, T0 + datetime.timedelta(hours=i), m)
           for i, (s, m) in enumerate(zip(states, modes))]
    runs = {r.run_id: r for r in sn.catalog_of(spark, root, "t").collect()}
    assert [runs[i].backup_type for i in ids] == ["full", "differential", "incremental", "incremental"]
    assert [runs[i].chain for i in ids] == [[], ids[:1], ids[:2], ids[:3]]
    assert runs[ids[0]].artifact_path.endswith(f"20240101T000000_{ids[0]}")
    for run, state in zip(ids, states):
        assert rows(sn.contents(spark, root, "t", run)) == sorted(state, key=repr) or not state
    target = str(tmp_path / "target")
    frame(spark, [(9, "old")]).write.parquet(target)
    sn.restore(spark, root, "t", ids[1], target, like=frame(spark, []))
    assert spark.read.parquet(target).count() == 4
    with pytest.raises(KeeperError, match="does not match"):
        sn.restore(spark, root, "t", ids[1], target, like=spark.range(1))
    with pytest.raises(KeeperError, match="no snapshot"):
        sn.contents(spark, root, "t", "nope")
    result = sn.verify_latest(spark, root, "t", str(tmp_path / "check")).first()
    assert (result.run_id, result.row_count, result.status) == (ids[3], 0, "verified")
    with pytest.raises(KeeperError):
        sn.verify_latest(spark, root, "t", f"{root}/data/x")
    with pytest.raises(KeeperError):
        sn.verify_latest(spark, root, "nothing", str(tmp_path / "check2"))


def test_changed_columns_need_a_full_snapshot(spark, tmp_path):
    root = str(tmp_path / "snap")
    sn.snapshot(spark, frame(spark, [(1, "x")]), "t", root, T0)
    with pytest.raises(KeeperError, match="columns"):
        sn.snapshot(spark, spark.range(2), "t", root, T0, "incremental")
    with pytest.raises(KeeperError):
        sn.snapshot(spark, spark.range(2), "t", root, T0, "weekly")


def test_restore_selected(spark, tmp_path):
    root, target = str(tmp_path / "snap"), str(tmp_path / "out")
    for name, n in (("a", 1), ("a", 2), ("b", 3)):
        sn.snapshot(spark, spark.range(n), name, root, T0 + datetime.timedelta(minutes=n))
    assert sn.restore_selected(spark, root, target, ["a"]) == ["a"]
    assert spark.read.parquet(f"{target}/a").count() == 2
    assert sn.restore_selected(spark, root, target) == ["a", "b"]
    with pytest.raises(KeeperError):
        sn.restore_selected(spark, root, target, ["a", "zzz"])


def test_select_names():
    assert sn.select_names(["users", " ", "orders "]) == ["users", "orders"]
    assert sn.select_names(collections=["users", "appdb.audit"], database="appdb") == ["appdb.users", "appdb.audit"]
    assert sn.select_names([], [" "]) is None
    with pytest.raises(KeeperError):
        sn.select_names(["a"], ["b"])


def test_copies_beyond_one_row(spark, monkeypatch):
    monkeypatch.setattr(sn, "COPIES_PER_ROW", 10)
    df = spark.createDataFrame([(1, 1), (2, 35), (3, 10), (4, 11)], "a int, _change long")
    got = sn.expand_copies(df).groupBy("a").count().collect()
    assert {r.a: r["count"] for r in got} == {1: 1, 2: 35, 3: 10, 4: 11}


def test_fingerprint_ignores_order_and_sees_changes(spark):
    one, two = frame(spark, [(1, "x"), (2, None)]), frame(spark, [(2, None), (1, "x")]).repartition(3)
    assert sn.same_contents(one, two).first().same
    assert not sn.same_contents(one, frame(spark, [(1, "x"), (2, "")])).first().same
    assert sn.fingerprint(frame(spark, [])).first().checksum == "0"


def test_keyed_changes(spark):
    old, new = frame(spark, [(1, "x"), (2, None), (3, "y")]), frame(spark, [(2, None), (3, "z"), (4, "n")])
    assert rows(sn.keyed_changes(old, new, ["a"])) == [(1, "removed"), (3, "changed"), (4, "added")]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "table")
    assert files.current(spark, root) is None
    files.publish(spark.range(3), root)
    # a table rebuilt from itself
    files.publish(files.current(spark, root).filter("id > 0"), root)
    assert rows(files.current(spark, root)) == [(1,), (2,)]
    assert files.complete_versions(spark, root) == [1, 2]


def test_compression_setting():
    assert st.compression_for() == "gzip" and st.compression_for(False) == "none"
    assert st.compression_for(True, "none") == "gzip" and st.compression_for(True, disabled=True) == "none"
    assert st.compression_for(None, "none") == "none"


def test_pruned_base_keeps_later_snapshots(spark, tmp_path):
    root, log = str(tmp_path / "snap"), str(tmp_path / "log")
    states = [[(1, "x")], [(1, "x"), (2, "y")], [(2, "y"), (3, "z")], [(4, "w")]]
    modes = ["full", "incremental", "incremental", "full"]
    ids = [sn.snapshot(spark, frame(spark, s), "t", root, T0 + datetime.timedelta(hours=i), m)
           for i, (s, m) in enumerate(zip(states, modes))]

    def keep(n):
        catalog = sn.catalog_of(spark, root)
        policies = retention.resolve_policies(catalog.select("profile").distinct(), [{"profile": "t", "keep_last": n}])
        plan = retention.deletion_plan(catalog, policies, ["profile"], 0)
        return {r.run_id for r in sn.prune(spark, root, plan, log, "00:00:00 2024-02-01").collect()}

    assert keep(2) == set(ids[2:])
    assert rows(sn.contents(spark, root, "t", ids[2])) == states[2]
    with pytest.raises(KeeperError, match="no snapshot"):
        sn.contents(spark, root, "t", ids[1])
    assert len(list((tmp_path / "snap" / "data" / "t").iterdir())) == 4
    assert keep(2) == set(ids[2:])  # nothing more to do
    assert keep(1) == {ids[3]}
    assert [p.name[-12:] for p in (tmp_path / "snap" / "data" / "t").iterdir()] == [ids[3]]
    assert rows(sn.contents(spark, root, "t", ids[3])) == states[3]
    assert event_log.scan_events(spark, log).count() == 3


def numbers(spark, n, changed=()):
    value = F.when(F.col("id").isin(list(changed)), -1).otherwise(F.col("id") * 7)
    return spark.range(n).select("id", value.cast("long").alias("v"))


def test_untouched_rows_pass_without_exchange(spark, tmp_path):
    root = str(tmp_path / "snap")
    sn.snapshot(spark, numbers(spark, 20_000), "t", root, T0)
    run = sn.snapshot(spark, numbers(spark, 20_000, range(50)), "t", root, T0, "incremental")
    found = sn._find(spark, root, "t", run)
    same, touched = index.apply_deltas(*sn._read_parts(spark, root, "t", found, sn._schema(found)))
    assert "Exchange" not in same._jdf.queryExecution().executedPlan().toString()
    assert touched.count() < 20_000 * 0.1 and same.count() > 20_000 * 0.9
    assert rows(sn.contents(spark, root, "t", run)) == rows(numbers(spark, 20_000, range(50)))
    assert sn.stored_changes(spark, root, "t", run).agg(F.sum(F.abs("_change"))).first()[0] == 100


def test_comparison_reads_differing_buckets_only(spark, tmp_path):
    root = str(tmp_path / "snap")
    ids = [sn.snapshot(spark, numbers(spark, 3000, c), "t", root, T0 + datetime.timedelta(hours=i), "incremental",
                       buckets=64) for i, c in enumerate(((), (5,), (5,), ()))]
    changed, buckets = sn.changes_between(spark, root, "t", ids[0], ids[1])
    assert rows(changed) == [(5, -1, 1), (5, 35, -1)] and 1 <= len(buckets) <= 2
    assert "PartitionFilters: [isnotnull(__bucket" in changed._jdf.queryExecution().toString() or "__bucket" in (
        changed._jdf.queryExecution().toString())
    assert sn.changes_between(spark, root, "t", ids[1], ids[2])[1] == []
    assert sn.changes_between(spark, root, "t", ids[0], ids[3])[1] == []  # there and back
    changed, buckets = sn.changes_since(spark, root, "t", ids[3], numbers(spark, 3000, (5, 6)))
    assert changed.count() == 4 and len(buckets) <= 4
    with pytest.raises(KeeperError, match="columns"):
        sn.changes_since(spark, root, "t", ids[3], spark.range(3))


@pytest.mark.parametrize("buckets", [1, 8, 20, 64])
def test_trees(spark, buckets):
    left = index.with_digest(numbers(spark, 500), buckets)
    right = index.with_digest(numbers(spark, 500, (3, 77)), buckets)
    trees = [index.tree_of(index.leaves(df), buckets) for df in (left, right)]
    want = {r["__bucket"] for df in (left, right) for r in df.where("id IN (3, 77)").collect()}
    assert set(index.differing_buckets(*trees, buckets)) == want
    assert index.differing_buckets(trees[0], trees[0], buckets) == []
    assert index.root_of(trees[0])[0] == 500 and index.root_of({}) == (0, 0, 0)
    assert index.read_tree(index.tree_rows(spark, trees[0])) == trees[0]
    empty = index.tree_of(index.leaves(left.where("false")), buckets)
    assert len(index.differing_buckets(trees[0], empty, buckets)) == left.select("__bucket").distinct().count()


def test_digests_tell_nulls_apart(spark):
    schema = "a string, b string, c array<string>, d struct<x: int, y: int>"
    data = [(None, "x", None, None), ("x", None, None, None), (None, None, ["x", None], None),
            (None, None, [None, "x"], None), (None, None, None, (1, None)), (None, None, None, (None, 1)),
            (None, None, None, (None, None)), (None, None, [], None)]
    df = index.with_digest(spark.createDataFrame(data, schema))
    assert df.select(*index.DIGEST).distinct().count() == len(data)


def test_a_row_of_very_many_copies(spark, tmp_path):
    """Most rows are one row; its copies change, others stay."""
    root = str(tmp_path / "snap")

    def version(copies):
        return spark.range(copies).select(F.lit(1).alias("a")).unionAll(spark.range(2, 9).select(F.col("id").cast("int")))

    ids = [sn.snapshot(spark, version(n), "t", root, T0 + datetime.timedelta(hours=i), "incremental")
           for i, n in enumerate((5000, 3000, 0, 10))]
    for run, n in zip(ids, (5000, 3000, 0, 10)):
        got = {r.a: r["count"] for r in sn.contents(spark, root, "t", run).groupBy("a").count().collect()}
        assert got == {**{a: 1 for a in range(2, 9)}, **({1: n} if n else {})}


def test_verification(spark, tmp_path):
    root, log = str(tmp_path / "snap"), str(tmp_path / "log")
    run = sn.snapshot(spark, numbers(spark, 100), "t", root, T0)
    places = {"check": str(tmp_path / "check"), "other": str(tmp_path / "other")}
    settings = {"t": ("table", "check"), "check": ("table", None), "other": ("table", None), "x": ("files", None)}
    got = sn.verify_profile(spark, root, "t", settings, places, log=log).first()
    assert (got.target_profile, got.status, got.run_id, got.row_count) == ("check", "verified", run, 100)
    assert got.profiles == ["t", "check"] and got.duration_ms >= 0 and got.started_at <= got.finished_at
    got = sn.verify_profile(spark, root, "t", settings, places, "other", numbers(spark, 100, (4,)), log).first()
    assert (got.target_profile, got.status, got.comparison_status) == ("other", "failed", "differs")
    assert 1 <= got.buckets_differing <= 2
    events = [r.event for r in event_log.scan_events(spark, log).collect()]
    assert sorted(events) == ["verification.completed", "verification.failed"] + ["verification.started"] * 2
    for source, explicit, match in (("t", "t", "another"), ("t", "x", "one type"), ("other", None, "no verification"),
                                    ("t", "nope", "unknown")):
        with pytest.raises(KeeperError, match=match):
            sn.verification_target(settings, source, explicit)


def test_lost_data_is_logged_and_raised(spark, tmp_path):
    root, log = str(tmp_path / "snap"), str(tmp_path / "log")
    run = sn.snapshot(spark, numbers(spark, 10), "t", root, T0)
    shutil.rmtree(sn._find(spark, root, "t", run)["artifact_path"])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sn.verify_latest(spark, root, "t", str(tmp_path / "check"), log=log)
    events = [r.event for r in event_log.scan_events(spark, log).collect()]
    assert sorted(events) == ["verification.failed", "verification.started"]


@pytest.mark.parametrize("copies", [1, 4000])
def test_many_changes_move_whole_rows_once(spark, tmp_path, monkeypatch, copies):
    """Where most rows change, a bitmap would keep none back; rows of very many copies, NULLs and -0.0 come exactly."""
    monkeypatch.setattr(index, "ROWS_PER_TASK", 1000)
    monkeypatch.setattr(index, "share_held", lambda count: 1.0)
    monkeypatch.setattr(index, "_touch", lambda digests: pytest.fail("a bitmap that keeps nothing back"))

    def version(moved):
        value = F.when(F.col("id") % 3 > 0, F.col("id") + moved).cast("double")
        own = spark.range(6000).select("id", F.when(F.col("id") == 6, -0.0).otherwise(value).alias("v"))
        again = spark.range(copies - moved).select(F.lit(-1).cast("long").alias("id"), F.lit(1.5).alias("v"))
        return own.unionAll(again)

    root = str(tmp_path / "snap")
    sn.snapshot(spark, version(0), "t", root, T0)
    run = sn.snapshot(spark, version(1), "t", root, T0 + datetime.timedelta(hours=1), "differential")
    want = sn.difference(version(0), version(1))
    assert want.count() == 8001
    assert sorted(rows(sn.stored_changes(spark, root, "t", run)), key=repr) == sorted(rows(want), key=repr)
    found = sn._find(spark, root, "t", run)
    new = sn.counted(index.with_digest(version(1)))
    old = sn.counted(index.with_digest(version(0)))
    plan = index.changes(old, new)._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.split("\n") if "Exchange" in line]
    assert len([line for line in exchanged if "passthrough" in line]) == 1
    assert int(found["metadata"]["row_count"]) == version(1).count()
    monkeypatch.undo()
    signs = sn.contents(spark, root, "t", run).where("id = 6").select(F.col("v").cast("string")).first()
    assert signs[0] == "-0.0"
