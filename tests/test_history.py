import json

import pytest
from pyspark.sql import functions as F

from tablekeeper.errors import KeeperError
from tablekeeper.functions.timestamps import format_clock, parse_timestamp
from tablekeeper.operators import history, notify
from tablekeeper.sources import catalogue, event_log


def test_timestamps(spark):
    texts = ["18:31:38 2026-03-15", "2026-03-15T18:31:38Z", "2026-03-15T19:31:38+01:00",
             " 2026-03-15 18:31:38.75 ", "18:31:38", "2026", "nonsense", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.c for r in df.select(format_clock(parse_timestamp(F.col("t"))).alias("c")).collect()]
    assert got == ["18:31:38 2026-03-15"] * 4 + [None] * 5


def log(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    return event_log.parse_lines(df)


def event(name, at, **payload):
    return json.dumps({"timestamp": at, "event": name, "payload": payload}, sort_keys=True)


T1, T2 = "10:00:00 2024-01-01", "10:00:01 2024-01-01"
LINES = [
    event("backup.completed", T1, profile="a", duration_ms=1250),
    "",
    "   ",
    "{cut",
    event("backup.failed", T2, profile="b", error="boom"),
    event("verification.completed", T2, profile="a", profiles=["a", "b"], target_profile="b"),
    "[1, 2]",
    event("retention.deleted", "not a time", profile="a"),
    event("backup.started", T2, profile="a"),
]


def test_log_lines(spark):
    events = log(spark, LINES)
    assert [r.line_no for r in events.orderBy("line_no").collect()] == [0, 4, 5, 7, 8]
    recent = [r.line_no for r in history.recent_events(events).collect()]
    assert recent == [4, 5, 8, 0, 7]  # ties keep file order, unreadable times come last
    assert [r.line_no for r in history.recent_events(events, 2).collect()] == [4, 5]
    assert {r.line_no for r in history.events_of_profile(events, "b").collect()} == {4, 5}
    by = history.events_by_profile(events).filter("for_profile = 'a'")
    assert {r.line_no for r in by.collect()} == {0, 5, 7, 8}


def test_latest_event_looks_only_so_deep(spark):
    events = log(spark, LINES)
    found = history.latest_outcome(events, "backup.completed", "backup.failed")
    assert {(r.for_profile, r.status) for r in found.collect()} == {("a", "ok"), ("b", "error")}
    shallow = history.latest_outcome(events, "backup.completed", "backup.failed", depth=2)
    assert {(r.for_profile, r.status) for r in shallow.collect()} == {("b", "error")}


def test_append_and_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    event_log.append_events(log(spark, LINES).select("timestamp", "event", "payload").coalesce(1), path)
    back = event_log.scan_events(spark, path)
    assert [r.event for r in back.orderBy("line_no").collect()] == [
        r.event for r in log(spark, LINES).orderBy("line_no").collect()]
    line = spark.read.text(path).filter(F.col("value").contains("boom")).first().value
    assert list(json.loads(line)) == ["event", "payload", "timestamp"]


def test_duration_text(spark):
    values = [0, 1, 999, 999.9] + list(range(1000, 9000, 50)) + [10**7 + 50, 123456789]
    df = spark.createDataFrame([(float(v),) for v in values], "ms double")
    got = [r.t for r in df.select(history.duration_text(F.col("ms")).alias("t")).collect()]
    assert got == [f"{v / 1000:.1f}s" if v >= 1000 else f"{int(v)}ms" for v in values]


SUMMARIES = [
    ("backup.started", {"db_type": "pg", "compression": "gzip"}, "pg / gzip"),
    ("backup.started", {}, "starting"),
    ("backup.completed", {"duration_ms": 1500, "retention_deleted_count": 3}, "1.5s, pruned 3"),
    ("backup.completed", {"retention_deleted_count": 0}, "ok"),
    ("backup.failed", {"error": ""}, "failed"),
    ("restore.started", {"restore_selection": ["a"], "restore_selection_kind": "table"}, "1 table"),
    ("restore.started", {"restore_selection": []}, "full restore"),
    ("verification.started", {}, "target: n/a"),
    ("verification.completed", {"target_profile": "t"}, "verified via t"),
    ("scheduled_cycle.completed", {"verification_status": "v"}, "verification: v"),
    ("scheduled_cycle.completed", {}, "ok"),
    ("retention.deleted", {"profile": "p"}, "deleted 1 run(s)"),
    ("notification.sent", {"channel": "slack", "event": "e"}, "slack: e"),
    ("notification.sent", {}, "n/a"),
    ("something.else", {}, ""),
]


@pytest.mark.parametrize("name, payload, want", SUMMARIES)
def test_activity_summary(spark, name, payload, want):
    assert history.activity(log(spark, [event(name, T1, **payload)])).first().summary == want


def test_category_and_status(spark):
    names = ["backup.started", "a.b.c", "plain", "x.completed"]
    rows = history.activity(log(spark, [event(n, T1) for n in names])).orderBy("line_no").collect()
    assert [(r.category, r.status) for r in rows] == [
        ("backup", "started"), ("a", "other"), ("", "other"), ("x", "completed")]
    assert history.activity_counts(log(spark, LINES)).first().label == "5 events"
    assert history.activity_counts(log(spark, LINES), "backup").first().label == "3 of 5 events"


def test_notification(spark):
    lines = [event("backup.failed", T1, profile="a", error="e" * 401), event("backup.completed", T1, profile="a"),
             event("backup.started", T1, profile="a"), event("restore.failed", T1, profile="b", run_id="r")]
    own = spark.createDataFrame([("a", ["backup.failed"])], "profile string, events array<string>")
    got = {r.line_no: r.message for r in notify.outbox(log(spark, lines), own).collect()}
    assert got == {
        0: "[tablekeeper] Backup failed\nProfile: a\nError: " + "e" * 397 + "...",
        3: "[tablekeeper] Restore failed\nProfile: b\nRun ID: r",
    }


def test_run_folders(spark, tmp_path):
    def put(profile, run, text):
        folder = tmp_path / profile / run
        folder.mkdir(parents=True)
        (folder / "manifest.json").write_text(text)

    def manifest(run, at):
        return json.dumps({"run_id": run, "finished_at": at, "source": {"x": "y"}, "chain": ["q"]}, indent=2)

    put("p", "r1", manifest("r1", "10:00:00 2024-01-01"))
    put("p", "r2", manifest("r2", "2024-01-02T10:00:00Z"))
    put("p", "r3", manifest("r3", "never"))
    put("p", "r4", "{cut")
    put("p", "r5", json.dumps({"run_id": "r5"}))
    put("q", "r6", manifest("r6", "10:00:00 2024-01-01"))
    rows = catalogue.scan_run_folders(spark, str(tmp_path))
    assert {(r.profile, r.run_id) for r in rows.collect()} == {("p", "r1"), ("p", "r2"), ("q", "r6")}
    assert {r.run_id for r in catalogue.scan_run_folders(spark, str(tmp_path), ["p"]).collect()} == {"r1", "r2"}
    assert rows.filter("run_id = 'r1'").first().run_dir.endswith("/p/r1")
    assert history.latest_run(rows, "p").first().run_id == "r2"
    assert catalogue.find_run(rows, rows.filter("run_id = 'r6'").first().run_dir + "/").first().run_id == "r6"
    with pytest.raises(KeeperError):
        history.latest_run(rows, "nobody")
    listed = history.backup_history(rows).collect()
    assert listed[0].run_id == "r2" and len(history.backup_history(rows, limit=1).collect()) == 1

    assert history.backup_history(rows).columns == history.HISTORY_COLUMNS
    with pytest.raises(KeeperError, match="duration_ms"):
        history.backup_history(rows.drop("duration_ms"))


def test_check_findings(spark):
    profiles = spark.createDataFrame([("a",), ("b",), ("b",)], "profile string")
    lost = spark.createDataFrame([("a", "x"), ("a", "y"), ("z", "x"), (None, "x")], "profile string, hash string")
    rows = history.check_findings(profiles, {"blocks": (lost, "error"), "old": (lost.limit(0), "warning")})
    assert {(r["check"], r.profile): (r.status, r.findings) for r in rows.collect()} == {
        ("blocks", "a"): ("error", 2), ("blocks", "b"): ("ok", 0), ("old", "a"): ("ok", 0), ("old", "b"): ("ok", 0)}
    assert {r.profile: (r.status, r.checks) for r in history.worst_status(rows).collect()} == {
        "a": ("error", 2), "b": ("ok", 2)}
    with pytest.raises(KeeperError):
        history.check_findings(profiles, {"blocks": (lost, "fatal")})


def test_worst_status(spark):
    checks = spark.createDataFrame(
        [("a", "ok"), ("a", "warning"), ("b", "error"), ("b", "warning"), ("c", "ok")],
        "profile string, status string")
    assert {(r.profile, r.status) for r in history.worst_status(checks).collect()} == {
        ("a", "warning"), ("b", "error"), ("c", "ok")}


def test_payloads_as_variants(spark, tmp_path):
    """Any field by its path, also those that no list of fields knows; odd payloads are NULL."""
    path = str(tmp_path / "events")
    assert event_log.stored_events(spark, path).count() == 0
    lines = ['{"event": "a", "payload": {"x": {"y": [1, "two"]}, "n": 7}, "timestamp": "10:00:00 2024-01-01"}',
             '{"event": "b", "payload": "text", "timestamp": null}', '{"event": "c"}', "not json", ""]
    events = event_log.parse_lines(spark.createDataFrame([(v,) for v in lines], "value string"))
    event_log.store_events(events, path)
    kept = event_log.stored_events(spark, path)
    field = lambda p, kind="string": event_log.payload_field(kept, p, kind)
    got = kept.select("event", field("$.x.y[1]").alias("y"), field("$.n", "int").alias("n"), field("$.x.y[1]", "int").alias("bad"),
                      F.unix_millis("at").alias("at"))
    assert sorted(map(tuple, got.collect()), key=repr) == [
        ("a", "two", 7, None, 1704103200000), ("b", None, None, None, None), ("c", None, None, None, None)]
    assert "event" not in kept.select(field("$.n"))._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
