import pytest
from pyspark.sql import functions as F

from tablekeeper.operators import alerts, audit, fleet, ingest, keyed

HOUR = alerts.HOUR_MS


def raw(spark, **fields):
    row = dict(server_id="s", server_name="S", run_id="r", profile="p", db_type="sqlite", backup_type="full",
               status="success", size_bytes="1", duration_ms="2", started_at=None, finished_at="now", error=None)
    row.update(fields)
    schema = ", ".join(f"{name} string" for name in row)
    return spark.createDataFrame([tuple(row.values())], schema)


def test_defaults(spark):
    row = ingest.normalise(raw(spark, server_name=None, run_id="", backup_type=None, size_bytes="many",
                               duration_ms=" 12 ", finished_at=None)).first()
    assert (row.server_name, row.run_id, row.backup_type) == ("s", "s:p:None", "full")
    assert (row.size_bytes, row.duration_ms) == (None, 12)
    assert ingest.normalise(raw(spark, server_id=None), "host").first().server_id == "host"


def test_numbers_lose_their_fraction(spark):
    df = raw(spark).withColumn("size_bytes", F.lit(12.7)).withColumn("duration_ms", F.lit(-3))
    row = ingest.normalise(df).first()
    assert (row.size_bytes, row.duration_ms) == (12, -3)


@pytest.mark.parametrize("fields, reasons", [
    ({}, []),
    ({"size_bytes": None, "error": None}, []),
    ({"profile": ""}, ["profile: length"]),
    ({"profile": None, "status": "unknown"}, ["profile: length", "status: value"]),
    ({"status": None}, ["status: value"]),
    ({"db_type": "x" * 51}, ["db_type: length"]),
    ({"run_id": "x" * 200}, []),
    ({"run_id": "x" * 201}, ["run_id: length"]),
    ({"size_bytes": "-1"}, ["size_bytes: negative"]),
    ({"error": "x" * 2001, "started_at": "x" * 101}, ["error: length", "started_at: length"]),
])
def test_validation(spark, fields, reasons):
    df = ingest.normalise(raw(spark, **fields))
    assert ingest.with_reasons(df).first().reasons == reasons
    valid, rejected = ingest.split_valid(df)
    assert (valid.count(), rejected.count()) == ((0, 1) if reasons else (1, 0))


@pytest.mark.parametrize("forwarded, real, want", [
    ("1.1.1.1, 2.2.2.2", "9", "1.1.1.1"), (" 3.3.3.3 ", None, "3.3.3.3"), ("", "9.9.9.9", "9.9.9.9"),
    (None, None, "unknown"), (" , 2.2.2.2", "", "unknown"),
])
def test_client_ip(spark, forwarded, real, want):
    df = spark.createDataFrame([(forwarded, real)], "f string, r string")
    assert df.select(ingest.client_ip(F.col("f"), F.col("r")).alias("ip")).first().ip == want


def test_tokens(spark):
    tokens = spark.createDataFrame([("t1", "a", None), ("t2", "b", 5)], "id string, tok string, revoked_at long")
    tokens = tokens.withColumn("token_hash", F.sha2("tok", 256)).withColumn("last_used_at", F.lit(99).cast("long"))
    rows = [(1, "a"), (2, "b"), (3, None), (4, "shared"), (5, "")]
    reports = spark.createDataFrame(rows, "seq int, token string").withColumn("reported_at", F.col("seq") * 40).withColumn(
        "forwarded_for", F.lit(None).cast("string")).withColumn("real_ip", F.lit("ip"))
    checked = ingest.authorise(reports, tokens, "shared").cache()
    assert {r.seq for r in checked.filter("authorised").collect()} == {1, 4}
    assert {r.seq for r in ingest.authorise(reports, tokens).filter("authorised").collect()} == {1}
    detail = {r.id: r.detail for r in ingest.unauthorised_audit(checked).collect()}
    assert detail == {2: "invalid token", 3: "missing token", 5: "missing token"}
    assert {r.id: r.last_used_at for r in ingest.token_use(tokens, checked).collect()} == {"t1": 99, "t2": 99}


REPORTS = [
    # seq, run, server, name, status, finished, at
    (1, "r1", "a", "A", "success", "f1", 100), (2, "r2", "a", "A2", "failed", "f2", 200),
    (3, "r1", "b", "B", "failed", "f3", 300), (4, "r3", "b", "B", "success", None, 50),
]
SCHEMA = "seq int, run_id string, server_id string, server_name string, status string, finished_at string, reported_at long"


def test_fleet(spark):
    reports = spark.createDataFrame(REPORTS, SCHEMA)
    servers, runs = ingest.servers_of(reports), ingest.first_reports(reports)
    assert {r.run_id: r.server_id for r in runs.collect()} == {"r1": "a", "r2": "a", "r3": "b"}
    assert [r.run_id for r in ingest.clashing_run_ids(reports).collect()] == ["r1"]
    silent = spark.createDataFrame([("z", "Z", 1, 1)], "id string, name string, last_seen_at long, created_at long")
    view = fleet.newest_first(fleet.fleet_overview(servers.unionByName(silent), runs)).collect()
    got = [(r.id, r.name, r.last_seen_at, r.last_status, r.last_finished, r.last_success, r.run_count) for r in view]
    assert got == [("b", "B", 300, "success", None, 50, 1), ("a", "A2", 200, "failed", "f2", 100, 2),
                   ("z", "Z", 1, None, None, None, 0)]
    table = fleet.fleet_table(spark.createDataFrame(view), alerts.health_state(
        F.col("last_success"), F.col("last_status"), F.lit(150), 60))
    assert {r.id: r.state for r in table.collect()} == {"a": "failing", "b": "overdue", "z": "none"}
    assert tuple(fleet.needing_attention(table).first()) == (3, 2)
    assert [r.run_id for r in fleet.runs_of_server(runs, "a", 1).collect()] == ["r2"]
    assert fleet.server_lookup(servers, runs, "nobody").count() == 0
    assert fleet.search_servers(servers, " ").count() == 2
    assert [r.id for r in fleet.search_servers(servers, " a2 A").collect()] == ["a"]
    assert tuple(fleet.table_counts(servers, runs).first()) == (2, 3)


@pytest.mark.parametrize("success, status, want", [
    (None, "success", "overdue"), (0, "success", "ok"), (-1, "success", "overdue"), (0, "failed", "failing"),
    (5, None, "ok"),
])
def test_health_state(spark, success, status, want):
    df = spark.createDataFrame([(success, status)], "s long, st string")
    state = alerts.health_state(F.col("s"), F.col("st"), F.lit(26 * HOUR))
    assert df.select(state.alias("x")).first().x == want
    assert alerts.max_age_ms() == alerts.max_age_ms(0) == 26 * HOUR and alerts.max_age_ms(1) == HOUR


def test_check_and_messages(spark):
    health = spark.createDataFrame(
        [("a", "A", "success", 10 * HOUR), ("b", "B", "failed", 99 * HOUR), ("c", "C", None, None),
         ("d", "D", "success", 99 * HOUR), ("e", "E", "success", 99 * HOUR)],
        "id string, name string, last_status string, last_success long")
    stored = spark.createDataFrame([("a", "failing", 1), ("d", "overdue", 1)], "server_id string, state string, since long")
    checked = alerts.check(health, stored, 100 * HOUR)
    kinds = {r.id: (r.previous, r.state, r.kind) for r in checked.collect()}
    assert kinds == {"a": ("failing", "overdue", None), "b": ("ok", "failing", "problem"),
                     "c": ("ok", "overdue", "problem"), "d": ("overdue", "ok", "recovered"), "e": ("ok", "ok", None)}
    after = keyed.upsert(stored, alerts.state_updates(checked), ["server_id"], ["state", "since"])
    assert {r.server_id: (r.state, r.since == 1) for r in after.collect()} == {
        "a": ("overdue", False), "b": ("failing", False), "c": ("overdue", False), "d": ("ok", False)}
    messages = alerts.alert_messages(checked)
    assert {r.id: r.message for r in messages.collect()} == {
        "b": "B (b): latest backup FAILED", "c": "C (c): no recent successful backup — never succeeded",
        "d": "D (d): recovered — backups healthy again"}
    assert alerts.digest_subjects(messages).first().subject == "tablekeeper: 2 alert(s), 1 recovered"
    pages = {(r.kind, r.page): r.body for r in alerts.digest_pages(messages, 1).collect()}
    assert pages[("problem", 0)] == "Backup problems:\nB (b): latest backup FAILED" and len(pages) == 3


def test_audit_failure_does_not_break(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "e", None, None, None), (2, 5, "e", None, None, None)],
                                 "id long, at long, event string, actor string, ip string, detail string")
    assert audit.append_audit(rows, str(tmp_path / "a"))
    (tmp_path / "file").write_text("x")
    assert not audit.append_audit(rows, str(tmp_path / "file" / "below"))
    assert [r.id for r in audit.recent_audit(spark.read.parquet(str(tmp_path / "a")), 1).collect()] == [2]


def test_keyed_tables(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, v string, w string")
    updates = spark.createDataFrame([(2, None, "new"), (3, "c", "z")], "k int, v string, w string")

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    assert rows(keyed.upsert(table, updates, ["k"], ["v"])) == [(1, "a", "x"), (2, None, None), (3, "c", "z")]
    assert rows(keyed.insert_ignore(table, updates, ["k"])) == [(1, "a", "x"), (2, "b", None), (3, "c", "z")]
    assert rows(keyed.update_where(table, F.col("w") == "x", v=F.lit("n"))) == [(1, "n", "x"), (2, "b", None)]
    assert rows(keyed.delete_keys(table, updates, ["k"])) == [(1, "a", "x")]
