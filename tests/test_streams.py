import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablekeeper.operators.alerts import check_history
from tablekeeper.plans import fixtures as fx
from tablekeeper.plans import streaming_queries as sq
from tablekeeper.operators import ingest as report_rules
from tablekeeper.operators import throttle as rules
from tablekeeper.sources import files, keyed_table
from tablekeeper.streaming import alerts, counts, ingest, late, throttle
from tablekeeper.streaming.state import finish, write_parquet

FOLDER = "/root/testdata/sf0.001"


def test_ingest_again_changes_nothing(spark, tmp_path):
    wire, tokens = sq._wire(spark, FOLDER), fx.tokens(spark, FOLDER)
    path, root = str(tmp_path / "wire"), str(tmp_path / "root")
    wire.coalesce(2).write.parquet(path)

    def run(checkpoint):
        stream = sq._stream(spark, path, wire.schema)
        finish(ingest.ingest_stream(stream, root, str(tmp_path / checkpoint), tokens))
        servers, runs = ingest.tables(spark, root)
        return sorted(map(repr, servers.collect())), sorted(map(repr, runs.collect()))

    first = run("one")
    assert first[0] and first[1]
    assert run("one") == first  # going on from the checkpoint finds nothing new
    assert run("two") == first  # what comes again under another checkpoint adds nothing
    state = files.names(spark, f"{root}/tables/runs/state")
    finish(ingest.ingest_stream(sq._stream(spark, path, wire.schema), root, str(tmp_path / "one"), tokens))
    assert files.names(spark, f"{root}/tables/runs/state") == state
    ingest.compact(spark, root)
    assert run("one") == first


def test_reports_sent_twice_count_once(spark, tmp_path):
    wire, tokens = sq._wire(spark, FOLDER), fx.tokens(spark, FOLDER)
    root = str(tmp_path / "root")
    ingest.write_batch(wire, 0, root, tokens)
    _, once = ingest.tables(spark, root)
    n = once.count()
    later = wire.withColumn("reported_at", F.col("reported_at") + 1).withColumn("seq", F.col("seq") + 10**6)
    ingest.write_batch(later, 1, root, tokens)
    servers, runs = ingest.tables(spark, root)
    assert runs.count() == n
    seen = ingest.read_part(spark, root, "accepted").agg(F.max("reported_at")).first()[0]
    assert servers.agg(F.max("last_seen_at")).first()[0] == seen


def _counted(spark, df):
    """The same rows, and how often one of them has been read."""
    seen = spark.sparkContext.accumulator(0)

    def count(row):
        seen.add(1)
        return row

    return spark.createDataFrame(spark.createDataFrame(df.collect(), df.schema).rdd.map(count), df.schema), seen


def test_batch_is_read_and_checked_once(spark, tmp_path):
    """Reports and tokens of a batch are read once, however many parts and tables it goes to."""
    columns = ("seq long, server_id string, server_name string, run_id string, profile string, db_type string, "
               "backup_type string, status string, size_bytes string, duration_ms string, started_at string, "
               "finished_at string, error string, reported_at long, token string, forwarded_for string, real_ip string")

    def report(seq, token, status="success", run="r"):
        return (seq, "s", "S", run, "p", "db", "full", status, "1", "2", None, None, None, seq, token, " 10.1.1.1 , x", "h")

    rows = [report(1, "good"), report(2, "good", "odd"), report(3, None), report(4, "bad"), report(5, "good"),
            report(6, "", run=None)]
    reports, read = _counted(spark, spark.createDataFrame(rows, columns))
    known = spark.createDataFrame([(7, "good", None), (8, "bad", 1)], "id long, token string, revoked_at long").select(
        "id", F.sha2("token", 256).alias("token_hash"), "revoked_at")
    tokens, tokens_read = _counted(spark, known)
    root = str(tmp_path / "root")
    ingest.write_batch(reports, 0, root, tokens)
    assert (read.value, tokens_read.value) == (6, 2)

    def part(name):
        return {r.seq if "seq" in r else r.id: r for r in ingest.read_part(spark, root, name).collect()}

    assert set(part("accepted")) == {1, 5} and part("rejected")[2].reasons == ["status: value"]
    assert {i: (r.at, r.event, r.actor, r.ip, r.detail) for i, r in part("audit").items()} == {
        i: (i, "ingest.unauthorized", "agent", "10.1.1.1", why)
        for i, why in ((3, "missing token"), (4, "invalid token"), (6, "missing token"))}
    stored = spark.read.parquet(f"{root}/checked")  # nothing else of reports turned away, and no token of any
    assert stored.where("_part = 'audit' AND coalesce(server_id, run_id, status, error) IS NOT NULL").count() == 0
    assert not {"token", "forwarded_for", "real_ip"} & set(stored.columns)
    # the batch runs again when the token has been revoked: every part is replaced, empty ones too
    ingest.write_batch(reports, 0, root, tokens.withColumn("revoked_at", F.lit(1).cast("long")))
    assert not part("accepted") and not part("rejected") and len(part("audit")) == 6


def test_input_of_many_rows_comes_in_several_files(spark, tmp_path, monkeypatch):
    """What one task writes as input can be read by several."""
    monkeypatch.setattr(sq, "ROWS_PER_FILE", 10)
    seen = []

    def start(stream):
        def each(batch, number):
            seen.append((batch.count(), batch.select(F.input_file_name()).distinct().count()))

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(
            availableNow=True).start()

    rows = spark.range(60).withColumn("t", F.when(F.col("id") < 35, 0).otherwise(sq.HALF_MS).cast("long")).coalesce(1)
    sq._in_steps(spark, rows, "t", start)
    assert seen == [(35, 4), (25, 3)]


def test_alerts_by_clock(spark, tmp_path):
    """Reports that arrive at once, long after: every check is due with all of them known."""
    start, period, checks = sq.FIRST_CHECK_MS, fx.DAY_MS, 8
    reports = fx.run_reports(spark, FOLDER).select("server_id", "run_id", "status", "reported_at")
    reports.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reports.schema).parquet(str(tmp_path / "in"))
    changes = alerts.alert_changes(stream, start, period, fx.MAX_AGE_MS, checks=checks)
    # checks by the clock never end by themselves, so one batch is run
    query = (
        changes.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
    )
    assert query.awaitTermination(120)
    want = check_history(reports, start, period, checks, fx.MAX_AGE_MS).filter("state <> previous")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(
        map(tuple, want.collect()), key=repr)
    assert got.count() > 0


def test_server_of_any_name_gets_alerts(spark, tmp_path):
    """A server may be called heartbeat; rows without a server only move the watermark."""
    day = fx.DAY_MS
    rows = [("heartbeat", "r1", "failed", 1), (None, None, None, 5 * day)]
    reports = spark.createDataFrame(rows, "server_id string, run_id string, status string, reported_at bigint")
    reports.write.parquet(str(tmp_path / "in"))
    stream = sq._stream(spark, str(tmp_path / "in"), reports.schema)
    changes = alerts.alert_changes(stream, day, day, delay="0 seconds", checks=3)
    finish(write_parquet(changes, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.server_id, r.kind) for r in got] == [("heartbeat", "problem")]


def test_lost_checkpoint_keeps_earlier_reports(spark, tmp_path):
    wire, tokens = sq._wire(spark, FOLDER), fx.tokens(spark, FOLDER)
    root = str(tmp_path / "root")
    for n, step in enumerate((F.col("seq") % 2 == 0, F.col("seq") % 2 == 1)):
        path = str(tmp_path / f"wire{n}")
        wire.filter(step).write.parquet(path)
        stream = sq._stream(spark, path, wire.schema)
        finish(ingest.ingest_stream(stream, root, str(tmp_path / f"cp{n}"), tokens))
    _, runs = ingest.tables(spark, root)
    other = str(tmp_path / "other")
    ingest.write_batch(wire, 0, other, tokens)
    assert runs.count() == ingest.tables(spark, other)[1].count()


def test_batch_has_several_partitions(spark, tmp_path):
    path, seen = str(tmp_path / "in"), []
    spark.range(0, 1000, numPartitions=4).write.parquet(path)
    stream = sq._stream(spark, path, spark.range(1).schema)
    finish(stream.writeStream.foreachBatch(
        lambda batch, n: seen.append(batch.rdd.getNumPartitions())
    ).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert max(seen) > 1


def test_keyed_table(spark, tmp_path, monkeypatch):
    """Batches against one aggregate over all rows; only touched buckets are written, old folders go."""
    root = str(tmp_path / "t")

    def merge(rows):
        return rows.groupBy("k").agg(F.min("first").alias("first"), F.max("last").alias("last"))

    table = keyed_table.KeyedTable(root, "k string, first long, last long", ("k",), merge, buckets=8, most_deltas=2)
    assert keyed_table.read(spark, table).count() == 0 and not keyed_table.applied(spark, table, "s", 0)
    rng, seen = random.Random(4), {}
    for number in range(7):
        batch = [(None if rng.random() < 0.05 else f"k{rng.randrange(60)}", number, number) for _ in range(30)]
        batch = [(k, a, b) for k, a, b in batch] if number != 3 else [("k1", 3, 3)]
        frame = spark.createDataFrame(batch, table.schema)
        assert keyed_table.append(frame, table, "s", number)
        assert not keyed_table.append(frame, table, "s", number)  # the same batch again
        if number == 3:
            assert sum(n.startswith("_bucket=") for n in files.names(spark, f"{root}/data/s-{3:010d}")) <= 1
        for k, a, _ in batch:
            seen.setdefault(k, [a, a])[1] = a
        got = {r.k: [r.first, r["last"]] for r in keyed_table.read(spark, table).collect()}
        assert got == seen
        folders, _ = keyed_table._state(spark, table)
        assert max(map(len, folders.values())) <= 2
    assert len(files.names(spark, f"{root}/state")) <= 5
    keyed_table.compact(spark, table)
    keyed_table.compact(spark, table)
    assert {r.k: [r.first, r["last"]] for r in keyed_table.read(spark, table).collect()} == seen


@pytest.mark.parametrize("rows_per_task", [10_000, 60])
def test_throttle_in_batches(spark, tmp_path, rows_per_task):
    """In order of arrival, with a key of a third of all rows and late events; a batch may come twice."""
    rng, root, window, limit = random.Random(8), str(tmp_path / "t"), 50, 3
    events = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", at + rng.randrange(-30, 30), i)
              for i, at in enumerate(sorted(rng.randrange(3000) for _ in range(500)))]
    open_until, want = {}, {}
    for number in range(4):
        batch = events[number * 125:(number + 1) * 125]
        frame = spark.createDataFrame(batch, "key string, at long, id long")
        for _ in range(2):
            throttle.throttle_batch(frame, number, root, window, limit, rows_per_task=rows_per_task)
        for key, at, i in sorted(batch, key=lambda e: (e[1], e[2])):
            reset, used = open_until.get(key, (None, 0))
            if reset is None or at > reset:
                reset, used = at + window, 0
            want[i] = (at, used < limit)
            open_until[key] = (reset, used + want[i][1])
    got = throttle.read_decided(spark, root).collect()
    assert len(got) == 500 and {r.id: (r.at, r.allowed) for r in got} == want
    assert rules.throttle(spark.createDataFrame(events, "key string, at long, id long"), window, limit).columns == [
        "key", "at", "id", "allowed"]


def test_late_rows_are_kept_apart(spark, tmp_path):
    """A late row is in quarantine, none vanishes, and counts behind the gate are those of the rows on time."""
    root, schema = str(tmp_path / "gate"), "id long, t long"
    batches = [[(1, 100), (2, 200)], [(3, 149), (4, 150), (5, 400)], [(6, None), (7, 349), (8, 350)], []]
    for number, batch in enumerate(batches):
        for _ in range(2):  # a batch that runs again decides the same
            late.gate_batch(spark.createDataFrame(batch, schema), number, root, "t", 50)
    ids = {name: sorted(r.id for r in late.read(spark, root, name, schema).collect()) for name in ("on_time", "late")}
    assert ids == {"on_time": [1, 2, 4, 5, 8], "late": [3, 6, 7]}
    assert late.read(spark, str(tmp_path / "no"), "late", schema).count() == 0


def test_counts_and_alerts_behind_the_gate(spark, tmp_path):
    day, root = fx.DAY_MS, str(tmp_path / "gate")
    schema = "server_id string, run_id string, status string, reported_at long"
    first = [("a", "r1", "success", day), ("b", "r2", "failed", 3 * day), ("a", "r3", "success", 6 * day)]
    then = [("a", "late", "failed", 2 * day), ("b", "r4", "success", 6 * day + 1), (None, None, None, 12 * day)]
    for number, batch in enumerate((first, then)):
        late.gate_batch(spark.createDataFrame(batch, schema), number, root, "reported_at", day)
    assert [r.run_id for r in late.read(spark, root, late.LATE, schema).collect()] == ["late"]
    stream = late.stream_on_time(spark, root, schema)
    changes = alerts.alert_changes(stream, day, day, delay=f"{day} milliseconds", checks=9)
    finish(write_parquet(changes, str(tmp_path / "out"), str(tmp_path / "cp")))
    on_time = spark.createDataFrame([r for r in first + then if r[0] and r[1] != "late"], schema)
    want = check_history(on_time, day, day, 9).filter("state <> previous")
    got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_parts_before_the_first_batch(spark, tmp_path):
    root = str(tmp_path / "none")
    servers, runs = ingest.tables(spark, root)
    assert servers.count() == 0 and set(report_rules.REPORT_COLUMNS) < set(runs.columns)
    assert all(ingest.read_part(spark, root, name).count() == 0 for name in ingest.PARTS)
    assert counts.read_counts(spark, root).count() == 0


def test_counts_are_kept_in_merged_buckets(spark, tmp_path):
    root, table = str(tmp_path / "counts"), counts.counts_table(str(tmp_path / "counts"))
    schema = "at timestamp, event string, payload struct<profile: string>"
    at = datetime(2024, 1, 1, 10)
    for number in range(12):
        rows = [(at, "backup.completed", ("p",))] * 2 + [(at, "backup.failed", (None,)), (at, "backup.started", ("p",))]
        batch = spark.createDataFrame(rows, schema)
        assert counts.count_batch(batch, number, root)
        assert not counts.count_batch(batch, number, root)  # comes again: counts once
    got = {(r.profile, r.status): r.n for r in counts.read_counts(spark, root).collect()}
    assert got == {("p", "completed"): 24, (None, "failed"): 12}
    folders = [p.name for p in (tmp_path / "counts" / "data").iterdir() if any(p.iterdir())]
    assert len(folders) <= 2 * table.most_deltas


def test_servers_that_never_report(spark, tmp_path):
    """They turn overdue in the history and in the stream alike; reports before or after enrolment count as ever."""
    day = fx.DAY_MS
    reports = spark.createDataFrame(
        [("early", "r1", "success", day // 2), ("late", "r2", "failed", 6 * day), ("own", "r3", "success", 2 * day),
         (None, None, None, 12 * day)], "server_id string, run_id string, status string, reported_at bigint")
    servers = spark.createDataFrame(
        [("silent", 3 * day), ("always", None), ("early", 5 * day), ("late", 2 * day + 1)],
        "server_id string, since bigint")
    want = check_history(reports.where("server_id IS NOT NULL"), day, day, 9, servers=servers)
    states = {(r.server_id, r.checked_at // day): r.state for r in want.collect()}
    assert states["silent", 3] == "overdue" and ("silent", 2) not in states
    assert states["always", 1] == "overdue" and states["early", 1] == "ok" and states["early", 5] == "overdue"
    assert states["late", 3] == "overdue" and states["late", 6] == "overdue"
    reports.write.parquet(str(tmp_path / "in"))
    stream = sq._stream(spark, str(tmp_path / "in"), reports.schema)
    changes = alerts.alert_changes(stream, day, day, delay="0 seconds", checks=9, servers=servers)
    finish(write_parquet(changes, str(tmp_path / "out"), str(tmp_path / "cp")))
    want = want.filter("state <> previous")
    got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_servers_share_state_and_timers(spark, tmp_path, monkeypatch):
    """All servers in three groups, in steps and by an enrolment on other days: the same changes as in the history."""
    monkeypatch.setattr(alerts, "GROUPS", 3)
    day, rng, path = fx.DAY_MS, random.Random(5), str(tmp_path / "in")
    reports = [(f"s{rng.randrange(40)}", f"r{i:04d}", rng.choice(["success", "success", "failed"]), at)
               for i, at in enumerate(sorted(rng.randrange(9 * day) for _ in range(300)))]
    schema = "server_id string, run_id string, status string, reported_at long"
    servers = spark.createDataFrame(
        [(f"s{i}", None if i % 7 == 0 else i % 11 * day + i % 2) for i in range(60)], "server_id string, since long")
    beats = [(None, None, None, at) for *_, at in reports[::9]]  # come among the reports
    for step in (reports[:140] + beats[:15], reports[140:] + beats[16:], [(None, None, None, 12 * day)]):
        spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(path)
        changes = alerts.alert_changes(
            sq._stream(spark, path, schema), day, day, delay="0 seconds", checks=9, servers=servers)
        finish(write_parquet(changes, str(tmp_path / "out"), str(tmp_path / "cp")))
    want = check_history(spark.createDataFrame(reports, schema), day, day, 9, servers=servers)
    want = want.filter("state <> previous")
    got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
