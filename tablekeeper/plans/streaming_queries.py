"""Streaming jobs run to the end over files made from the tables, beside their batch meaning."""

from pyspark.sql import functions as F

from tablekeeper.operators.alerts import check_history
from tablekeeper.plans.fixtures import (
    DAY_MS, HOUR_MS, MAX_AGE_MS, RUN_LOG, RUN_REPORTS, TOKENS, load, log_lines,
    raw_reports, run_reports, tokens,
)
from tablekeeper.plans.fleet_queries import (
    CHECKS, FIRST_CHECK_MS, NORMALISED, REASONS_SQL, state_sql,
)
from tablekeeper.plans.history_queries import EVENT_COLUMNS, event_columns
from tablekeeper.plans.registry import query
from tablekeeper.plans.text_queries import throttle_events, throttle_sql
from tablekeeper.session import work_dir
from tablekeeper.sources.event_log import append_event_stream, scan_events, stream_events
from tablekeeper.streaming import alerts, counts, ingest, late, throttle
from tablekeeper.streaming.state import finish, write_parquet

HALF_MS = FIRST_CHECK_MS + 15 * DAY_MS
ROWS_PER_FILE = 250_000  # a file of few bytes and many rows would be read by one task


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


def _in_steps(spark, df, time, start, last=None):
    """Fill a folder with the rows of the first half of time, run the stream of it to the end, fill in the
    rest, and run it again from where it stopped."""
    path = work_dir(spark, "input")
    steps = [df.filter(F.col(time) < HALF_MS), df.filter(F.col(time) >= HALF_MS)]
    for step in steps + ([] if last is None else [last]):
        step.write.mode("append").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
        finish(start(_stream(spark, path, df.schema)))


def _run_in_steps(spark, df, time, name, transform, last=None):
    out = work_dir(spark, name)
    _in_steps(spark, df, time, lambda stream: write_parquet(
        transform(stream), f"{out}/rows", f"{out}/checkpoint"), last)
    return spark.read.parquet(f"{out}/rows")


def _run(spark, df, name):
    out = work_dir(spark, name)
    finish(write_parquet(df, f"{out}/rows", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/rows")


STREAM_HISTORY = f"""{RUN_REPORTS},
instants AS (SELECT {FIRST_CHECK_MS} + i * {DAY_MS} AS checked_at FROM range({CHECKS}) t(i)),
at_check AS (
  SELECT r.server_id, i.checked_at,
    max(reported_at) FILTER (status = 'success') AS last_success,
    arg_max(status, reported_at * 1000000 + seq) AS last_status
  FROM run_reports r JOIN instants i ON r.reported_at <= i.checked_at
  GROUP BY r.server_id, i.checked_at
),
states AS (SELECT *, {state_sql('last_success', 'last_status', 'checked_at')} AS state FROM at_check),
steps AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY server_id ORDER BY checked_at), 'ok')
  AS previous FROM states)"""


@query("stream_alert_changes", f"""WITH {STREAM_HISTORY}
SELECT *, CASE WHEN state <> 'ok' AND previous = 'ok' THEN 'problem'
  WHEN state = 'ok' AND previous <> 'ok' THEN 'recovered' END AS kind
FROM steps WHERE state <> previous""")
def stream_alert_changes(spark, folder):
    reports = run_reports(spark, folder).select("server_id", "run_id", "status", "reported_at")
    return _run_in_steps(spark, reports, "reported_at", "alerts", lambda stream: alerts.alert_changes(
        stream, FIRST_CHECK_MS, DAY_MS, MAX_AGE_MS, delay="0 seconds", checks=CHECKS), _heartbeat(reports))


def _heartbeat(reports):
    """A row after the last check, which lets the timers of silent servers fire."""
    end = FIRST_CHECK_MS + CHECKS * DAY_MS + HOUR_MS
    none = F.lit(None).cast("string")
    return reports.agg(none.alias("server_id"), none.alias("run_id"), none.alias("status"),
                       F.lit(end).alias("reported_at"))


# Suppliers are servers that were enrolled one after another and never report; some that do are enrolled as well.
ENROLLED = f"""{RUN_REPORTS},
enrolled AS (
  SELECT 'sup-' || s_suppkey AS server_id, CASE WHEN s_suppkey % 5 > 0
    THEN {FIRST_CHECK_MS} + (s_suppkey % 25) * {DAY_MS} + 1 END AS since FROM supplier
  UNION ALL SELECT DISTINCT server_id, {FIRST_CHECK_MS} + 3 * {DAY_MS} FROM run_reports),
known AS (
  SELECT server_id, min(t) AS since FROM (
    SELECT server_id, coalesce(since, {FIRST_CHECK_MS}) AS t FROM enrolled
    UNION ALL SELECT server_id, reported_at FROM run_reports) GROUP BY server_id),
instants AS (SELECT {FIRST_CHECK_MS} + i * {DAY_MS} AS checked_at FROM range({CHECKS}) t(i)),
at_check AS (
  SELECT k.server_id, i.checked_at, max(reported_at) FILTER (status = 'success') AS last_success,
    arg_max(status, reported_at * 1000000 + seq) AS last_status
  FROM known k JOIN instants i ON k.since <= i.checked_at
  LEFT JOIN run_reports r ON r.server_id = k.server_id AND r.reported_at <= i.checked_at
  GROUP BY k.server_id, i.checked_at),
states AS (SELECT *, {state_sql('last_success', 'last_status', 'checked_at')} AS state FROM at_check),
steps AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY server_id ORDER BY checked_at), 'ok')
  AS previous FROM states),
enrolled_history AS (SELECT *, CASE WHEN state <> 'ok' AND previous = 'ok' THEN 'problem'
  WHEN state = 'ok' AND previous <> 'ok' THEN 'recovered' END AS kind FROM steps)"""


def _enrolled(spark, folder):
    key = F.col("s_suppkey")
    since = F.when(key % 5 > 0, F.lit(FIRST_CHECK_MS) + (key % 25) * F.lit(DAY_MS) + 1)
    silent = load(spark, folder, "supplier").select(
        F.concat(F.lit("sup-"), key).alias("server_id"), since.cast("bigint").alias("since"))
    return silent.unionByName(run_reports(spark, folder).select("server_id").distinct().withColumn(
        "since", F.lit(FIRST_CHECK_MS + 3 * DAY_MS)))


@query("alert_history_enrolled", f"WITH {ENROLLED} SELECT * FROM enrolled_history")
def alert_history_enrolled(spark, folder):
    """Checks of all servers, also of those that have never run."""
    runs = run_reports(spark, folder)
    return check_history(runs, FIRST_CHECK_MS, DAY_MS, CHECKS, MAX_AGE_MS, _enrolled(spark, folder))


@query("stream_alert_enrolled", f"WITH {ENROLLED} SELECT * FROM enrolled_history WHERE state <> previous")
def stream_alert_enrolled(spark, folder):
    """The changes of the same history by a stream that starts with the enrolled servers as its state."""
    reports = run_reports(spark, folder).select("server_id", "run_id", "status", "reported_at")
    servers = _enrolled(spark, folder)
    return _run_in_steps(spark, reports, "reported_at", "alerts", lambda stream: alerts.alert_changes(
        stream, FIRST_CHECK_MS, DAY_MS, MAX_AGE_MS, delay="0 seconds", checks=CHECKS, servers=servers),
        _heartbeat(reports))


@query("stream_throttle", throttle_sql(DAY_MS, 2))
def stream_throttle(spark, folder):
    events, root = throttle_events(spark, folder), work_dir(spark, "throttle")
    _in_steps(spark, events, "at", lambda stream: throttle.throttle_stream(
        stream, root, f"{root}/checkpoint", DAY_MS, 2))
    return throttle.read_decided(spark, root, "bigint")


@query("event_outcome_counts", f"""WITH {RUN_LOG}
SELECT profile, (at_ms // {DAY_MS}) * {DAY_MS} AS window_start,
  split_part(event, '.', 1) AS category, split_part(event, '.', 2) AS status, count(*) AS n
FROM run_log WHERE split_part(event, '.', 2) IN ('completed', 'failed') GROUP BY ALL""")
def event_outcome_counts(spark, folder):
    from tablekeeper.plans.fixtures import run_log

    return counts.outcome_counts(run_log(spark, folder))


def _log_folder(spark, folder):
    path = work_dir(spark, "log")
    lines = log_lines(spark, folder)
    for step in (F.col("line_no") % 2 == 0, F.col("line_no") % 2 == 1):
        lines.filter(step).select("value").write.mode("append").text(path)
    return path


@query("stream_event_log", f"WITH {RUN_LOG} SELECT {EVENT_COLUMNS} FROM run_log")
def stream_event_log(spark, folder):
    events = stream_events(spark, _log_folder(spark, folder))
    return _run(spark, event_columns(events), "events")


@query("stream_event_log_append", f"WITH {RUN_LOG} SELECT {EVENT_COLUMNS} FROM run_log")
def stream_event_log_append(spark, folder):
    """Events read as a stream, appended to another log as a stream, and scanned there."""
    root = work_dir(spark, "log")
    events = stream_events(spark, _log_folder(spark, folder))
    finish(append_event_stream(events, f"{root}/copy", f"{root}/checkpoint"))
    return event_columns(scan_events(spark, f"{root}/copy"))


@query("stream_outcome_counts", f"""WITH {RUN_LOG}
SELECT profile, (at_ms // {DAY_MS}) * {DAY_MS} AS window_start,
  split_part(event, '.', 1) AS category, split_part(event, '.', 2) AS status, count(*) AS n
FROM run_log WHERE split_part(event, '.', 2) IN ('completed', 'failed') GROUP BY ALL""")
def stream_outcome_counts(spark, folder):
    """Half of the lines come when events of all days have been counted already."""
    path, root = work_dir(spark, "log"), work_dir(spark, "counts")
    lines = log_lines(spark, folder)
    for step in (F.col("line_no") % 2 == 0, F.col("line_no") % 2 == 1):
        lines.filter(step).select("value").write.mode("append").text(path)
        finish(counts.count_stream(stream_events(spark, path), f"{root}/counts", f"{root}/checkpoint"))
    return counts.read_counts(spark, f"{root}/counts")


# --- ingestion -----------------------------------------------------------------------------------

def _wire(spark, folder):
    """Raw reports with tokens; the ids of two senders clash."""
    user = F.substring("server_id", 5, 20)
    return raw_reports(spark, folder).select(
        "*",
        F.when(F.col("k") % 33 != 0, F.concat(F.lit("tok-"), user)).alias("token"),
        F.lit(None).cast("string").alias("forwarded_for"),
        F.concat(F.lit("10.0.0."), "k").alias("real_ip"),
    )


WIRE = f"""{NORMALISED},
{TOKENS},
wire AS (
  SELECT n.*, {REASONS_SQL} AS reasons, t.id AS token_id FROM normalised n
  LEFT JOIN tokens t ON t.revoked_at IS NULL AND k % 33 <> 0
    AND t.token_hash = sha256('tok-' || substr(server_id, 5))
)"""


def _ingested(spark, folder):
    root, known = work_dir(spark, "ingest"), work_dir(spark, "tokens")
    wire = _wire(spark, folder)
    tokens(spark, folder).write.parquet(known)  # a stored table, as batches meet it
    _in_steps(spark, wire, "reported_at", lambda stream: ingest.ingest_stream(
        stream, root, f"{root}/checkpoint", spark.read.parquet(known)))
    return root


@query("stream_ingest_runs", f"""WITH {WIRE}
SELECT run_id, server_id, server_name, status, size_bytes, reported_at FROM wire
WHERE token_id IS NOT NULL AND reasons = ''
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY reported_at, seq) = 1""")
def stream_ingest_runs(spark, folder):
    _, runs = ingest.tables(spark, _ingested(spark, folder))
    return runs.select("run_id", "server_id", "server_name", "status", "size_bytes", "reported_at")


@query("stream_ingest_outcomes", f"""WITH {WIRE}
SELECT 'audit' AS part, count(*) AS n FROM wire WHERE token_id IS NULL
UNION ALL SELECT 'rejected', count(*) FROM wire WHERE token_id IS NOT NULL AND reasons <> ''
UNION ALL SELECT 'accepted', count(*) FROM wire WHERE token_id IS NOT NULL AND reasons = ''""")
def stream_ingest_outcomes(spark, folder):
    root = _ingested(spark, folder)
    parts = [
        ingest.read_part(spark, root, name).select(F.lit(name).alias("part"))
        for name in ingest.PARTS
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("part").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("stream_ingest_again", f"""WITH {WIRE},
ok AS (SELECT * FROM wire WHERE token_id IS NOT NULL AND reasons = '')
SELECT server_id AS id, arg_max(server_name, reported_at * 1000000 + seq) AS name, max(reported_at) AS last_seen_at,
  min(reported_at) AS created_at, (SELECT count(DISTINCT run_id) FROM ok) AS runs,
  (SELECT count(DISTINCT run_id) FROM ok) AS runs_compacted FROM ok GROUP BY server_id""")
def stream_ingest_again(spark, folder):
    """The servers table after the stream, after every report came again under another checkpoint, and after all
    buckets were merged."""
    root = _ingested(spark, folder)
    wire, path = _wire(spark, folder), work_dir(spark, "input")
    wire.write.parquet(path)
    finish(ingest.ingest_stream(_stream(spark, path, wire.schema), root, f"{root}/other", tokens(spark, folder)))
    _, runs = ingest.tables(spark, root)
    before = runs.count()
    ingest.compact(spark, root)
    servers, runs = ingest.tables(spark, root)
    return servers.select("*", F.lit(before).cast("bigint").alias("runs"),
                          F.lit(runs.count()).cast("bigint").alias("runs_compacted"))


DELAY_MS = 36 * HOUR_MS
# The reports of the second half, and a copy of every report of the first half that comes with them.
LATE = f"""{RUN_REPORTS},
halves AS (
  SELECT run_id, reported_at, reported_at < {HALF_MS} AS early FROM run_reports
  UNION ALL SELECT 'again-' || run_id, reported_at, false FROM run_reports WHERE reported_at < {HALF_MS}),
mark AS (SELECT coalesce(max(reported_at), 0) - {DELAY_MS} AS m FROM run_reports WHERE reported_at < {HALF_MS})"""


def _gated(spark, folder):
    """Reports parted by the gate: the first half, then the rest with copies of the first half."""
    root, path = work_dir(spark, "gate"), work_dir(spark, "input")
    reports = run_reports(spark, folder).select("server_id", "run_id", "status", "reported_at")
    early = reports.where(F.col("reported_at") < HALF_MS)
    again = early.withColumn("run_id", F.concat(F.lit("again-"), "run_id"))
    for step in (early, reports.where(F.col("reported_at") >= HALF_MS).unionByName(again)):
        step.write.mode("append").parquet(path)
        finish(late.gate(_stream(spark, path, reports.schema), root, f"{root}/checkpoint", "reported_at", DELAY_MS))
    return root, reports.schema


@query("stream_late_rows", f"""WITH {LATE}
SELECT run_id, reported_at, CASE WHEN early OR reported_at >= m THEN 'on_time' ELSE 'late' END AS part
FROM halves, mark""")
def stream_late_rows(spark, folder):
    """Every row is on time or in quarantine."""
    root, schema = _gated(spark, folder)
    parts = [late.read(spark, root, name, schema).select("run_id", "reported_at", F.lit(name).alias("part"))
             for name in (late.ON_TIME, late.LATE)]
    return parts[0].unionByName(parts[1])


@query("stream_unique_on_time", f"""WITH {LATE}
SELECT run_id, count(*) AS n FROM halves, mark WHERE early OR reported_at >= m GROUP BY run_id""")
def stream_unique_on_time(spark, folder):
    """First reports with bounded state, behind the gate."""
    root, schema = _gated(spark, folder)
    on_time = late.stream_on_time(spark, root, schema)
    unique = _run(spark, ingest.unique_runs(on_time, f"{DELAY_MS} milliseconds"), "unique")
    return unique.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_unique_runs", f"""WITH {RUN_REPORTS},
r AS (SELECT * FROM run_reports UNION ALL BY NAME
  SELECT * REPLACE (reported_at + {HOUR_MS} AS reported_at) FROM run_reports)
SELECT run_id, count(DISTINCT run_id) AS n FROM r GROUP BY run_id""")
def stream_unique_runs(spark, folder):
    reports = run_reports(spark, folder).select("run_id", "reported_at")
    again = reports.withColumn("reported_at", F.col("reported_at") + HOUR_MS)
    unique = _run_in_steps(spark, reports.unionAll(again), "reported_at", "unique", ingest.unique_runs)
    return unique.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
