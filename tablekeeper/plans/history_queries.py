"""Queries over the run log and the backup history."""

from pyspark.sql import functions as F

from tablekeeper.operators import history, notify
from tablekeeper.plans.fixtures import (
    RUN_CATALOG, RUN_LOG, log_lines, log_records, run_catalog, run_log,
)
from tablekeeper.plans.registry import query
from tablekeeper.session import work_dir
from tablekeeper.sources.event_log import (
    append_events, parse_lines, payload_field, scan_events, store_events, stored_events,
)

EVENT_COLUMNS = "timestamp, event, run_id, profile, other, error, at_ms"


def event_columns(events):
    return events.select(
        "timestamp", "event", "payload.run_id", "payload.profile",
        F.col("payload.profiles")[1].alias("other"), "payload.error",
        F.unix_millis("at").alias("at_ms"),
    )


@query("event_log_parse", f"WITH {RUN_LOG} SELECT {EVENT_COLUMNS} FROM run_log")
def event_log_parse(spark, folder):
    return event_columns(parse_lines(log_lines(spark, folder)))


@query("event_log_append_scan", f"WITH {RUN_LOG} SELECT {EVENT_COLUMNS} FROM run_log")
def event_log_append_scan(spark, folder):
    path = work_dir(spark, "log")
    append_events(log_records(spark, folder), path)
    noise = log_lines(spark, folder).select("value").filter(~F.col("value").endswith("}"))
    noise.write.mode("append").text(path)
    return event_columns(scan_events(spark, path))


@query("event_payload_fields", f"""WITH {RUN_LOG}
SELECT run_id, event, profile, other, target_profile, CAST(duration_ms AS BIGINT) AS duration_ms, at_ms FROM run_log""")
def event_payload_fields(spark, folder):
    """Fields of any payload by their path, from events kept as a table."""
    path = work_dir(spark, "events")
    store_events(parse_lines(log_lines(spark, folder)), path)
    events = stored_events(spark, path)
    return events.select(
        payload_field(events, "$.run_id").alias("run_id"), "event", payload_field(events, "$.profile").alias("profile"),
        payload_field(events, "$.profiles[1]").alias("other"),
        payload_field(events, "$.target_profile").alias("target_profile"),
        payload_field(events, "$.duration_ms", "bigint").alias("duration_ms"), F.unix_millis("at").alias("at_ms"))


@query("event_filter_profile", f"""WITH {RUN_LOG}
SELECT line_no, event, run_id FROM log_by_profile WHERE for_profile = 'p1'""")
def event_filter_profile(spark, folder):
    return history.events_of_profile(run_log(spark, folder), "p1").select(
        "line_no", "event", "payload.run_id"
    )


@query("event_recent", f"""WITH {RUN_LOG}
SELECT line_no, timestamp, event FROM run_log ORDER BY at_ms DESC NULLS LAST, line_no LIMIT 200""")
def event_recent(spark, folder):
    return history.recent_events(run_log(spark, folder)).select("line_no", "timestamp", "event")


RANKED = f"""{RUN_LOG},
newest AS (
  SELECT *, row_number() OVER (PARTITION BY for_profile ORDER BY at_ms DESC, line_no) AS rank
  FROM log_by_profile
)"""


def outcome_sql(done, failed):
    return (
        f"SELECT for_profile, event, timestamp, run_id, CASE event WHEN '{done}' THEN 'ok'"
        f" ELSE 'error' END AS status FROM newest WHERE event IN ('{done}', '{failed}')"
        " QUALIFY row_number() OVER (PARTITION BY for_profile ORDER BY rank) = 1"
    )


BACKUP = ("backup.completed", "backup.failed")
VERIFICATION = ("verification.completed", "verification.failed")


@query("event_latest_matching", f"""WITH {RANKED}
SELECT for_profile, line_no, event FROM newest WHERE event IN ('restore.failed', 'retention.deleted')
QUALIFY row_number() OVER (PARTITION BY for_profile ORDER BY rank) = 1""")
def event_latest_matching(spark, folder):
    found = history.latest_event(run_log(spark, folder), ["restore.failed", "retention.deleted"])
    return found.select("for_profile", "line_no", "event")


@query("event_latest_outcome", f"WITH {RANKED} {outcome_sql(*VERIFICATION)}")
def event_latest_outcome(spark, folder):
    return history.latest_outcome(run_log(spark, folder), *VERIFICATION).select(
        "for_profile", "event", "timestamp", "payload.run_id", "status"
    )


CATEGORY = "CASE WHEN contains(event, '.') THEN split_part(event, '.', 1) ELSE '' END"
STATUS = (
    "CASE WHEN split_part(event, '.', 2) IN ('started', 'completed', 'failed')"
    " THEN split_part(event, '.', 2) ELSE 'other' END"
)


@query("event_category_status", f"""WITH {RUN_LOG}
SELECT {CATEGORY} AS category, {STATUS} AS status, count(*) AS n FROM run_log GROUP BY ALL""")
def event_category_status(spark, folder):
    event = F.col("event")
    return (
        run_log(spark, folder)
        .groupBy(history.event_category(event).alias("category"),
                 history.event_status(event).alias("status"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


DURATION = """CASE WHEN duration_ms IS NULL THEN NULL
  WHEN duration_ms >= 1000 THEN printf('%.1fs', duration_ms / 1000.0::DOUBLE)
  ELSE duration_ms || 'ms' END"""


@query("event_activity_summary", f"""WITH {RUN_LOG}
SELECT line_no, event, CASE event
  WHEN 'backup.started' THEN coalesce(nullif(concat_ws(' / ', db_type, compression), ''), 'starting')
  WHEN 'backup.completed' THEN coalesce(nullif(concat_ws(', ', compression, {DURATION},
    'pruned ' || retention_deleted_count), ''), 'ok')
  WHEN 'restore.started' THEN coalesce(n_selected || ' items', 'full restore')
  WHEN 'restore.completed' THEN 'ok'
  WHEN 'verification.started' THEN 'target: ' || target_profile
  WHEN 'verification.completed' THEN 'verified via ' || target_profile
  WHEN 'scheduled_cycle.started' THEN 'cycle started'
  WHEN 'scheduled_cycle.completed' THEN coalesce('verification: ' || verification_status, 'ok')
  WHEN 'retention.deleted' THEN 'deleted 1 run(s)'
  WHEN 'notification.sent' THEN rtrim(coalesce(channel, 'n/a') || ': ' || coalesce(payload_event, ''), ': ')
  ELSE coalesce(error, 'failed') END AS summary
FROM run_log""")
def event_activity_summary(spark, folder):
    return history.activity(run_log(spark, folder)).select("line_no", "event", "summary")


@query("event_activity_counts", f"""WITH {RUN_LOG},
n AS (SELECT count(*) FILTER (event = 'backup.failed') AS shown, count(*) AS total FROM run_log)
SELECT shown, total, shown || ' of ' || total || ' events' AS label FROM n""")
def event_activity_counts(spark, folder):
    return history.activity_counts(run_log(spark, folder), "backup", "failed")


@query("notification_outbox", f"""WITH {RUN_LOG}
SELECT line_no, profile, event, concat_ws(chr(10), '[tablekeeper] ' || CASE event
    WHEN 'backup.completed' THEN 'Backup completed' WHEN 'backup.failed' THEN 'Backup failed'
    WHEN 'restore.failed' THEN 'Restore failed'
    WHEN 'verification.completed' THEN 'Verification completed'
    WHEN 'verification.failed' THEN 'Verification failed' ELSE event END,
  'Profile: ' || profile, 'Target profile: ' || target_profile, 'DB type: ' || db_type,
  'Run ID: ' || run_id, 'Error: ' || CASE WHEN length(error) <= 400 THEN error
    ELSE error[1:397] || '...' END) AS message
FROM run_log WHERE CASE WHEN profile IN ('p0', 'p3') THEN event = 'backup.failed' ELSE
  event IN ('backup.completed', 'backup.failed', 'restore.failed', 'verification.completed',
    'verification.failed') END""")
def notification_outbox(spark, folder):
    events = run_log(spark, folder)
    own = events.select("payload.profile").distinct().filter(F.col("profile").isin("p0", "p3"))
    own = own.withColumn("events", F.array(F.lit("backup.failed")))
    return notify.outbox(events, own)


# --- backup history ------------------------------------------------------------------------------

def catalog_rows(spark, folder):
    """Catalogue rows as the scan gives them."""
    return run_catalog(spark, folder).withColumn("mtime_ms", F.col("reported_at"))


@query("run_latest", f"""WITH {RUN_CATALOG}
SELECT profile, run_id, db_type, finished_at FROM run_catalog
QUALIFY row_number() OVER (PARTITION BY profile ORDER BY finished_ms DESC, reported_at DESC,
  run_id DESC) = 1""")
def run_latest(spark, folder):
    return history.latest_runs(catalog_rows(spark, folder)).select(
        "profile", "run_id", "db_type", "finished_at"
    )


LISTED = """SELECT profile, '/backups/' || profile || '/' || run_id AS run_dir, run_id, db_type, backup_type,
  '/backups/' || profile || '/' || run_id || '/data' AS artifact_path,
  '/backups/' || profile || '/' || run_id || '/manifest.json' AS manifest_path, compression,
  strftime(make_timestamp((finished_ms - duration_ms) * 1000), '%Y-%m-%dT%H:%M:%SZ') AS started_at,
  finished_at, duration_ms
FROM run_catalog"""


def listed_rows(spark, folder):
    """Catalogue rows with their places below ``/backups`` and their start."""
    place = F.concat(F.lit("/backups/"), "profile", F.lit("/"), "run_id")
    start = F.timestamp_millis(F.col("finished_ms") - F.col("duration_ms"))
    return catalog_rows(spark, folder).withColumns({
        "run_dir": place, "artifact_path": F.concat(place, F.lit("/data")),
        "manifest_path": F.concat(place, F.lit("/manifest.json")),
        "started_at": F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    })


@query("run_history", f"""WITH {RUN_CATALOG}
{LISTED} ORDER BY finished_ms DESC, profile, run_id""")
def run_history(spark, folder):
    return history.backup_history(listed_rows(spark, folder))


@query("run_history_profile", f"""WITH {RUN_CATALOG}
{LISTED} WHERE profile = 'p2' ORDER BY finished_ms DESC, profile, run_id LIMIT 25""")
def run_history_profile(spark, folder):
    return history.backup_history(listed_rows(spark, folder), "p2", 25)
