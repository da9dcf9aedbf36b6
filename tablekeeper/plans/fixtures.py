"""Inputs of the registered queries, derived from the driver's tables.

Each builder has an SQL twin (a CTE text) so that both engines start from the same rows.
"""

from pyspark.sql import functions as F

from tablekeeper.sources.event_log import PAYLOAD_FIELDS

AS_OF_MS = 1706659200000  # 2024-01-31 00:00:00 UTC
HOUR_MS = 3_600_000
MAX_AGE_MS = 26 * HOUR_MS
DAY_MS = 24 * HOUR_MS
SALT = "fixed-salt"


def load(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def k_of_props():
    return F.get_json_object("props", "$.k").cast("int")


K_SQL = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
CLOCK = "HH:mm:ss yyyy-MM-dd"
CLOCK_SQL = "'%H:%M:%S %Y-%m-%d'"


# --- run reports ---------------------------------------------------------------------------------

def run_reports(spark, folder):
    """One backup report per event."""
    k = F.col("k")
    ts = F.col("ts").cast("timestamp")
    db = F.get(F.array(*[F.lit(x) for x in ("postgres", "mysql", "mongo", "sqlite")]), k % 4)
    mode = (
        F.when(F.col("event_type") == "signup", "full")
        .when(F.col("event_type") == "view", "differential")
        .otherwise("incremental")
    )
    failed = F.col("event_type") == "error"
    return (
        load(spark, folder, "events")
        .withColumn("k", k_of_props())
        .select(
            F.col("event_id").alias("seq"),
            F.concat(F.lit("r"), F.col("event_id")).alias("run_id"),
            F.concat(F.lit("srv-"), F.col("user_id")).alias("server_id"),
            F.concat(F.lit("Server "), F.col("user_id")).alias("server_name"),
            F.concat(F.lit("p"), k % 5).alias("profile"),
            db.alias("db_type"),
            mode.alias("backup_type"),
            mode.alias("requested_mode"),
            F.when(F.col("event_type") == "signup", "gzip").otherwise("chunked").alias("compression"),
            F.when(failed, "failed").otherwise("success").alias("status"),
            F.floor(F.col("value") * 1000).alias("size_bytes"),
            F.floor(F.col("value") * 100).alias("duration_ms"),
            F.date_format(ts, CLOCK).alias("finished_at"),
            (F.unix_seconds(ts) * 1000).alias("finished_ms"),
            F.unix_millis(ts).alias("reported_at"),
            F.when(failed, F.concat(F.lit("k="), k)).alias("error"),
            k.alias("k"),
        )
    )


RUN_REPORTS = f"""
run_reports AS (
  SELECT event_id AS seq, 'r' || event_id AS run_id, 'srv-' || user_id AS server_id,
    'Server ' || user_id AS server_name, 'p' || (k % 5) AS profile,
    CASE k % 4 WHEN 0 THEN 'postgres' WHEN 1 THEN 'mysql' WHEN 2 THEN 'mongo' ELSE 'sqlite' END
      AS db_type,
    CASE event_type WHEN 'signup' THEN 'full' WHEN 'view' THEN 'differential'
      ELSE 'incremental' END AS backup_type,
    CASE event_type WHEN 'signup' THEN 'full' WHEN 'view' THEN 'differential'
      ELSE 'incremental' END AS requested_mode,
    CASE event_type WHEN 'signup' THEN 'gzip' ELSE 'chunked' END AS compression,
    CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END AS status,
    CAST(floor(value * 1000) AS BIGINT) AS size_bytes,
    CAST(floor(value * 100) AS BIGINT) AS duration_ms,
    strftime(ts, {CLOCK_SQL}) AS finished_at,
    (epoch_us(ts) // 1000000) * 1000 AS finished_ms,
    epoch_us(ts) // 1000 AS reported_at,
    CASE event_type WHEN 'error' THEN 'k=' || k END AS error, k
  FROM (SELECT *, {K_SQL} AS k FROM events)
)"""


def run_catalog(spark, folder):
    """Stored runs: a failed run leaves no manifest."""
    return run_reports(spark, folder).filter(F.col("status") == "success")


RUN_CATALOG = RUN_REPORTS + ",\nrun_catalog AS (SELECT * FROM run_reports WHERE status = 'success')"


def received_reports(spark, folder):
    """The feed as it arrives: reports, then clicks' reports again an hour later, status flipped."""
    first = run_reports(spark, folder)
    again = (
        first.filter((F.col("requested_mode") == "incremental") & (F.col("status") == "success"))
        .withColumn("status", F.lit("failed"))
        .withColumn("server_name", F.concat("server_name", F.lit(" again")))
        .withColumn("reported_at", F.col("reported_at") + HOUR_MS)
        .withColumn("seq", -F.col("seq") - 1)
    )
    return first.unionByName(again)


RECEIVED = RUN_REPORTS + f""",
received AS (
  SELECT * FROM run_reports
  UNION ALL BY NAME
  SELECT * REPLACE ('failed' AS status, server_name || ' again' AS server_name,
    reported_at + {HOUR_MS} AS reported_at, -seq - 1 AS seq)
  FROM run_reports WHERE requested_mode = 'incremental' AND status = 'success'
)"""


def raw_reports(spark, folder):
    """Unchecked reports as senders give them: missing names and ids, bad values by ``k``."""
    k = F.col("k")
    return run_reports(spark, folder).select(
        "seq", "k", "reported_at",
        "server_id",
        F.when(k >= 10, F.col("server_name")).alias("server_name"),
        F.when(k != 11, F.col("run_id")).alias("run_id"),
        F.when(k == 0, "").otherwise(F.col("profile")).alias("profile"),
        F.when(k == 12, F.lit(None).cast("string")).otherwise(F.col("db_type")).alias("db_type"),
        F.when(F.col("backup_type") != "full", F.col("backup_type")).alias("backup_type"),
        F.when(k == 1, "unknown").otherwise(F.col("status")).alias("status"),
        F.when(k == 2, F.concat(F.lit("-"), F.col("size_bytes") + 1))
        .when(k == 3, "many").otherwise(F.col("size_bytes").cast("string")).alias("size_bytes"),
        F.col("duration_ms").cast("string").alias("duration_ms"),
        F.lit(None).cast("string").alias("started_at"),
        F.when(k != 13, F.col("finished_at")).alias("finished_at"),
        F.when(k == 4, F.repeat(F.lit("x"), 2001)).otherwise(F.col("error")).alias("error"),
    )


RAW_REPORTS = RUN_REPORTS + """,
raw_reports AS (
  SELECT seq, k, reported_at, server_id,
    CASE WHEN k >= 10 THEN server_name END AS server_name,
    CASE WHEN k <> 11 THEN run_id END AS run_id,
    CASE WHEN k = 0 THEN '' ELSE profile END AS profile,
    CASE WHEN k <> 12 THEN db_type END AS db_type,
    CASE WHEN backup_type <> 'full' THEN backup_type END AS backup_type,
    CASE WHEN k = 1 THEN 'unknown' ELSE status END AS status,
    CASE WHEN k = 2 THEN '-' || (size_bytes + 1) WHEN k = 3 THEN 'many'
      ELSE CAST(size_bytes AS VARCHAR) END AS size_bytes,
    CAST(duration_ms AS VARCHAR) AS duration_ms,
    CAST(NULL AS VARCHAR) AS started_at,
    CASE WHEN k <> 13 THEN finished_at END AS finished_at,
    CASE WHEN k = 4 THEN repeat('x', 2001) ELSE error END AS error
  FROM run_reports
)"""


# --- run log -------------------------------------------------------------------------------------

# The event name each kind of event stands for, by range of k.
EVENT_NAMES = {
    "signup": ("backup.started", "scheduled_cycle.started", "restore.started"),
    "purchase": ("backup.completed", "scheduled_cycle.completed", "restore.completed"),
    "error": ("backup.failed", "scheduled_cycle.failed", "restore.failed"),
    "click": ("verification.completed", "notification.failed", "retention.deleted"),
    "view": ("verification.failed", "verification.started", "notification.sent"),
}


def _event_name():
    name = F.lit(None).cast("string")
    for kind, (common, eighties, nineties) in EVENT_NAMES.items():
        pick = (
            F.when(F.col("k") >= 90, nineties).when(F.col("k") >= 80, eighties).otherwise(common)
        )
        name = F.when(F.col("event_type") == kind, pick).otherwise(name)
    return name


def _event_name_sql():
    rows = " ".join(
        f"WHEN '{kind}' THEN CASE WHEN k >= 90 THEN '{c}' WHEN k >= 80 THEN '{b}' ELSE '{a}' END"
        for kind, (a, b, c) in EVENT_NAMES.items()
    )
    return f"CASE event_type {rows} END"


def log_records(spark, folder):
    """Run-log records in file order (``line_no``), payload as a struct."""
    k = F.col("k")
    ts = F.col("ts").cast("timestamp")
    profile = F.concat(F.lit("p"), k % 5)
    other = F.concat(F.lit("p"), (k + 1) % 5)
    checks = F.col("event").startswith("verification.")
    failed = F.col("event").endswith(".failed")
    payload = F.struct(
        F.when(k % 3 == 0, "slack").alias("channel"),
        F.when(k % 4 != 0, "chunked").alias("compression"),
        F.when(k % 6 != 0, "postgres").alias("db_type"),
        F.when(F.col("event") == "backup.completed", F.floor(F.col("value") * 100))
        .alias("duration_ms"),
        F.when(failed & (k % 7 != 0), F.concat(F.lit("k="), k, F.repeat(F.lit(" e"), k * 4)))
        .alias("error"),
        F.when(k % 2 == 0, "backup.failed").alias("event"),
        profile.alias("profile"),
        F.when(checks, F.array(profile, other)).alias("profiles"),
        F.when(F.col("event") == "restore.started", F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))))
        .alias("restore_selection"),
        F.when(k % 9 == 0, 2).alias("retention_deleted_count"),
        F.concat(F.lit("r"), F.col("event_id")).alias("run_id"),
        F.when(checks, other).alias("target_profile"),
        F.when(k % 2 == 0, "ok").alias("verification_status"),
    )
    return (
        load(spark, folder, "events")
        .withColumn("k", k_of_props())
        .withColumn("event", _event_name())
        .select(
            F.col("event_id").alias("line_no"),
            F.date_format(ts, CLOCK).alias("timestamp"),
            "event",
            payload.alias("payload"),
            (F.unix_seconds(ts) * 1000).alias("at_ms"),
            "k",
        )
    )


def log_lines(spark, folder):
    """The log as text lines, with blank and cut-off lines among them."""
    records = log_records(spark, folder)
    noise = records.filter(F.col("k").isin(97, 98)).select(
        "line_no", F.when(F.col("k") == 97, "").otherwise('{"event": "backup.st').alias("value")
    )
    line = F.to_json(F.struct("event", "payload", "timestamp")).alias("value")
    return records.select("line_no", line).unionAll(noise)


def run_log(spark, folder):
    """Parsed events, as ``parse_lines`` gives them for the log's lines."""
    records = log_records(spark, folder)
    known = records.schema["payload"].dataType.names
    payload = F.struct(*[
        (F.col(f"payload.{name}") if name in known else F.lit(None)).cast(kind).alias(name)
        for name, kind in PAYLOAD_FIELDS.items()
    ])
    return records.select(
        "line_no", "timestamp", "event", payload.alias("payload"),
        F.timestamp_millis("at_ms").alias("at"),
    )


RUN_LOG = f"""
run_log AS (
  SELECT event_id AS line_no, strftime(ts, {CLOCK_SQL}) AS timestamp, event,
    (epoch_us(ts) // 1000000) * 1000 AS at_ms, k,
    CASE WHEN k % 3 = 0 THEN 'slack' END AS channel,
    CASE WHEN k % 4 <> 0 THEN 'chunked' END AS compression,
    CASE WHEN k % 6 <> 0 THEN 'postgres' END AS db_type,
    CASE WHEN event = 'backup.completed' THEN CAST(floor(value * 100) AS BIGINT) END AS duration_ms,
    CASE WHEN event LIKE '%.failed' AND k % 7 <> 0 THEN 'k=' || k || repeat(' e', k * 4) END
      AS error,
    CASE WHEN k % 2 = 0 THEN 'backup.failed' END AS payload_event,
    'p' || (k % 5) AS profile,
    CASE WHEN event LIKE 'verification.%' THEN 'p' || ((k + 1) % 5) END AS other,
    CASE WHEN event = 'restore.started' AND k % 2 = 0 THEN 2 END AS n_selected,
    CASE WHEN k % 9 = 0 THEN 2 END AS retention_deleted_count,
    'r' || event_id AS run_id,
    CASE WHEN event LIKE 'verification.%' THEN 'p' || ((k + 1) % 5) END AS target_profile,
    CASE WHEN k % 2 = 0 THEN 'ok' END AS verification_status
  FROM (SELECT *, {_event_name_sql()} AS event
        FROM (SELECT *, {K_SQL} AS k FROM events))
),
log_by_profile AS (
  SELECT *, profile AS for_profile FROM run_log
  UNION ALL SELECT *, other AS for_profile FROM run_log WHERE other IS NOT NULL
)"""


# --- artifacts, texts, people --------------------------------------------------------------------

CHUNK = 4096


def artifacts(spark, folder):
    """Document texts as backup artifacts, one profile per source."""
    return load(spark, folder, "documents").select(
        F.col("doc_id").alias("run_id"),
        F.col("source").alias("profile"),
        F.col("doc_id").alias("run_seq"),
        F.encode("text", "UTF-8").alias("content"),
    )


ARTIFACTS = f"""
artifacts AS (
  SELECT doc_id AS run_id, source AS profile, doc_id AS run_seq, encode(text) AS content
  FROM documents
),
blocks AS (
  SELECT run_id, profile, run_seq, idx, sha256(data) AS hash,
    CAST(octet_length(data) AS BIGINT) AS n_bytes
  FROM (
    SELECT run_id, profile, run_seq, idx,
      content[idx * {CHUNK} + 1 : least((idx + 1) * {CHUNK}, octet_length(content))] AS data
    FROM (SELECT *, unnest(range(CAST((octet_length(content) + {CHUNK} - 1) // {CHUNK} AS BIGINT)))
            AS idx FROM artifacts)
  )
),
firsts AS (
  SELECT profile, hash, min(run_seq * 1000000 + idx) AS place, min(n_bytes) AS n_bytes
  FROM blocks GROUP BY profile, hash
)"""


def secret_texts(spark, folder):
    """Document texts with planted passwords (the driver's texts hold none of these forms)."""
    n = F.col("doc_id")
    return load(spark, folder, "documents").select(
        "doc_id",
        "source",
        F.concat(
            F.col("text"), F.lit(" password=s"), n, F.lit("&x postgres://u:pw"), n,
            F.lit("@h --password z"), n,
        ).alias("text"),
    )


SECRET_TEXTS = """
secret_texts AS (
  SELECT doc_id, source, text || ' password=s' || doc_id || '&x postgres://u:pw' || doc_id
    || '@h --password z' || doc_id AS text
  FROM documents
)"""


def people(spark, folder):
    """Customers with an email (some unknown), a name and a phone."""
    key = F.col("c_custkey")
    email = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@corp.test"))
    return load(spark, folder, "customer").select(
        "c_custkey",
        F.when(key % 10 != 0, email).alias("email"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("555-"), key).alias("phone"),
        "c_mktsegment",
        "c_nationkey",
    )


PEOPLE = """
people AS (
  SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN lower(replace(c_name, '#', '.'))
      || '@corp.test' END AS email,
    c_name AS name, '555-' || c_custkey AS phone, c_mktsegment, c_nationkey
  FROM customer
)"""


def tokens(spark, folder):
    """One agent token per user, some revoked."""
    user = F.col("user_id")
    return (
        load(spark, folder, "events").groupBy("user_id")
        .agg(F.min(F.unix_millis(F.col("ts").cast("timestamp"))).alias("created_at"))
        .select(
            user.alias("id"),
            F.concat(F.lit("token "), user).alias("name"),
            F.sha2(F.concat(F.lit("tok-"), user), 256).alias("token_hash"),
            "created_at",
            F.lit(None).cast("bigint").alias("last_used_at"),
            F.when(user % 7 == 0, F.col("created_at") + 1).alias("revoked_at"),
        )
    )


TOKENS = """
tokens AS (
  SELECT user_id AS id, 'token ' || user_id AS name, sha256('tok-' || user_id) AS token_hash,
    min(epoch_us(ts) // 1000) AS created_at, CAST(NULL AS BIGINT) AS last_used_at,
    CASE WHEN user_id % 7 = 0 THEN min(epoch_us(ts) // 1000) + 1 END AS revoked_at
  FROM events GROUP BY user_id
)"""


def presented(spark, folder):
    """Reports with the token and the address headers they came with."""
    user = F.substring("server_id", 5, 20)
    k = F.col("k")
    return run_reports(spark, folder).select(
        "*",
        F.when(k % 33 != 0, F.concat(F.lit("tok-"), user)).alias("token"),
        F.when(k % 3 == 0, F.concat(F.lit(" 10.0.0."), k, F.lit(" , 10.9.9.9")))
        .when(k % 3 == 1, "").alias("forwarded_for"),
        F.when(k % 2 == 0, F.concat(F.lit("192.168.0."), k)).alias("real_ip"),
    )


PRESENTED = RUN_REPORTS + """,
presented AS (
  SELECT *, CASE WHEN k % 33 <> 0 THEN 'tok-' || substr(server_id, 5) END AS token,
    CASE k % 3 WHEN 0 THEN ' 10.0.0.' || k || ' , 10.9.9.9' WHEN 1 THEN '' END AS forwarded_for,
    CASE WHEN k % 2 = 0 THEN '192.168.0.' || k END AS real_ip
  FROM run_reports
)"""

# Retention settings of the profiles, over the default.
DEFAULT_POLICY = {"keep_last": 3}
PROFILE_POLICIES = [
    {"profile": "p1", "keep_last": None, "max_age_days": 7},
    {"profile": "p2", "keep_last": 5, "max_age_days": None},
]
POLICIES = """
policies AS (
  SELECT profile,
    CASE profile WHEN 'p2' THEN 5 ELSE 3 END AS keep_last,
    CASE profile WHEN 'p1' THEN 7 END AS max_age_days
  FROM (SELECT DISTINCT profile FROM run_reports)
)"""
