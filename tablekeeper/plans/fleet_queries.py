"""Queries over reports, servers, alerts, tokens, audit and keyed tables."""

from pyspark.sql import functions as F

from tablekeeper.operators import alerts, audit, fleet, ingest, keyed
from tablekeeper.plans.fixtures import (
    AS_OF_MS, DAY_MS, MAX_AGE_MS, PRESENTED, RAW_REPORTS, RECEIVED, TOKENS,
    presented, raw_reports, received_reports, run_reports, tokens,
)
from tablekeeper.plans.registry import query
from tablekeeper.session import work_dir

FLEET = RECEIVED + """,
servers AS (
  SELECT server_id AS id, arg_max(server_name, reported_at * 1000000 + seq) AS name,
    max(reported_at) AS last_seen_at, min(reported_at) AS created_at
  FROM received GROUP BY server_id
),
runs AS (
  SELECT * FROM received
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY reported_at, seq) = 1
),
per_server AS (
  SELECT server_id, count(*) AS run_count, max(reported_at) AS last_reported,
    max(reported_at) FILTER (status = 'success') AS last_success,
    max(struct_pack(at := reported_at, run := run_id, status := status, finished := finished_at)) AS newest
  FROM runs GROUP BY server_id
),
overview AS (
  SELECT id, name, last_seen_at, newest.status AS last_status, newest.finished AS last_finished,
    last_reported, last_success, coalesce(run_count, 0) AS run_count
  FROM servers LEFT JOIN per_server ON server_id = id
)"""


def state_sql(success, status, now):
    return (
        f"CASE WHEN {success} IS NULL OR {now} - {success} > {MAX_AGE_MS} THEN 'overdue'"
        f" WHEN {status} = 'failed' THEN 'failing' ELSE 'ok' END"
    )


def _tables(spark, folder):
    received = received_reports(spark, folder)
    return ingest.servers_of(received), ingest.first_reports(received)


def _overview(spark, folder):
    return fleet.fleet_overview(*_tables(spark, folder))


@query("table_counts", f"""WITH {FLEET}
SELECT (SELECT count(*) FROM servers) AS servers, (SELECT count(*) FROM runs) AS runs""")
def table_counts(spark, folder):
    return fleet.table_counts(*_tables(spark, folder))


NORMALISED = RAW_REPORTS + """,
normalised AS (
  SELECT seq, k, reported_at, server_id, coalesce(server_name, server_id) AS server_name,
    coalesce(run_id, server_id || ':' || coalesce(profile, 'None') || ':'
      || coalesce(finished_at, 'None')) AS run_id,
    profile, db_type, coalesce(backup_type, 'full') AS backup_type, status,
    TRY_CAST(size_bytes AS BIGINT) AS size_bytes, TRY_CAST(duration_ms AS BIGINT) AS duration_ms,
    started_at, finished_at, error
  FROM raw_reports
)"""


@query("report_normalise", f"WITH {NORMALISED} SELECT * FROM normalised")
def report_normalise(spark, folder):
    return ingest.normalise(raw_reports(spark, folder))


REASONS_SQL = """concat_ws('; ',
  CASE WHEN coalesce(length(backup_type), 0) NOT BETWEEN 1 AND 50 THEN 'backup_type: length' END,
  CASE WHEN coalesce(length(db_type), 0) NOT BETWEEN 1 AND 50 THEN 'db_type: length' END,
  CASE WHEN duration_ms < 0 THEN 'duration_ms: negative' END,
  CASE WHEN length(error) > 2000 THEN 'error: length' END,
  CASE WHEN length(finished_at) > 100 THEN 'finished_at: length' END,
  CASE WHEN coalesce(length(profile), 0) NOT BETWEEN 1 AND 200 THEN 'profile: length' END,
  CASE WHEN coalesce(length(run_id), 0) NOT BETWEEN 1 AND 200 THEN 'run_id: length' END,
  CASE WHEN size_bytes < 0 THEN 'size_bytes: negative' END,
  CASE WHEN status NOT IN ('success', 'failed') OR status IS NULL THEN 'status: value' END)"""


@query("report_validate", f"""WITH {NORMALISED}
SELECT seq, run_id, {REASONS_SQL} AS reasons FROM normalised""")
def report_validate(spark, folder):
    checked = ingest.with_reasons(ingest.normalise(raw_reports(spark, folder)))
    return checked.select("seq", "run_id", F.array_join("reasons", "; ").alias("reasons"))


@query("report_quarantine", f"""WITH {NORMALISED},
r AS (SELECT unnest(string_split({REASONS_SQL}, '; ')) AS reason FROM normalised)
SELECT reason, count(*) AS n FROM r WHERE reason <> '' GROUP BY reason""")
def report_quarantine(spark, folder):
    _, rejected = ingest.split_valid(ingest.normalise(raw_reports(spark, folder)))
    return (
        rejected.select(F.explode("reasons").alias("reason"))
        .groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    )


def _authorised(spark, folder):
    return ingest.authorise(presented(spark, folder), tokens(spark, folder))


AUTH = f"""{PRESENTED},
{TOKENS},
auth AS (
  SELECT p.*, t.id AS token_id FROM presented p
  LEFT JOIN tokens t ON t.token_hash = sha256(p.token) AND t.revoked_at IS NULL
)"""


@query("token_accept", f"""WITH {AUTH}
SELECT seq, run_id, server_id, token_id FROM auth WHERE token_id IS NOT NULL""")
def token_accept(spark, folder):
    return _authorised(spark, folder).filter("authorised").select(
        "seq", "run_id", "server_id", "token_id"
    )


AUDIT = f"""{AUTH},
audit AS (
  SELECT seq AS id, reported_at AS at, 'ingest.unauthorized' AS event, 'agent' AS actor,
    coalesce(nullif(trim(split_part(forwarded_for, ',', 1)), ''), nullif(real_ip, ''), 'unknown')
      AS ip,
    CASE WHEN token IS NULL THEN 'missing token' ELSE 'invalid token' END AS detail
  FROM auth WHERE token_id IS NULL
)"""


@query("token_reject_audit", f"WITH {AUDIT} SELECT * FROM audit")
def token_reject_audit(spark, folder):
    return ingest.unauthorised_audit(_authorised(spark, folder))


@query("audit_recent", f"WITH {AUDIT} SELECT id, audit.at, event, actor, ip, detail FROM audit ORDER BY 2 DESC, id DESC LIMIT 100")
def audit_recent(spark, folder):
    path = work_dir(spark, "audit")
    audit.append_audit(ingest.unauthorised_audit(_authorised(spark, folder)), path)
    return audit.recent_audit(spark.read.parquet(path))


@query("token_last_used", f"""WITH {AUTH}
SELECT t.id, t.name, t.created_at, max(a.reported_at) AS last_used_at, t.revoked_at
FROM tokens t LEFT JOIN auth a ON a.token_id = t.id
GROUP BY t.id, t.name, t.created_at, t.revoked_at ORDER BY created_at DESC, t.id""")
def token_last_used(spark, folder):
    used = ingest.token_use(tokens(spark, folder), _authorised(spark, folder))
    return used.drop("token_hash").orderBy(F.desc("created_at"), "id")


@query("token_revoke", f"""WITH {TOKENS}
SELECT id, CASE WHEN id % 2 = 1 AND revoked_at IS NULL THEN {AS_OF_MS} ELSE revoked_at END
  AS revoked_at FROM tokens""")
def token_revoke(spark, folder):
    chosen = (F.col("id") % 2 == 1) & F.col("revoked_at").isNull()
    revoked = keyed.update_where(
        tokens(spark, folder), chosen, revoked_at=F.lit(AS_OF_MS).cast("bigint")
    )
    return revoked.select("id", "revoked_at")


@query("server_upsert", f"WITH {FLEET} SELECT * FROM servers")
def server_upsert(spark, folder):
    return ingest.servers_of(received_reports(spark, folder))


@query("run_insert_ignore", f"""WITH {FLEET}
SELECT run_id, server_id, server_name, profile, status, size_bytes, reported_at, error
FROM runs""")
def run_insert_ignore(spark, folder):
    return ingest.first_reports(received_reports(spark, folder)).select(
        "run_id", "server_id", "server_name", "profile", "status", "size_bytes", "reported_at",
        "error",
    )


@query("run_id_clashes", f"""WITH {RECEIVED},
named AS (SELECT server_id, profile || '-' || size_bytes AS run_id FROM received)
SELECT run_id, count(DISTINCT server_id) AS n_servers FROM named
GROUP BY run_id HAVING count(DISTINCT server_id) > 1""")
def run_id_clashes(spark, folder):
    # senders that name their runs by profile and size meet each other's names
    name = F.concat_ws("-", "profile", "size_bytes")
    named = received_reports(spark, folder).select("server_id", name.alias("run_id"))
    return ingest.clashing_run_ids(named)


@query("fleet_overview", f"WITH {FLEET} SELECT * FROM overview ORDER BY last_seen_at DESC, id")
def fleet_overview(spark, folder):
    return fleet.newest_first(_overview(spark, folder))


@query("server_health", f"""WITH {FLEET}
SELECT id, name, last_reported, last_status, last_success FROM overview""")
def server_health(spark, folder):
    return fleet.server_health(*_tables(spark, folder))


@query("server_lookup", f"WITH {FLEET} SELECT * FROM overview WHERE id = 'srv-7'")
def server_lookup(spark, folder):
    return fleet.server_lookup(*_tables(spark, folder), "srv-7")


@query("server_runs", f"""WITH {FLEET}
SELECT run_id, profile, status, reported_at FROM runs WHERE server_id = 'srv-7'
ORDER BY reported_at DESC, run_id DESC LIMIT 50""")
def server_runs(spark, folder):
    _, runs = _tables(spark, folder)
    return fleet.runs_of_server(runs, "srv-7").select("run_id", "profile", "status", "reported_at")


@query("server_runs_all", f"""WITH {FLEET},
ranked AS (SELECT *, row_number() OVER (PARTITION BY server_id
  ORDER BY reported_at DESC, run_id DESC) AS rank FROM runs)
SELECT server_id, run_id, status, reported_at, rank FROM ranked WHERE rank <= 50""")
def server_runs_all(spark, folder):
    _, runs = _tables(spark, folder)
    return fleet.runs_per_server(runs).select(
        "server_id", "run_id", "status", "reported_at", "rank"
    )


FLEET_TABLE = f"""{FLEET},
fleet_table AS (
  SELECT *, CASE WHEN run_count = 0 THEN 'none' ELSE
    {state_sql('last_success', 'last_status', AS_OF_MS)} END AS state FROM overview
)"""


def _fleet_table(spark, folder):
    now = F.lit(AS_OF_MS).cast("bigint")
    state = alerts.health_state(F.col("last_success"), F.col("last_status"), now)
    return fleet.fleet_table(_overview(spark, folder), state)


@query("fleet_table", f"WITH {FLEET_TABLE} SELECT id, name, state, run_count FROM fleet_table")
def fleet_table(spark, folder):
    return _fleet_table(spark, folder).select("id", "name", "state", "run_count")


@query("fleet_need_attention", f"""WITH {FLEET_TABLE}
SELECT count(*) AS servers, count(*) FILTER (state IN ('overdue', 'failing')) AS need_attention
FROM fleet_table""")
def fleet_need_attention(spark, folder):
    return fleet.needing_attention(_fleet_table(spark, folder))


@query("server_search", f"""WITH {FLEET_TABLE}
SELECT id, name, state FROM fleet_table WHERE contains(lower(name || ' ' || id), 'again srv-1')""")
def server_search(spark, folder):
    return fleet.search_servers(_fleet_table(spark, folder), "  AGAIN srv-1 ").select(
        "id", "name", "state"
    )


HEALTH = f"""{FLEET},
health AS (SELECT id, name, last_success, last_status,
  {state_sql('last_success', 'last_status', AS_OF_MS)} AS state FROM overview)"""


@query("health_state", f"WITH {HEALTH} SELECT id, state FROM health")
def health_state(spark, folder):
    now = F.lit(AS_OF_MS).cast("bigint")
    state = alerts.health_state(F.col("last_success"), F.col("last_status"), now)
    return fleet.server_health(*_tables(spark, folder)).select("id", state.alias("state"))


# --- alerts --------------------------------------------------------------------------------------

EARLIER_MS = AS_OF_MS - DAY_MS // 2


def _alert_table(spark, folder):
    """Alert states as a check half a day earlier left them."""
    servers, runs = _tables(spark, folder)
    past = runs.filter(F.col("reported_at") <= EARLIER_MS)
    nothing = alerts.check_history(past, EARLIER_MS, 1, 1)
    return nothing.filter(F.col("state") != "ok").select(
        "server_id", "state", F.col("checked_at").alias("since")
    )


def _checked(spark, folder):
    servers, runs = _tables(spark, folder)
    health = fleet.server_health(servers, runs)
    return alerts.check(health, _alert_table(spark, folder), AS_OF_MS)


CHECKED = f"""{FLEET},
past AS (SELECT server_id AS id,
    max(reported_at) FILTER (status = 'success') AS s,
    arg_max(status, reported_at) AS st
  FROM runs WHERE reported_at <= {EARLIER_MS} GROUP BY server_id),
stored AS (SELECT id, {state_sql('s', 'st', EARLIER_MS)} AS state FROM past),
checked AS (
  SELECT o.id, o.name, o.last_success, {AS_OF_MS} AS checked_at,
    coalesce(stored.state, 'ok') AS previous,
    {state_sql('o.last_success', 'o.last_status', AS_OF_MS)} AS state
  FROM overview o LEFT JOIN stored ON stored.id = o.id AND stored.state <> 'ok'
),
kinds AS (SELECT *, CASE WHEN state <> 'ok' AND previous = 'ok' THEN 'problem'
  WHEN state = 'ok' AND previous <> 'ok' THEN 'recovered' END AS kind FROM checked)"""


@query("alert_check", f"WITH {CHECKED} SELECT id, previous, state, kind FROM kinds")
def alert_check(spark, folder):
    return _checked(spark, folder).select("id", "previous", "state", "kind")


@query("alert_table_update", f"""WITH {CHECKED}
SELECT id AS server_id, state,
  CASE WHEN state <> previous THEN {AS_OF_MS} ELSE {EARLIER_MS} END AS since
FROM kinds WHERE state <> previous OR previous <> 'ok'""")
def alert_table_update(spark, folder):
    updates = alerts.state_updates(_checked(spark, folder))
    return keyed.upsert(
        _alert_table(spark, folder), updates, ["server_id"], ["state", "since"]
    )


FIRST_CHECK_MS = 1704099600000  # 2024-01-01 09:00 UTC
CHECKS = 31

HISTORY = f"""{FLEET},
instants AS (SELECT {FIRST_CHECK_MS} + i * {DAY_MS} AS checked_at FROM range({CHECKS}) t(i)),
at_check AS (
  SELECT r.server_id, i.checked_at,
    max(reported_at) FILTER (status = 'success') AS last_success,
    arg_max(status, reported_at * 1000000 + seq) AS last_status
  FROM runs r JOIN instants i ON r.reported_at <= i.checked_at GROUP BY r.server_id, i.checked_at
),
states AS (SELECT *, {state_sql('last_success', 'last_status', 'checked_at')} AS state FROM at_check),
steps AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY server_id ORDER BY checked_at), 'ok')
  AS previous FROM states),
history AS (SELECT *, CASE WHEN state <> 'ok' AND previous = 'ok' THEN 'problem'
  WHEN state = 'ok' AND previous <> 'ok' THEN 'recovered' END AS kind FROM steps)"""


def _history(spark, folder):
    _, runs = _tables(spark, folder)
    return alerts.check_history(runs, FIRST_CHECK_MS, DAY_MS, CHECKS)


@query("alert_history", f"""WITH {HISTORY}
SELECT server_id, checked_at, last_success, last_status, previous, state, kind FROM history""")
def alert_history(spark, folder):
    return _history(spark, folder)


def _messages(spark, folder):
    servers, _ = _tables(spark, folder)
    checked = _history(spark, folder).withColumnRenamed("server_id", "id")
    return alerts.alert_messages(checked.join(servers.select("id", "name"), "id"))


MESSAGES = f"""{HISTORY},
messages AS (
  SELECT checked_at, kind, id, s.name || ' (' || id || ')' || CASE state
    WHEN 'overdue' THEN ': no recent successful backup — ' || CASE WHEN last_success IS NULL
      THEN 'never succeeded' ELSE 'last success ' || ((checked_at - last_success) // 3600000)
      || 'h ago' END
    WHEN 'failing' THEN ': latest backup FAILED'
    ELSE ': recovered — backups healthy again' END AS message
  FROM history h JOIN servers s ON s.id = h.server_id WHERE kind IS NOT NULL
)"""


@query("alert_messages", f"WITH {MESSAGES} SELECT * FROM messages")
def alert_messages(spark, folder):
    return _messages(spark, folder)


@query("alert_digest_subjects", f"""WITH {MESSAGES},
n AS (SELECT checked_at, count(*) FILTER (kind = 'problem') AS problems,
  count(*) FILTER (kind = 'recovered') AS recovered FROM messages GROUP BY checked_at)
SELECT *, 'tablekeeper: ' || problems || ' alert(s), ' || recovered || ' recovered' AS subject
FROM n""")
def alert_digest_subjects(spark, folder):
    return alerts.digest_subjects(_messages(spark, folder))


@query("alert_digest_pages", f"""WITH {MESSAGES},
n AS (SELECT *, (row_number() OVER (PARTITION BY checked_at, kind ORDER BY id) - 1) // 20 AS page
  FROM messages)
SELECT checked_at, kind, page,
  CASE kind WHEN 'problem' THEN 'Backup problems:' ELSE 'Recovered:' END || chr(10)
    || string_agg(message, chr(10) ORDER BY id) AS body
FROM n GROUP BY checked_at, kind, page""")
def alert_digest_pages(spark, folder):
    return alerts.digest_pages(_messages(spark, folder), lines=20)


@query("alert_digest_bodies", f"""WITH {MESSAGES},
body_lines AS (
  SELECT checked_at, CASE kind WHEN 'problem' THEN 1 ELSE 4 END AS section, id, message FROM messages
  UNION ALL SELECT DISTINCT checked_at, 0, NULL, 'Backup problems:' FROM messages WHERE kind = 'problem'
  UNION ALL SELECT DISTINCT checked_at, 3, NULL, 'Recovered:' FROM messages WHERE kind = 'recovered'
  UNION ALL SELECT checked_at, 2, NULL, '' FROM messages GROUP BY checked_at HAVING count(DISTINCT kind) = 2),
n AS (SELECT *, row_number() OVER (PARTITION BY checked_at ORDER BY section, id) AS line FROM body_lines)
SELECT checked_at, (line - 1) // 25 AS page, string_agg(message, chr(10) ORDER BY line) AS body
FROM n GROUP BY ALL""")
def alert_digest_bodies(spark, folder):
    """Whole mail texts with both sections."""
    return alerts.digest_bodies(_messages(spark, folder), lines=25)


# --- keyed tables --------------------------------------------------------------------------------

KEYED = RECEIVED + """,
old AS (SELECT server_id AS id, arg_max(server_name, reported_at) AS name,
    max(reported_at) AS last_seen_at, min(reported_at) AS created_at
  FROM received WHERE seq >= 0 AND status = 'success' GROUP BY server_id),
new AS (SELECT server_id AS id, arg_max(server_name, reported_at) AS name,
    max(reported_at) AS last_seen_at, min(reported_at) AS created_at
  FROM received WHERE seq < 0 OR k < 3 GROUP BY server_id)"""


def _old_new(spark, folder):
    received = received_reports(spark, folder)
    old = ingest.servers_of(received.filter((F.col("seq") >= 0) & (F.col("status") == "success")))
    return old, ingest.servers_of(received.filter((F.col("seq") < 0) | (F.col("k") < 3)))


@query("keyed_upsert", f"""WITH {KEYED}
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.name ELSE n.name END AS name,
  CASE WHEN n.id IS NULL THEN o.last_seen_at ELSE n.last_seen_at END AS last_seen_at,
  CASE WHEN o.id IS NULL THEN n.created_at ELSE o.created_at END AS created_at
FROM old o FULL JOIN new n ON o.id = n.id""")
def keyed_upsert(spark, folder):
    return keyed.upsert(*_old_new(spark, folder), ["id"], ["name", "last_seen_at"])


@query("keyed_insert_ignore", f"""WITH {KEYED}
SELECT id, name, last_seen_at, created_at FROM new
UNION ALL SELECT id, name, last_seen_at, created_at FROM old WHERE id NOT IN (SELECT id FROM new)""")
def keyed_insert_ignore(spark, folder):
    old, new = _old_new(spark, folder)
    return keyed.insert_ignore(new, old, ["id"])


@query("keyed_update_delete", f"""WITH {KEYED}
SELECT id, CASE WHEN created_at > 1704153600000 THEN 'late' ELSE name END AS name,
  last_seen_at, created_at
FROM old WHERE id NOT IN (SELECT server_id FROM received WHERE status = 'failed' AND k < 3)""")
def keyed_update_delete(spark, folder):
    old, _ = _old_new(spark, folder)
    changed = keyed.update_where(old, F.col("created_at") > 1704153600000, name=F.lit("late"))
    gone = (
        received_reports(spark, folder)
        .filter((F.col("status") == "failed") & (F.col("k") < 3))
        .select(F.col("server_id").alias("id")).distinct()
    )
    return keyed.delete_keys(changed, gone, ["id"])
