"""Queries over manifests, lineage and retention."""

from pyspark.sql import functions as F

from tablekeeper.operators import history, ingest, lineage, retention
from tablekeeper.plans import chunk_queries
from tablekeeper.plans.chunk_queries import FILES, SURVIVING, text_files
from tablekeeper.plans.fixtures import (
    AS_OF_MS, DAY_MS, DEFAULT_POLICY, POLICIES, PROFILE_POLICIES, RECEIVED, RUN_CATALOG, RUN_LOG,
    RUN_REPORTS, received_reports, run_log, run_reports,
)
from tablekeeper.plans.history_queries import BACKUP, RANKED, VERIFICATION, catalog_rows, outcome_sql
from tablekeeper.plans.registry import query
from tablekeeper.session import work_dir
from tablekeeper.sources import catalogue, event_log, files

GROUP = ["server_id", "profile"]


@query("manifest_write_scan", f"""WITH {RUN_CATALOG}
SELECT run_id, profile, db_type, backup_type, compression, finished_at, duration_ms, finished_ms,
  '/backups/' || profile || '/' || run_id || '/data' AS artifact_path
FROM run_catalog""")
def manifest_write_scan(spark, folder):
    root = work_dir(spark, "manifests")
    path = catalogue.artifact_path("/backups/", F.col("profile"), F.col("run_id"), F.lit("data"))
    runs = catalog_rows(spark, folder)
    catalogue.write_manifests(runs.withColumn("artifact_path", path), root)
    # an unreadable manifest and one without a finish time do not show up
    bad = runs.filter(F.col("k") == 5).select(
        "profile", F.when(F.col("seq") % 2 == 0, '{"run_id": "cut').otherwise('{"run_id": "x"}')
    )
    bad.write.mode("append").partitionBy("profile").text(root)
    return catalogue.scan_manifests(spark, root).select(
        "run_id", "profile", "db_type", "backup_type", "compression", "finished_at", "duration_ms",
        "finished_ms", "artifact_path",
    )


@query("storage_inventory", f"""WITH {FILES}
SELECT profile, count(*) AS files, CAST(sum(octet_length(content)) AS BIGINT) AS bytes
FROM file_texts GROUP BY profile""")
def storage_inventory(spark, folder):
    return files.inventory(spark, text_files(spark, folder))


ORDERED = "OVER (PARTITION BY server_id, profile ORDER BY finished_ms, reported_at, run_id"
LINEAGE = f"""{RUN_CATALOG},
ordered AS (
  SELECT *, row_number() {ORDERED}) AS n, lag(run_id) {ORDERED}) AS previous,
    first_value(run_id) {ORDERED}) AS first_id
  FROM run_catalog WHERE compression = 'chunked'
),
typed AS (
  SELECT *, CASE WHEN n = 1 THEN 'full' ELSE requested_mode END AS effective,
    CASE WHEN n = 1 THEN NULL WHEN requested_mode = 'differential' THEN first_id
      ELSE previous END AS parent_run_id
  FROM ordered
),
stretches AS (
  SELECT *, max(CASE WHEN effective <> 'incremental' THEN n END) {ORDERED}) AS anchor_n
  FROM typed
),
lineage AS (
  SELECT s.*, a.run_id AS anchor_id, s.n - s.anchor_n AS position,
    s.n - s.anchor_n + CASE a.effective WHEN 'full' THEN 0 ELSE 1 END AS depth
  FROM stretches s JOIN stretches a
    ON a.server_id = s.server_id AND a.profile = s.profile AND a.n = s.anchor_n
)"""


def _lineage(spark, folder):
    return lineage.lineage(catalog_rows(spark, folder).drop("backup_type"), GROUP)


@query("lineage_history", f"""WITH {LINEAGE}
SELECT run_id, effective AS backup_type, parent_run_id, depth, position, anchor_id,
  CASE WHEN depth > 0 THEN first_id END AS root_id FROM lineage""")
def lineage_history(spark, folder):
    return _lineage(spark, folder).select(
        "run_id", "backup_type", "parent_run_id", "depth", "position", "anchor_id", "root_id"
    )


# The chain by walking up the parents, as the definition says.
@query("lineage_latest_chains", f"""WITH RECURSIVE {LINEAGE},
latest AS (SELECT run_id, parent_run_id, depth FROM lineage
  QUALIFY row_number() OVER (PARTITION BY server_id, profile ORDER BY n DESC) = 1),
walk AS (
  SELECT run_id AS for_run, parent_run_id AS member, depth - 1 AS step FROM latest
  WHERE parent_run_id IS NOT NULL
  UNION ALL
  SELECT w.for_run, l.parent_run_id, w.step - 1 FROM walk w JOIN lineage l ON l.run_id = w.member
  WHERE l.parent_run_id IS NOT NULL
)
SELECT for_run, member, step FROM walk""")
def lineage_latest_chains(spark, folder):
    runs = _lineage(spark, folder)
    return lineage.chain_members(runs, history.latest_runs(runs, GROUP), GROUP)


@query("lineage_next_parent", f"""WITH {LINEAGE},
newest AS (SELECT server_id, profile, first_value(run_id) OVER w AS any_id,
    first_value(depth) OVER w AS any_depth, first_id
  FROM lineage WINDOW w AS (PARTITION BY server_id, profile ORDER BY n DESC)
  QUALIFY row_number() OVER w = 1),
wanted AS (SELECT DISTINCT server_id, profile, requested_mode FROM run_reports)
SELECT w.server_id, w.profile, w.requested_mode,
  CASE WHEN any_id IS NULL OR requested_mode = 'full' THEN 'full' ELSE requested_mode END
    AS backup_type,
  CASE requested_mode WHEN 'incremental' THEN any_id WHEN 'differential' THEN first_id END
    AS parent_run_id,
  coalesce(CASE requested_mode WHEN 'incremental' THEN any_depth + 1
    WHEN 'differential' THEN CASE WHEN first_id IS NOT NULL THEN 1 END END, 0) AS depth
FROM wanted w LEFT JOIN newest USING (server_id, profile)""")
def lineage_next_parent(spark, folder):
    from tablekeeper.plans.fixtures import run_reports

    wanted = run_reports(spark, folder).select(*GROUP, "requested_mode").distinct()
    new = wanted.withColumn("run_id", F.lit("next"))
    return lineage.resolve_parent(new, _lineage(spark, folder), GROUP).drop("run_id")


# --- retention -----------------------------------------------------------------------------------

def _policies(spark, folder):
    profiles = catalog_rows(spark, folder).select("profile").distinct()
    return retention.resolve_policies(profiles, PROFILE_POLICIES, DEFAULT_POLICY)


def _plan(spark, folder):
    catalog = catalog_rows(spark, folder)
    return retention.deletion_plan(catalog, _policies(spark, folder), GROUP, AS_OF_MS)


PLAN = f"""{RUN_CATALOG},
{POLICIES},
ranked AS (
  SELECT c.*, keep_last, max_age_days,
    row_number() OVER (PARTITION BY server_id, profile
      ORDER BY finished_ms DESC, reported_at DESC, run_id DESC) AS place
  FROM run_catalog c JOIN policies USING (profile)
),
flagged AS (SELECT *, place > keep_last AS by_count,
  coalesce(finished_ms < {AS_OF_MS} - max_age_days * {DAY_MS}, false) AS by_age FROM ranked),
plan AS (SELECT * FROM flagged WHERE by_count OR by_age)"""


@query("retention_policies", f"""WITH {RUN_CATALOG}, {POLICIES}
SELECT profile, CAST(keep_last AS BIGINT) AS keep_last, CAST(max_age_days AS BIGINT) AS max_age_days
FROM policies""")
def retention_policies(spark, folder):
    return _policies(spark, folder)


@query("retention_over_count", f"WITH {PLAN} SELECT run_id FROM flagged WHERE by_count")
def retention_over_count(spark, folder):
    return retention.over_count(catalog_rows(spark, folder), _policies(spark, folder), GROUP)


@query("retention_over_age", f"WITH {PLAN} SELECT run_id FROM flagged WHERE by_age")
def retention_over_age(spark, folder):
    return retention.over_age(catalog_rows(spark, folder), _policies(spark, folder), AS_OF_MS)


@query("retention_plan", f"""WITH {PLAN}
SELECT run_id, server_id, profile, CASE WHEN by_count AND by_age THEN 'keep_last,max_age_days'
  WHEN by_count THEN 'keep_last' ELSE 'max_age_days' END AS reasons FROM plan ORDER BY run_id""")
def retention_plan(spark, folder):
    ordered = retention.in_run_order(_plan(spark, folder))
    return ordered.select(
        "run_id", "server_id", "profile", F.array_join("reasons", ",").alias("reasons")
    )


@query("retention_apply", f"""WITH {PLAN}
SELECT run_id, profile, (SELECT count(*) FROM plan) AS logged FROM run_catalog
WHERE run_id NOT IN (SELECT run_id FROM plan)""")
def retention_apply(spark, folder):
    """Publish the remaining catalogue, log each deletion, read both back."""
    root, log = work_dir(spark, "catalog"), work_dir(spark, "log")
    files.publish(catalog_rows(spark, folder), root)
    left = retention.apply_retention(
        spark, root, _policies(spark, folder), GROUP, AS_OF_MS, log, "00:00:00 2024-01-31")
    logged = event_log.scan_events(spark, log).agg(F.count("payload.profile").alias("logged"))
    return left.select("run_id", "profile", logged.scalar().alias("logged"))


@query("retention_apply_resumed", f"""WITH {PLAN}
SELECT run_id, 'kept' AS part, CAST(0 AS BIGINT) AS times FROM run_catalog WHERE run_id NOT IN (SELECT run_id FROM plan)
UNION ALL SELECT run_id, 'logged', CAST(1 AS BIGINT) FROM plan""")
def retention_apply_resumed(spark, folder):
    """Two calls are cut off, after noting the plan and after logging it; the third finishes. How often each
    deletion is in the log, beside the runs kept."""
    root, log = work_dir(spark, "catalog"), work_dir(spark, "log")
    files.publish(catalog_rows(spark, folder), root)
    path = retention.note_intent(_plan(spark, folder), root, "00:00:00 2024-01-31")
    if path is not None:
        retention.log_intent(spark, path, log)
        retention.publish_intent(spark, path, root)
    left = retention.apply_retention(
        spark, root, _policies(spark, folder), GROUP, AS_OF_MS, log, "00:00:00 2024-01-31")
    logged = event_log.scan_events(spark, log).groupBy(
        F.get_json_object("payload_json", "$.run_dir").alias("run_id")).agg(F.count(F.lit(1)).alias("times"))
    return left.select("run_id", F.lit("kept").alias("part"), F.lit(0).cast("bigint").alias("times")).unionByName(
        logged.select("run_id", F.lit("logged").alias("part"), "times"))


SUMMARY = f"""{PLAN},
totals AS (SELECT profile, count(*) AS total_runs FROM run_catalog GROUP BY profile),
pending AS (SELECT profile, count(*) AS n FROM plan GROUP BY profile),
retention_summary AS (SELECT profile, true AS configured, CAST(keep_last AS BIGINT) AS keep_last,
  CAST(max_age_days AS BIGINT) AS max_age_days, total_runs, coalesce(n, 0) AS pending_deletions
FROM totals JOIN policies USING (profile) LEFT JOIN pending USING (profile))"""


def _summary(spark, folder):
    return retention.policy_summary(
        catalog_rows(spark, folder), _policies(spark, folder), _plan(spark, folder)
    )


@query("retention_summary", f"WITH {SUMMARY} SELECT * FROM retention_summary")
def retention_summary(spark, folder):
    return _summary(spark, folder)


# Plain definition: a remaining run whose chain, walked up the parents, meets a deleted run.
@query("lineage_broken_chains", f"""WITH RECURSIVE {PLAN},
{LINEAGE.split(RUN_CATALOG + ',', 1)[1]},
walk AS (
  SELECT run_id AS for_run, parent_run_id AS member, 1 AS step FROM lineage
  WHERE parent_run_id IS NOT NULL AND run_id NOT IN (SELECT run_id FROM plan)
  UNION ALL
  SELECT w.for_run, l.parent_run_id, w.step + 1 FROM walk w JOIN lineage l ON l.run_id = w.member
  WHERE l.parent_run_id IS NOT NULL AND w.member NOT IN (SELECT run_id FROM plan)
)
SELECT l.server_id, l.profile, l.run_id, l.depth, w.member AS nearest_missing
FROM walk w JOIN lineage l ON l.run_id = w.for_run
WHERE w.member IN (SELECT run_id FROM plan)""")
def lineage_broken_chains(spark, folder):
    return lineage.broken_chains(_lineage(spark, folder), _plan(spark, folder), GROUP)


# --- status --------------------------------------------------------------------------------------

@query("profile_status_board", f"""WITH {SUMMARY},
{RUN_LOG}, {RANKED.split(RUN_LOG + ',', 1)[1]},
last AS (SELECT profile, run_id, finished_at FROM run_catalog
  QUALIFY row_number() OVER (PARTITION BY profile ORDER BY finished_ms DESC, reported_at DESC,
    run_id DESC) = 1),
b AS ({outcome_sql(*BACKUP)}),
v AS ({outcome_sql(*VERIFICATION)})
SELECT s.profile, CASE WHEN s.profile <> 'p4' THEN s.profile || '-check' END AS target_profile,
  s.profile <> 'p4' AS verification_configured,
  last.run_id AS last_run_id, last.finished_at AS last_finished_at,
  b.status AS backup_status, b.timestamp AS backup_at, v.status AS verification_status,
  v.timestamp AS verification_at, configured, keep_last, max_age_days, total_runs,
  pending_deletions
FROM retention_summary s LEFT JOIN last USING (profile)
LEFT JOIN b ON b.for_profile = s.profile LEFT JOIN v ON v.for_profile = s.profile""")
def profile_status_board(spark, folder):
    catalog, events = catalog_rows(spark, folder), run_log(spark, folder)
    target = F.when(F.col("profile") != "p4", F.concat("profile", F.lit("-check")))
    profiles = catalog.select("profile").distinct().withColumn("target_profile", target)
    return history.status_board(
        profiles, history.latest_runs(catalog), history.latest_outcome(events, *BACKUP),
        history.latest_outcome(events, *VERIFICATION), _summary(spark, folder),
    )


@query("check_rollup", f"""WITH {PLAN},
old AS (SELECT profile, count(*) AS n FROM plan GROUP BY profile),
failed AS (SELECT profile, count(*) AS n FROM run_reports WHERE status = 'failed'
  GROUP BY profile),
checks AS (
  SELECT profile, CASE WHEN o.n > 0 THEN 2 ELSE 1 END AS s FROM policies LEFT JOIN old o USING (profile)
  UNION ALL
  SELECT profile, CASE WHEN f.n > 0 THEN 3 ELSE 1 END FROM policies LEFT JOIN failed f USING (profile)
)
SELECT profile, (['ok', 'warning', 'error'])[max(s)] AS status, count(*) AS checks
FROM checks GROUP BY profile""")
def check_rollup(spark, folder):
    summary = _summary(spark, folder)
    pending = summary.select(
        "profile", F.when(F.col("pending_deletions") > 0, "warning").otherwise("ok").alias("status")
    )
    bad = F.col("status") == "failed"
    failing = run_reports(spark, folder).groupBy("profile").agg(
        F.when(F.count(F.when(bad, 1)) > 0, "error").otherwise("ok").alias("status")
    )
    return history.worst_status(pending.unionByName(failing))


FINDINGS = f"""{PLAN},
{LINEAGE.split(RUN_CATALOG + ',', 1)[1]},
{RECEIVED.split(RUN_REPORTS + ',', 1)[1]},
{SURVIVING},
walk AS (
  SELECT run_id AS for_run, parent_run_id AS member FROM lineage
  WHERE parent_run_id IS NOT NULL AND run_id NOT IN (SELECT run_id FROM plan)
  UNION ALL
  SELECT w.for_run, l.parent_run_id FROM walk w JOIN lineage l ON l.run_id = w.member
  WHERE l.parent_run_id IS NOT NULL AND w.member NOT IN (SELECT run_id FROM plan)
),
named AS (SELECT DISTINCT profile, server_id, profile || '-' || size_bytes AS run_id FROM received),
found AS (
  SELECT profile, 'old_runs' AS "check", 2 AS s FROM plan
  UNION ALL SELECT profile, 'failed_runs', 3 FROM run_reports WHERE status = 'failed'
  UNION ALL SELECT profile, 'missing_blocks', 3 FROM firsts f
    WHERE NOT EXISTS (SELECT 1 FROM needed n WHERE n.profile = f.profile AND n.hash = f.hash)
  UNION ALL SELECT l.profile, 'broken_chains', 2 FROM walk w JOIN lineage l ON l.run_id = w.for_run
    WHERE w.member IN (SELECT run_id FROM plan)
  UNION ALL SELECT profile, 'clashing_ids', 2 FROM named GROUP BY profile, run_id
    HAVING count(DISTINCT server_id) > 1
),
findings AS (
  SELECT p.profile, c."check", coalesce(max(s), 1) AS s, count(s) AS findings
  FROM (SELECT profile FROM run_reports UNION SELECT profile FROM firsts) p
  CROSS JOIN (VALUES ('old_runs'), ('failed_runs'), ('missing_blocks'), ('broken_chains'), ('clashing_ids')) c("check")
  LEFT JOIN found f ON f.profile = p.profile AND f."check" = c."check"
  GROUP BY ALL
)"""


def _findings(spark, folder):
    """Every check over the whole tables: retention, failures, blocks, chains and run ids."""
    reports, plan = run_reports(spark, folder), _plan(spark, folder)
    named = received_reports(spark, folder).select(
        "server_id", "profile", F.concat_ws("-", "profile", "size_bytes").alias("run_id"))
    clashes = ingest.clashing_run_ids(named).join(named.select("run_id", "profile").distinct(), "run_id")
    missing = chunk_queries.chunk_missing(spark, folder)
    profiles = reports.select("profile").union(chunk_queries.artifacts(spark, folder).select("profile"))
    return history.check_findings(profiles, {
        "old_runs": (plan, "warning"),
        "failed_runs": (reports.filter(F.col("status") == "failed"), "error"),
        "missing_blocks": (missing, "error"),
        "broken_chains": (lineage.broken_chains(_lineage(spark, folder), plan, GROUP), "warning"),
        "clashing_ids": (clashes, "warning"),
    })


@query("check_findings", f"""WITH RECURSIVE {FINDINGS}
SELECT profile, "check", (['ok', 'warning', 'error'])[s] AS status, findings FROM findings""")
def check_findings(spark, folder):
    return _findings(spark, folder)


@query("check_rollup_findings", f"""WITH RECURSIVE {FINDINGS}
SELECT profile, (['ok', 'warning', 'error'])[max(s)] AS status, count(*) AS checks
FROM findings GROUP BY profile""")
def check_rollup_findings(spark, folder):
    return history.worst_status(_findings(spark, folder))
