"""Backup history and run-log views."""

from pyspark.sql import functions as F

from tablekeeper.errors import KeeperError
from tablekeeper.functions.ordering import newest_per_group

# The fields of a listed run.
HISTORY_COLUMNS = [
    "profile", "run_dir", "run_id", "db_type", "backup_type", "artifact_path", "manifest_path",
    "compression", "started_at", "finished_at", "duration_ms",
]
LIST_DEPTH = 200


# --- backup runs ---------------------------------------------------------------------------------

def latest_runs(catalog, group=("profile",)):
    """Newest run of each group by (finished, written, id)."""
    group = list(group)
    order = ["finished_ms", "mtime_ms", "run_id"]
    rest = [c for c in catalog.columns if c not in group]
    # run ids are unique, so there are no ties
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return catalog.groupBy(*group).agg(newest).select(*group, "r.*").select(*catalog.columns)


def latest_run(catalog, profile):
    """Newest run of one profile, an error when it has none."""
    found = latest_runs(catalog.filter(F.col("profile") == profile))
    if found.isEmpty():
        raise KeeperError(f"no backup runs found for profile {profile!r}")
    return found


def backup_history(catalog, profile=None, limit=None):
    """Run listing with all of ``HISTORY_COLUMNS``, newest first, runs without a finish time last."""
    absent = [c for c in HISTORY_COLUMNS if c not in catalog.columns]
    if absent:
        raise KeeperError(f"the catalogue lacks {', '.join(absent)}")
    if profile is not None:
        catalog = catalog.filter(F.col("profile") == profile)
    ordered = catalog.orderBy(F.desc_nulls_last("finished_ms"), "profile", "run_id")
    listed = ordered.select(*HISTORY_COLUMNS)
    return listed if limit is None else listed.limit(limit)


# --- events --------------------------------------------------------------------------------------

def events_of_profile(events, profile):
    """Events about one profile, alone or among others."""
    alone = F.coalesce(F.col("payload.profile") == profile, F.lit(False))
    among = F.coalesce(F.array_contains("payload.profiles", profile), F.lit(False))
    return events.filter(alone | among)


def events_by_profile(events):
    """Every event once per profile it is about (``for_profile``)."""
    about = F.array_distinct(F.array_compact(F.concat(
        F.array("payload.profile"), F.coalesce("payload.profiles", F.array().cast("array<string>"))
    )))
    return events.withColumn("for_profile", F.explode(about))


def newest_order():
    """Newest first, unreadable times last, lines of one second in file order."""
    return [F.desc_nulls_last("at"), F.asc("line_no")]


def recent_events(events, limit=LIST_DEPTH):
    return events.orderBy(*newest_order()).limit(limit)


def newest_events_per_profile(events, depth):
    return newest_per_group(
        events_by_profile(events), ["for_profile"], newest_order(), depth, ["line_no"]
    )


def latest_event(events, names, depth=None):
    """Per profile the newest event with one of the names; with ``depth``, only among its newest so many
    events, whatever their names."""
    wanted = F.col("event").isin(list(names))
    if depth is None:
        found = events_by_profile(events.filter(wanted))
    else:
        found = newest_events_per_profile(events, depth).filter(wanted).drop("rank")
    return newest_per_group(found, ["for_profile"], newest_order(), 1, ["line_no"]).drop("rank")


def latest_outcome(events, completed, failed, depth=None):
    """Per profile the newest completed or failed event as ``ok`` or ``error``."""
    found = latest_event(events, [completed, failed], depth)
    return found.withColumn("status", F.when(F.col("event") == completed, "ok").otherwise("error"))


# --- activity ------------------------------------------------------------------------------------

def event_category(event):
    """Part before the first dot, empty without one."""
    return F.when(event.contains("."), F.split(event, r"\.", 2)[0]).otherwise("")


def event_status(event):
    """``started``, ``completed`` or ``failed`` after the first dot, else ``other``."""
    suffix = F.when(event.contains("."), F.split(event, r"\.", 2)[1])
    return F.when(suffix.isin("started", "completed", "failed"), suffix).otherwise("other")


def _given(column):
    return F.nullif(column, F.lit(""))


def duration_text(ms):
    """``1.5s`` from a second on, else whole milliseconds; empty when unset."""
    tenths = F.floor(ms / 100)
    rest = ms - tenths * 100
    # on a tie the binary value of ms / 1000 decides, and half goes to even: its distance from the
    # exact quotient comes from splitting it into two short halves, whose products are exact
    whole = ms / 1000
    high = whole * 134217729.0 - (whole * 134217729.0 - whole)
    error = (high * 1000 - ms) + (whole - high) * 1000
    tie = (error > 0) | ((error == 0) & (tenths % 2 == 1))
    up = (rest > 50) | ((rest == 50) & tie)
    tenths = tenths + F.when(up, 1).otherwise(0)
    part = (tenths % 10).cast("string")
    seconds = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), part, F.lit("s"))
    return (
        F.when(ms.isNull(), "").when(ms >= 1000, seconds)
        .otherwise(F.concat(ms.cast("bigint").cast("string"), F.lit("ms")))
    )


def choose(value, options, otherwise):
    """The option for a value, in one flat CASE."""
    chain = F
    for name, result in options.items():
        chain = chain.when(value == name, result)
    return chain.otherwise(otherwise)


def activity_summary(event, payload):
    """One line about an event; ``payload`` is its struct column."""
    # The field names, the events below and the texts of their lines.
    p = {name: payload[name] for name in (
        "db_type", "compression", "duration_ms", "retention_deleted_count", "error",
        "restore_selection", "restore_selection_kind", "target_profile", "verification_status",
        "deleted_count", "channel", "event",
    )}
    error = F.coalesce(_given(p["error"]), F.lit("failed"))
    target = F.coalesce(_given(p["target_profile"]), F.lit("n/a"))
    started = F.concat_ws(" / ", _given(p["db_type"]), _given(p["compression"]))
    pruned = F.when(
        p["retention_deleted_count"] != 0,
        F.concat(F.lit("pruned "), p["retention_deleted_count"].cast("string")),
    )
    done = F.concat_ws(
        ", ", _given(p["compression"]), _given(duration_text(p["duration_ms"])), pruned
    )
    chosen = F.concat(
        F.array_size(p["restore_selection"]).cast("string"), F.lit(" "),
        F.coalesce(_given(p["restore_selection_kind"]), F.lit("items")),
    )
    # the log holds one retention.deleted line per run, without a count
    deleted = F.concat(
        F.lit("deleted "), F.coalesce(p["deleted_count"], F.lit(1)).cast("string"), F.lit(" run(s)")
    )
    sent = F.rtrim(F.concat(
        F.coalesce(_given(p["channel"]), F.lit("n/a")), F.lit(": "),
        F.coalesce(p["event"], F.lit("")),
    ), F.lit(": "))
    checked = F.concat(F.lit("verification: "), _given(p["verification_status"]))
    texts = {
        "backup.started": F.coalesce(_given(started), F.lit("starting")),
        "backup.completed": F.coalesce(_given(done), F.lit("ok")),
        "backup.failed": error,
        "restore.started": F.when(
            F.coalesce(F.array_size(p["restore_selection"]), F.lit(0)) > 0, chosen
        ).otherwise("full restore"),
        "restore.completed": F.lit("ok"),
        "restore.failed": error,
        "verification.started": F.concat(F.lit("target: "), target),
        "verification.completed": F.concat(F.lit("verified via "), target),
        "verification.failed": error,
        "scheduled_cycle.started": F.lit("cycle started"),
        "scheduled_cycle.completed": F.coalesce(checked, F.lit("ok")),
        "scheduled_cycle.failed": error,
        "retention.deleted": deleted,
        "notification.sent": sent,
        "notification.failed": error,
    }
    return choose(event, texts, F.lit(""))


def activity(events):
    """Events with category, status and summary line."""
    return events.select(
        "*",
        event_category(F.col("event")).alias("category"),
        event_status(F.col("event")).alias("status"),
        activity_summary(F.col("event"), F.col("payload")).alias("summary"),
    )


def activity_counts(events, category=None, status=None):
    """How many events pass the filters, of how many."""
    shown = F.lit(True)
    if category is not None:
        shown = shown & (event_category(F.col("event")) == category)
    if status is not None:
        shown = shown & (event_status(F.col("event")) == status)
    counts = events.agg(
        F.count(F.when(shown, 1)).alias("shown"), F.count(F.lit(1)).alias("total")
    )
    text = F.when(F.col("shown") == F.col("total"), F.concat("total", F.lit(" events")))
    return counts.withColumn(
        "label", text.otherwise(F.concat("shown", F.lit(" of "), "total", F.lit(" events")))
    )


# --- status --------------------------------------------------------------------------------------

def status_board(profiles, latest, backup_outcome, verification_outcome, retention):
    """One row per profile from the per-profile inputs.

    ``profiles`` has profile and target_profile; the others are outputs of ``latest_runs``,
    ``latest_outcome`` (twice) and the retention summary.
    """
    last = latest.select(
        "profile", F.col("run_id").alias("last_run_id"), F.col("finished_at").alias("last_finished_at")
    )

    def outcome(df, prefix):
        return df.select(
            F.col("for_profile").alias("profile"), F.col("status").alias(f"{prefix}_status"),
            F.col("timestamp").alias(f"{prefix}_at"),
        )

    limits = retention.select(
        "profile", "configured", "keep_last", "max_age_days", "total_runs", "pending_deletions"
    )
    return (
        profiles.join(last, "profile", "left")
        .join(outcome(backup_outcome, "backup"), "profile", "left")
        .join(outcome(verification_outcome, "verification"), "profile", "left")
        .join(limits, "profile", "left")
        .withColumn("verification_configured", F.col("target_profile").isNotNull())
    )


# How bad a check result is.
SEVERITIES = ["ok", "warning", "error"]


def check_findings(profiles, checks):
    """One row per profile and check: its status and number of findings.

    ``checks`` maps a name to (findings with a ``profile``, severity where a profile has any). Findings without a
    profile, or of one that is not in ``profiles``, are left out.
    """
    every = None
    for name, (findings, severity) in checks.items():
        if severity not in SEVERITIES:
            raise KeeperError(f"unknown severity {severity!r}")
        n = findings.groupBy("profile").agg(F.count(F.lit(1)).alias("findings"))
        one = profiles.select("profile").distinct().join(n, "profile", "left").select(
            "profile", F.lit(name).alias("check"),
            F.when(F.col("findings") > 0, severity).otherwise("ok").alias("status"),
            F.coalesce("findings", F.lit(0).cast("long")).alias("findings"),
        )
        every = one if every is None else every.unionByName(one)
    return every


def worst_status(checks):
    """Worst check status per profile (``checks``: profile, check, status)."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("status"))
    return checks.groupBy("profile").agg(
        F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.max(rank).cast("int") - 1)
        .alias("status"),
        F.count(F.lit(1)).alias("checks"),
    )
