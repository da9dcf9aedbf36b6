"""Notification texts for subscribed events."""

from pyspark.sql import functions as F

from tablekeeper.operators.history import choose

# Events sent unless a profile chooses its own, and their titles.
TITLES = {
    "backup.completed": "Backup completed",
    "backup.failed": "Backup failed",
    "restore.failed": "Restore failed",
    "verification.completed": "Verification completed",
    "verification.failed": "Verification failed",
}
DEFAULT_EVENTS = list(TITLES)
LINES = [
    ("profile", "Profile"), ("target_profile", "Target profile"), ("db_type", "DB type"),
    ("run_id", "Run ID"), ("status", "Status"), ("artifact_path", "Artifact"),
]
ERROR_LENGTH = 400


def message_text(event, payload, sender="tablekeeper"):
    """Message of an event: title, then one line per field that is set."""
    title = choose(event, TITLES, event)
    lines = [F.concat(F.lit(f"[{sender}] "), title)]
    for name, label in LINES:
        value = F.nullif(payload[name], F.lit(""))
        lines.append(F.concat(F.lit(f"{label}: "), value))
    error = F.nullif(payload["error"], F.lit(""))
    clipped = F.when(F.char_length(error) <= ERROR_LENGTH, error).otherwise(
        F.concat(F.substring(error, 1, ERROR_LENGTH - 3), F.lit("..."))
    )
    lines.append(F.concat(F.lit("Error: "), clipped))
    return F.concat_ws("\n", *lines)


def outbox(events, subscriptions, default=None, sender="tablekeeper"):
    """Messages to send. ``subscriptions`` (profile, events) replace the default set."""
    usual = F.array(*[F.lit(e) for e in (DEFAULT_EVENTS if default is None else default)])
    own = subscriptions.select(F.col("profile").alias("_profile"), F.col("events").alias("_events"))
    joined = events.join(own, F.col("payload.profile") == F.col("_profile"), "left")
    return joined.filter(F.array_contains(F.coalesce("_events", usual), F.col("event"))).select(
        "line_no", F.col("payload.profile").alias("profile"), "event",
        message_text(F.col("event"), F.col("payload"), sender).alias("message"),
    )
