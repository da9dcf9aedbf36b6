"""Alert state of servers: one check, a history of checks, and the texts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablekeeper.functions.ordering import running

HOUR_MS = 3_600_000
DEFAULT_MAX_AGE_MS = 26 * HOUR_MS
LINES_PER_PAGE = 500


def max_age_ms(hours=None):
    """Unset and zero both mean the default."""
    return int((hours or 26) * HOUR_MS)


def health_state(last_success, last_status, now, max_age=DEFAULT_MAX_AGE_MS):
    late = last_success.isNull() | (now - last_success > F.lit(max_age))
    return F.when(late, "overdue").when(last_status == "failed", "failing").otherwise("ok")


def change_kind(before, after):
    """``problem`` when leaving ok, ``recovered`` when back to ok, else NULL."""
    return (
        F.when((after != "ok") & (before == "ok"), "problem")
        .when((after == "ok") & (before != "ok"), "recovered")
    )


def check(health, alerts, now, max_age=DEFAULT_MAX_AGE_MS):
    """One check of every server against the stored alert states."""
    stored = alerts.select(F.col("server_id").alias("id"), F.col("state").alias("_stored"))
    at = F.lit(now).cast("bigint")
    return (
        health.join(stored, "id", "left")
        .withColumn("checked_at", at)
        .withColumn("previous", F.coalesce("_stored", F.lit("ok")))
        .withColumn("state", health_state(F.col("last_success"), F.col("last_status"), at, max_age))
        .withColumn("kind", change_kind(F.col("previous"), F.col("state")))
        .drop("_stored")
    )


def state_updates(checked):
    """Rows to upsert into the alert table."""
    return checked.filter(F.col("state") != F.col("previous")).select(
        F.col("id").alias("server_id"), "state", F.col("checked_at").alias("since")
    )


def first_instant(at, start, period):
    """Number of the first instant that is not before a time."""
    after = F.greatest(at - F.lit(start), F.lit(0))
    return F.call_function("div", after + F.lit(period - 1), F.lit(period))


def check_history(runs, start, period, checks, max_age=DEFAULT_MAX_AGE_MS, servers=None):
    """State of every known server at ``checks`` instants from ``start``.

    A server is known from its first run on, and one of ``servers`` (``server_id``, ``since``, each once) from then
    on, or from the start where that is NULL, whether it ever runs or not. Runs shrink to one row per server and instant before anything is ordered, so a server with very
    many runs costs no more than a quiet one.
    """
    place = first_instant(F.col("reported_at"), start, period)
    news = F.struct("reported_at", "run_id", "status")
    reports = runs.select("server_id", "reported_at", "status", news.alias("news"))
    if servers is not None:
        enrolled = servers.where(F.col("server_id").isNotNull()).select(
            "server_id", F.coalesce("since", F.lit(start)).cast("bigint").alias("reported_at"),
            F.lit(None).cast("string").alias("status"), F.lit(None).cast(reports.schema["news"].dataType).alias("news"))
        reports = reports.unionByName(enrolled)
    per_check = (
        reports.withColumn("n", place)
        .filter(F.col("n") < checks)
        .withColumn("n", F.col("n").cast("int"))
        .groupBy("server_id", "n")
        .agg(
            F.max(F.when(F.col("status") == "success", F.col("reported_at"))).alias("_success"),
            F.max("news").alias("_news"),
        )
    )
    by_time = Window.partitionBy("server_id").orderBy("n")
    so_far = by_time.rowsBetween(Window.unboundedPreceding, 0)
    # each row also stands for the instants up to the next one with news
    until = F.lead("n", 1, checks).over(by_time) - 1
    at = F.lit(start).cast("bigint") + F.col("n").cast("bigint") * F.lit(period).cast("bigint")
    return (
        per_check.withColumn("last_success", F.max("_success").over(so_far))
        .withColumn("_news", F.last("_news", ignorenulls=True).over(so_far))
        .withColumn("_until", until)
        .select(
            "server_id", "last_success", F.col("_news.status").alias("last_status"),
            F.explode(F.sequence("n", "_until")).alias("n"),
        )
        .withColumn("checked_at", at)
        .withColumn(
            "state",
            health_state(F.col("last_success"), F.col("last_status"), F.col("checked_at"), max_age),
        )
        .withColumn("previous", F.lag("state", 1, "ok").over(by_time))
        .withColumn("kind", change_kind(F.col("previous"), F.col("state")))
        .select("server_id", "checked_at", "last_success", "last_status", "previous", "state", "kind")
    )


def alert_text(name, server_id, state, last_success, now):
    """Message of one server."""
    who = F.concat(name, F.lit(" ("), server_id, F.lit(")"))
    hours = F.floor((now - last_success) / F.lit(HOUR_MS)).cast("string")
    age = F.when(last_success.isNull(), "never succeeded").otherwise(
        F.concat(F.lit("last success "), hours, F.lit("h ago"))
    )
    return (
        F.when(state == "overdue", F.concat(who, F.lit(": no recent successful backup — "), age))
        .when(state == "failing", F.concat(who, F.lit(": latest backup FAILED")))
        .otherwise(F.concat(who, F.lit(": recovered — backups healthy again")))
    )


def alert_messages(checked):
    """Problem and recovery messages of checks (needs id, name, state, kind and last_success)."""
    text = alert_text(
        F.col("name"), F.col("id"), F.col("state"), F.col("last_success"), F.col("checked_at")
    )
    return checked.filter(F.col("kind").isNotNull()).select(
        "checked_at", "kind", "id", text.alias("message")
    )


def digest_subjects(messages, sender="tablekeeper"):
    """Subject and counts per check that has something to tell."""
    return (
        messages.groupBy("checked_at")
        .agg(
            F.count(F.when(F.col("kind") == "problem", 1)).alias("problems"),
            F.count(F.when(F.col("kind") == "recovered", 1)).alias("recovered"),
        )
        .withColumn("subject", F.concat(
            F.lit(f"{sender}: "), "problems", F.lit(" alert(s), "), "recovered", F.lit(" recovered")
        ))
    )


def digest_bodies(messages, lines=LINES_PER_PAGE):
    """The whole mail text of each check, problems before recoveries with a blank line between, in pages of at most
    ``lines`` lines."""
    problem = F.col("kind") == "problem"
    own = messages.select("checked_at", F.when(problem, 1).otherwise(4).alias("section"), "id", "message")
    none = F.lit(None).cast("string").alias("id")
    heading = messages.groupBy("checked_at", F.when(problem, 0).otherwise(3).alias("section")).agg(
        F.when(F.first("kind") == "problem", "Backup problems:").otherwise("Recovered:").alias("message"))
    blank = messages.groupBy("checked_at").agg(F.min("kind").alias("a"), F.max("kind").alias("b")).where(
        F.col("a") != F.col("b")).select("checked_at", F.lit(2).alias("section"), none, F.lit("").alias("message"))
    text = own.unionByName(heading.select("checked_at", "section", none, "message")).unionByName(blank)
    numbered = running(
        text, ["checked_at"], ["section", "id"], {"line": ("count", None, True)}
    ).withColumn("page", F.floor((F.col("line") - 1) / lines))
    pages = numbered.groupBy("checked_at", "page").agg(
        F.sort_array(F.collect_list(F.struct("line", "message")))["message"].alias("m"))
    return pages.select("checked_at", "page", F.array_join("m", "\n").alias("body"))


def digest_pages(messages, lines=LINES_PER_PAGE):
    """Mail text per check and section, in pages of at most ``lines`` messages."""
    numbered = running(
        messages, ["checked_at", "kind"], ["id"], {"line": ("count", None, True)}
    ).withColumn("page", F.floor((F.col("line") - 1) / lines))
    heading = F.when(F.col("kind") == "problem", "Backup problems:").otherwise("Recovered:")
    pages = numbered.groupBy("checked_at", "kind", "page").agg(
        F.sort_array(F.collect_list(F.struct("line", "message")))["message"].alias("m")
    )
    return pages.select(
        "checked_at", "kind", "page",
        F.concat_ws("\n", heading, F.array_join("m", "\n")).alias("body"),
    )
