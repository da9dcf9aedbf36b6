"""Views over servers and their runs."""

from pyspark.sql import functions as F

from tablekeeper.errors import KeeperError
from tablekeeper.functions.ordering import newest_per_group


def table_counts(servers, runs):
    """Number of servers and of runs, in one row."""
    n = F.count(F.lit(1))
    rows = servers.select(F.lit("servers").alias("t")).unionAll(runs.select(F.lit("runs").alias("t")))
    return rows.agg(
        F.count(F.when(F.col("t") == "servers", 1)).alias("servers"),
        F.count(F.when(F.col("t") == "runs", 1)).alias("runs"),
    )


def fleet_overview(servers, runs):
    """Every server with its last run, last success and run count: one pass over the runs."""
    last = F.max(F.struct("reported_at", "run_id", "status", "finished_at"))
    per_server = runs.groupBy(F.col("server_id").alias("id")).agg(
        last.alias("last"),
        F.max(F.when(F.col("status") == "success", F.col("reported_at"))).alias("last_success"),
        F.count(F.lit(1)).alias("run_count"),
    )
    return servers.join(per_server, "id", "left").select(
        "id", "name", "last_seen_at",
        F.col("last.status").alias("last_status"),
        F.col("last.finished_at").alias("last_finished"),
        F.col("last.reported_at").alias("last_reported"),
        "last_success",
        F.coalesce("run_count", F.lit(0)).alias("run_count"),
    )


def newest_first(overview):
    return overview.orderBy(F.desc("last_seen_at"), "id")


def server_health(servers, runs):
    return fleet_overview(servers, runs).select(
        "id", "name", "last_reported", "last_status", "last_success"
    )


def server_lookup(servers, runs, server_id):
    """Overview row of one server; both inputs are filtered before any grouping."""
    return fleet_overview(
        servers.filter(F.col("id") == server_id), runs.filter(F.col("server_id") == server_id)
    )


def runs_of_server(runs, server_id, limit=50):
    """Newest runs of one server."""
    if limit < 1:
        raise KeeperError("limit must be positive")
    return (
        runs.filter(F.col("server_id") == server_id)
        .orderBy(F.desc("reported_at"), F.desc("run_id")).limit(limit)
    )


def runs_per_server(runs, limit=50):
    """Newest runs of every server, with their rank."""
    order = [F.desc("reported_at"), F.desc("run_id")]
    return newest_per_group(runs, ["server_id"], order, limit, ["run_id"])


def fleet_table(overview, state):
    """Overview with ``state`` (a column), ``none`` for servers without runs."""
    return overview.withColumn("state", F.when(F.col("run_count") == 0, "none").otherwise(state))


def needing_attention(table):
    """Servers in all and servers that are overdue or failing."""
    return table.agg(
        F.count(F.lit(1)).alias("servers"),
        F.count(F.when(F.col("state").isin("overdue", "failing"), 1)).alias("need_attention"),
    )


def search_servers(table, text):
    """Servers whose name and id contain the text, ignoring case; blank keeps all."""
    wanted = text.strip().lower()
    if not wanted:
        return table
    return table.filter(F.lower(F.concat_ws(" ", "name", "id")).contains(wanted))
