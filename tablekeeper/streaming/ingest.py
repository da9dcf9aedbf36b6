"""Reports from the wire to the tables, batch by batch.

Every micro-batch writes a folder named after its stream and number, so a batch that runs again replaces what
it wrote before, and a stream that starts anew leaves the rows of the one before. Reports are read, authorised and
checked once, and written by what became of them (``PARTS``). Then the accepted ones are merged into the servers and
runs tables, which are kept in buckets: a batch adds deltas to the buckets that it touches, and reading meets the
rest as it is.
"""

from pyspark.sql import functions as F

from tablekeeper.operators import ingest
from tablekeeper.sources import files, keyed_table
from tablekeeper.sources.keyed_table import KeyedTable
from tablekeeper.streaming.state import use_state_store

PARTS = ("accepted", "rejected", "audit")
PART = "_part"
AUDIT_SCHEMA = "id bigint, at bigint, event string, actor string, ip string, detail string"


def write_batch(reports, batch, root, tokens, shared_token=None, stream="batches"):
    """Authorise, check and fill one batch of raw reports; a folder for each part of it, and the two tables."""
    decided = ingest.decide(reports, tokens, shared_token)
    path = f"{root}/checked/stream={stream}/batch={batch}"
    # static, so that a part that is empty this time does not stay from a run before
    decided.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(PART).parquet(path)
    spark = reports.sparkSession
    columns = decided.drop("reasons", "_audit", PART).schema
    schema = columns.simpleString()[7:-1].replace(",", ", ").replace(":", " ")
    if not files.exists(spark, f"{root}/columns"):
        files.write_text(spark, f"{root}/columns", schema)
    accepted = spark.createDataFrame([], columns)
    if files.exists(spark, f"{path}/{PART}=accepted"):
        accepted = spark.read.schema(columns).parquet(f"{path}/{PART}=accepted")
    keyed_table.append(_seen(accepted), servers_table(root), stream, batch)
    keyed_table.append(accepted, runs_table(root, schema), stream, batch)


# --- tables --------------------------------------------------------------------------------------

def _seen(reports):
    return reports.select(
        F.col("server_id").alias("id"), F.struct("reported_at", "seq", "server_name").alias("newest"),
        F.col("reported_at").alias("last_seen_at"), F.col("reported_at").alias("created_at"))


def _merged_servers(rows):
    return rows.groupBy("id").agg(
        F.max("newest").alias("newest"), F.max("last_seen_at").alias("last_seen_at"),
        F.min("created_at").alias("created_at"))


def servers_table(root):
    """Every server once, with the report that named it last."""
    schema = ("id string, newest struct<reported_at: bigint, seq: bigint, server_name: string>, "
              "last_seen_at bigint, created_at bigint")
    return KeyedTable(f"{root}/tables/servers", schema, ("id",), _merged_servers)


def runs_table(root, schema):
    """The first report of every run id."""
    return KeyedTable(f"{root}/tables/runs", schema, ("run_id",), ingest.first_reports)


def _columns(spark, root):
    if not files.exists(spark, f"{root}/columns"):
        return ", ".join(f"{c} {'bigint' if c in ingest.NUMBERS else 'string'}" for c in ingest.REPORT_COLUMNS) + (
            ", reported_at bigint, seq bigint")
    return spark.read.text(f"{root}/columns").first()[0]


def tables(spark, root):
    """(servers, runs) from everything accepted so far."""
    servers = keyed_table.read(spark, servers_table(root)).select(
        "id", F.col("newest.server_name").alias("name"), "last_seen_at", "created_at")
    return servers, keyed_table.read(spark, runs_table(root, _columns(spark, root)))


def compact(spark, root):
    """Merge what came after the last merge into every bucket."""
    for table in (servers_table(root), runs_table(root, _columns(spark, root))):
        keyed_table.compact(spark, table)


# --- streams -------------------------------------------------------------------------------------

def ingest_stream(reports, root, checkpoint, tokens, shared_token=None, available_now=True):
    """Start ingesting a stream of raw reports."""

    def each(batch, number):
        # the id stays through restarts from one checkpoint
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        write_batch(batch, number, root, tokens, shared_token, stream)

    writer = reports.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_part(spark, root, name):
    """One of ``PARTS`` of everything so far; empty before the first batch."""
    if not files.found(spark, f"{root}/checked/*/*/{PART}={name}"):
        columns = AUDIT_SCHEMA if name == "audit" else _columns(spark, root)
        return spark.createDataFrame([], columns + (", reasons array<string>" if name == "rejected" else ""))
    rows = spark.read.parquet(f"{root}/checked").where(F.col(PART) == name).drop(PART)
    if name == "audit":
        return rows.select("_audit.*", "stream", "batch")
    return rows.drop("_audit") if name == "rejected" else rows.drop("_audit", "reasons")


def unique_runs(reports, within=None):
    """First report of each run id as a stream.

    Ids are remembered for ever, in the store on disk, and no report is too late. With ``within`` (a delay), an id is
    remembered until the newest report is so much later, which bounds the state; reports that late must have been
    set aside before (``late.gate``).
    """
    use_state_store(reports.sparkSession)
    timed = reports.withColumn("at", F.timestamp_millis("reported_at"))
    if within is None:
        return timed.dropDuplicates(["run_id"])
    return timed.withWatermark("at", within).dropDuplicatesWithinWatermark(["run_id"])
