"""Completed and failed events per profile and time window."""

from pyspark.sql import functions as F

from tablekeeper.operators.history import event_category, event_status
from tablekeeper.sources import keyed_table
from tablekeeper.sources.keyed_table import KeyedTable

COUNTS_SCHEMA = "profile string, window_start bigint, category string, status string, n bigint"


def outcome_counts(events, window="1 day"):
    """Counts per profile, window, category and outcome; for tables and streams alike."""
    status = event_status(F.col("event"))
    return (
        events.select(
            "at", F.col("payload.profile").alias("profile"),
            event_category(F.col("event")).alias("category"), status.alias("status"),
        )
        .filter(F.col("status").isin("completed", "failed"))
        .groupBy("profile", F.window("at", window).alias("w"), "category", "status")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "profile", F.unix_millis("w.start").alias("window_start"), "category", "status", "n"
        )
    )


def counts_table(root):
    """One row per profile, window, category and outcome: sums of what the batches counted."""
    key = ("profile", "window_start", "category", "status")

    def merged(rows):
        return rows.groupBy(*key).agg(F.sum("n").alias("n"))

    return KeyedTable(root, COUNTS_SCHEMA, key, merged)


def count_batch(events, number, root, stream="batches", window="1 day"):
    """Add the counts of one batch; one that the table has already changes nothing."""
    return keyed_table.append(outcome_counts(events, window), counts_table(root), stream, number)


def count_stream(events, root, checkpoint, window="1 day", available_now=True):
    """Start counting a stream into the keyed table at ``root``.

    No event is too late to count and no state is kept: a micro-batch adds its counts as deltas of the buckets
    that it touches, and buckets with many deltas are merged.
    """

    def each(batch, number):
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        count_batch(batch, number, root, stream, window)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_counts(spark, root):
    """Counts of everything seen so far; none before the first batch."""
    return keyed_table.read(spark, counts_table(root))
