"""Throttling as a stream, in order of arrival.

Every micro-batch goes through the batch operator, which spreads keys of any size over tasks. What it needs of
the batches before is two numbers per key, the opening of its last window and the events allowed in it; they
enter as that many events at that time, and are kept in a keyed table.
"""

from pyspark.sql import functions as F

from tablekeeper.functions.ordering import ROWS_PER_TASK
from tablekeeper.operators.throttle import LIMIT, WINDOW_MS, windows
from tablekeeper.session import checkpoint as cut
from tablekeeper.sources import keyed_table
from tablekeeper.sources.keyed_table import KeyedTable


def _last_window(rows):
    return rows.groupBy("key").agg(F.max(F.struct("opened", "used")).alias("w")).select("key", "w.*")


def open_windows(root, key_type="string"):
    """The table of last windows below ``root``."""
    return KeyedTable(f"{root}/windows", f"key {key_type}, opened bigint, used bigint", ("key",), _last_window)


def throttle_batch(events, number, root, window_ms=WINDOW_MS, limit=LIMIT, stream="batches",
                   rows_per_task=ROWS_PER_TASK):
    """Decide one batch of events (``key, at, id``); writes a folder of ``root/decided`` and moves the windows on.

    An event that comes later than its time counts in the window that is open then.
    """
    spark = events.sparkSession
    kinds = dict(events.dtypes)
    table = open_windows(root, kinds["key"])
    if keyed_table.applied(spark, table, stream, number):
        return
    known = keyed_table.read(spark, table).select(F.col("key").alias("_key"), "opened", "used")
    joined = events.select("key", "at", "id").join(known, F.col("key").eqNullSafe(F.col("_key")), "left")
    moved = joined.select(
        "key", F.greatest("at", "opened").alias("at"), F.col("at").alias("was"), "id", F.lit(False).alias("carried"))
    carried = known.join(events.select(F.col("key").alias("_here")).distinct(),
                         F.col("_key").eqNullSafe(F.col("_here")), "left_semi").select(
        F.col("_key").alias("key"), F.col("opened").alias("at"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("used"))).alias("nth"))
    # before all events of their time, and each a row of its own
    carried = carried.select("key", "at", (F.lit(-(1 << 63)) + F.col("nth")).alias("was"),
                             F.lit(None).cast(kinds["id"]).alias("id"), F.lit(True).alias("carried"))
    decided = cut(windows(moved.unionByName(carried), window_ms, limit, rows_per_task, ("was", "id")))
    decided.where("NOT carried").select("key", F.col("was").cast(kinds["at"]).alias("at"), "id", "allowed").write.mode(
        "overwrite").parquet(f"{root}/decided/stream={stream}/batch={number}")
    per_window = decided.groupBy("key", "opened").agg(
        F.count(F.when(F.col("allowed"), 1)).alias("used"))
    keyed_table.append(per_window, table, stream, number)


def throttle_stream(events, root, checkpoint, window_ms=WINDOW_MS, limit=LIMIT, available_now=True,
                    rows_per_task=ROWS_PER_TASK):
    """Start throttling a stream of events (``key, at, id``)."""

    def each(batch, number):
        kept = batch.persist()
        try:
            stream = kept.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            throttle_batch(kept, number, root, window_ms, limit, stream, rows_per_task)
        finally:
            kept.unpersist()

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_decided(spark, root, key_type="string", id_type="bigint"):
    """All decided events."""
    schema = f"key {key_type}, at bigint, id {id_type}, allowed boolean"
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/decided")
