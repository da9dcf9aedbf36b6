"""Late rows set aside before a stream that has a watermark.

A row is late if its time is before the newest time of all earlier micro-batches less the delay. Each batch writes
its rows on time and its late rows to folders of their own, and its newest time, which the next batch reads. What reads
the rows on time with the same delay as its watermark drops none of them: it has never seen later rows than the gate.
"""

from pyspark.sql import functions as F

from tablekeeper.sources import files

ON_TIME, LATE = "on_time", "late"


def _mark(spark, root, stream, number):
    """Newest time up to a batch, None if there is none."""
    path = f"{root}/marks/stream={stream}/batch={number}"
    if number < 0 or not files.complete(spark, path):
        return None
    return spark.read.schema("newest bigint").parquet(path).first()[0]


def gate_batch(rows, number, root, time, delay_ms, stream="batches"):
    """Write one batch below ``root``; ``time`` names a column of epoch milliseconds. A NULL time is late."""
    spark = rows.sparkSession
    newest = _mark(spark, root, stream, number - 1)
    late = F.col(time).isNull() | (F.lit(False) if newest is None else F.col(time) < F.lit(newest - delay_ms))
    for name, part in ((ON_TIME, rows.where(~late)), (LATE, rows.where(late))):
        part.write.mode("overwrite").parquet(f"{root}/{name}/stream={stream}/batch={number}")
    here = rows.agg(F.greatest(F.max(time), F.lit(newest).cast("bigint")).alias("newest"))
    here.coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/stream={stream}/batch={number}")
    files.delete_paths(spark, [f"{root}/marks/stream={stream}/batch={number - 2}"])


def gate(rows, root, checkpoint, time, delay_ms, available_now=True):
    """Start parting a stream into rows on time and late rows."""

    def each(batch, number):
        kept = batch.persist()
        try:
            stream = kept.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            gate_batch(kept, number, root, time, delay_ms, stream)
        finally:
            kept.unpersist()

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read(spark, root, name, schema):
    """Rows on time or late rows so far; none before the first batch."""
    if not files.found(spark, f"{root}/{name}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/{name}")


def stream_on_time(spark, root, schema):
    """The rows on time as a stream, for the jobs that keep state."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/{ON_TIME}")
