"""The run log: one JSON object per line, ``{"event", "payload", "timestamp"}``."""

from pyspark.sql import functions as F

from tablekeeper.functions.timestamps import parse_timestamp
from tablekeeper.sources import files

PAYLOAD_FIELDS = {
    "artifact_path": "string", "channel": "string", "compression": "string", "db_type": "string",
    "deleted_count": "bigint", "duration_ms": "double", "error": "string", "event": "string",
    "profile": "string", "profiles": "array<string>", "restore_selection": "array<string>",
    "restore_selection_kind": "string", "retention_deleted_count": "bigint", "run_id": "string",
    "status": "string", "target_profile": "string", "verification_status": "string",
}


def parse_lines(df):
    """Events of log lines (column ``value``); blank and corrupt lines are skipped.

    Every known payload field becomes part of the ``payload`` struct, and the whole payload is kept as text in
    ``payload_json``; ``at`` is the parsed time.
    """
    line = F.trim("value")
    payload = ", ".join(f"{name}: {kind}" for name, kind in PAYLOAD_FIELDS.items())
    schema = f"timestamp string, event string, payload struct<{payload}>"
    rest = [c for c in df.columns if c != "value"]
    # the keys of a line that is no JSON object are NULL
    parsed = df.filter(F.json_object_keys(line).isNotNull()).select(
        *rest, F.from_json(line, schema).alias("_e"), F.get_json_object(line, "$.payload").alias("payload_json")
    )
    return parsed.select(
        *rest, "_e.timestamp", "_e.event", "_e.payload", "payload_json",
        parse_timestamp(F.col("_e.timestamp")).alias("at"),
    )


def scan_events(spark, path):
    """Events of the log files below ``path``, none where there is no log yet. ``line_no`` grows in file order."""
    if not files.found(spark, path):
        return parse_lines(spark.createDataFrame(
            [], "value string, line_no struct<file: string, start: bigint, row: bigint>"))
    # rows of one file piece stay together, so their running ids keep the order of the lines
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_no"),
    )
    return parse_lines(lines)


def store_events(events, path):
    """Keep events as a Parquet table whose ``payload_any`` is the whole payload as a variant."""
    events.select("timestamp", "event", "at", F.try_parse_json("payload_json").alias("payload_any")).write.mode(
        "append").parquet(path)


def payload_field(events, path, kind="string"):
    """Any field of a stored payload by its path, such as ``$.profiles[0]``; NULL where it is absent or no ``kind``."""
    return F.try_variant_get(F.col("payload_any"), path, kind)


def stored_events(spark, path):
    """Events that ``store_events`` kept; none before the first."""
    schema = "timestamp string, event string, at timestamp, payload_any variant"
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def stream_events(spark, path, **options):
    """The same events as a stream of newly arriving files."""
    lines = spark.readStream.options(recursiveFileLookup="true", **options).text(path)
    return parse_lines(lines)


def to_lines(events):
    """Log lines of events: keys in order, unset fields left out. Events read from a log keep all of their
    payload."""
    if "payload_json" in events.columns:
        whole = F.struct("event", F.try_parse_json("payload_json").alias("payload"), "timestamp")
        return events.select(F.to_json(whole).alias("value"))
    return events.select(F.to_json(F.struct("event", "payload", "timestamp")).alias("value"))


def append_events(events, path):
    """Append events (timestamp, event, payload) to a log folder."""
    to_lines(events).write.mode("append").text(path)


def append_events_once(events, path, name):
    """Append events as a folder of that name; a folder that is complete stays as it is.

    A call that was cut off is repeated with the same name, so its events are in the log once.
    """
    target = f"{path}/{name}"
    if not files.complete(events.sparkSession, target):
        to_lines(events).write.mode("overwrite").text(target)


def append_event_stream(events, path, checkpoint):
    """Append a stream of events to a log folder; takes what is there and ends."""
    writer = to_lines(events).writeStream.format("text").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
