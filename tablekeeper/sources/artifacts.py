"""Backup files as blocks."""

import hashlib
import math
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
from pyspark.sql import functions as F

CHUNK_SIZE = 1 << 20
BYTES_PER_TASK = 256 << 20
BLOCKS_PER_BATCH = 32


def read_artifacts(spark, path):
    """Files as ``path, length, content``; each file must fit into one row."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def _locate(path):
    """File system and name of a path as Spark lists it."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    uri = quote(path.replace("s3a://", "s3://", 1), safe="/:@")
    return pyarrow.fs.FileSystem.from_uri(uri)


def _read_blocks(size, with_data):
    def read(batches):
        for batch in batches:
            batch = batch.sort_values(["path", "idx"])
            for start in range(0, len(batch), BLOCKS_PER_BATCH):
                piece = batch.iloc[start : start + BLOCKS_PER_BATCH]
                yield _read_piece(piece, size, with_data)

    return read


def _read_piece(piece, size, with_data):
    rows = []
    for path, wanted in piece.groupby("path", sort=False):
        system, name = _locate(path)
        with system.open_input_file(name) as handle:
            for idx in wanted["idx"]:
                data = handle.read_at(size, int(idx) * size)
                rows.append((path, idx, hashlib.sha256(data).hexdigest(), len(data), data))
    columns = ["path", "idx", "hash", "n_bytes", "data"]
    frame = pd.DataFrame(rows, columns=columns)
    return frame if with_data else frame[columns[:-1]]


def file_ranges(spark, path, size=CHUNK_SIZE):
    """(path, idx, n_bytes) of every block of the files; only names and lengths are listed."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    last = F.call_function("div", F.col("length") - 1, F.lit(size))
    ranges = files.filter(F.col("length") > 0).select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("idx")
    )
    n_bytes = F.least(F.lit(size).cast("bigint"), F.col("length") - F.col("idx") * size)
    return ranges.select("path", "idx", n_bytes.alias("n_bytes"))


def read_ranges(ranges, size=CHUNK_SIZE, with_data=False, bytes_per_task=BYTES_PER_TASK):
    """Blocks at the given places; every task reads its own byte ranges from storage.

    The places are spread evenly, so a very large file is read by many tasks.
    """
    total = ranges.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(1, math.ceil(total / bytes_per_task))
    schema = "path string, idx bigint, hash string, n_bytes bigint"
    schema += ", data binary" if with_data else ""
    places = ranges.select("path", "idx").repartition(tasks, "path", "idx")
    return places.mapInPandas(_read_blocks(size, with_data), schema)


def scan_file_blocks(spark, path, size=CHUNK_SIZE, with_data=False, bytes_per_task=BYTES_PER_TASK):
    """Blocks of files of any size."""
    return read_ranges(file_ranges(spark, path, size), size, with_data, bytes_per_task)
