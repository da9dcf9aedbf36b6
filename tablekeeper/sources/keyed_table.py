"""Keyed tables that micro-batches maintain: compacted buckets, and what came after them as deltas.

A key lives in one of ``buckets`` by its hash. A batch is reduced to one row per key and appended as a delta of the
buckets that it touches; nothing else is read or written. A bucket with more than ``most_deltas`` deltas is merged
into one base. A small state file names the folders that count, and which batch of which stream came
last; every change writes a new one, so readers see a batch completely or not at all, and a batch that comes
again changes nothing. One writer at a time.

``merge`` reduces the rows of each key to one. It must give the same whether it is applied at once or step by step.
Every row of a batch counts once, so that sums will do.
"""

import json
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import functions as F

from tablekeeper.functions.bitmaps import bitmap_of, may_hold
from tablekeeper.sources import files

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    root: str
    schema: str
    key: tuple
    merge: Callable
    buckets: int = 16
    most_deltas: int = 8


def _hash(table):
    return F.xxhash64(*[F.col(k) for k in table.key])


def _versions(spark, table):
    return sorted(int(n[:-5]) for n in files.names(spark, f"{table.root}/state") if n.endswith(".json"))


def _state(spark, table, version=None):
    """({bucket: [folder, ...], the base first}, {stream: last batch}) of a version of the state, of the newest."""
    versions = _versions(spark, table)
    if not versions:
        return {}, {}
    version = versions[-1] if version is None else version
    state = json.loads(files.read_text(spark, f"{table.root}/state/{version:010d}.json"))
    return {int(b): names for b, names in state["folders"].items()}, state["streams"]


def _publish(spark, table, folders, streams):
    version = ([0] + _versions(spark, table))[-1] + 1
    text = json.dumps({"folders": folders, "streams": streams})  # buckets x deltas names at most
    files.write_text(spark, f"{table.root}/state/{version:010d}.json", text)


def applied(spark, table, stream, batch):
    """Whether the table has this batch, or a later one, of the stream."""
    _, streams = _state(spark, table)
    return streams.get(stream, -1) >= batch


def _write(table, rows, name):
    """Write rows by bucket; returns the buckets written."""
    path = f"{table.root}/data/{name}"
    placed = rows.withColumn(BUCKET, F.pmod(_hash(table), F.lit(table.buckets)).cast("int"))
    placed.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    return [int(n.split("=")[1]) for n in files.names(rows.sparkSession, path) if n.startswith(f"{BUCKET}=")]


def _read(spark, table, places):
    """Rows of (bucket, folder name) pairs."""
    paths = [f"{table.root}/data/{name}/{BUCKET}={bucket}" for bucket, name in places]
    if not paths:
        return spark.createDataFrame([], table.schema)
    return spark.read.schema(table.schema).parquet(*paths)


def append(rows, table, stream="batches", batch=0):
    """Merge a batch into the table; returns False, and changes nothing, if the table has it already."""
    spark = rows.sparkSession
    folders, streams = _state(spark, table)
    if streams.get(stream, -1) >= batch:
        return False
    name = f"{stream}-{batch:010d}"
    for bucket in _write(table, table.merge(rows), name):
        folders.setdefault(bucket, []).append(name)
    _publish(spark, table, folders, {**streams, stream: batch})
    long = [b for b, names in folders.items() if len(names) > table.most_deltas]
    if long:
        compact(spark, table, long)
    return True


def compact(spark, table, buckets=None):
    """Merge the folders of these buckets (of all) into one each. Folders go when two newer states do without them."""
    folders, streams = _state(spark, table)
    chosen = sorted(folders) if buckets is None else buckets
    chosen = [b for b in chosen if len(folders.get(b, [])) > 1]
    if not chosen:
        return
    name = f"base-{_versions(spark, table)[-1]:010d}"
    _write(table, table.merge(_read(spark, table, [(b, n) for b in chosen for n in folders[b]])), name)
    _publish(spark, table, {**folders, **{b: [name] for b in chosen}}, streams)
    _drop_unused(spark, table)


def _drop_unused(spark, table):
    """Delete the folders that neither of the two newest states names: a reader may still use the older one."""
    versions = _versions(spark, table)
    used = {
        (name, bucket) for version in versions[-2:]
        for bucket, names in _state(spark, table, version)[0].items() for name in names
    }
    there = [
        (name, int(part.split("=")[1])) for name in files.names(spark, f"{table.root}/data")
        for part in files.names(spark, f"{table.root}/data/{name}") if part.startswith(f"{BUCKET}=")
    ]
    files.delete_paths(spark, [f"{table.root}/data/{n}/{BUCKET}={b}" for n, b in there if (n, b) not in used])
    files.delete_paths(spark, [f"{table.root}/state/{v:010d}.json" for v in versions[:-2]])


def read(spark, table):
    """One row per key. Rows of the base whose keys no delta holds pass without exchange."""
    folders, _ = _state(spark, table)
    first = [(b, names[0]) for b, names in folders.items()]
    later = [(b, name) for b, names in folders.items() for name in names[1:]]
    base = _read(spark, table, first)
    if not later:
        return base
    deltas = _read(spark, table, later)
    hashes = deltas.select(_hash(table).alias("h"))
    touched = may_hold(bitmap_of(hashes, hashes.count()), _hash(table))
    return base.where(~touched).unionByName(table.merge(base.where(touched).unionByName(deltas)))
