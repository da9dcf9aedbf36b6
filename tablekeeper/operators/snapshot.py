"""Table snapshots, restores and content comparison.

A full snapshot holds all rows. A differential or incremental one holds only changed rows with their
``_change`` in number of copies, so tables with repeated rows come back exactly. Rows are kept in buckets by their
digest, and every snapshot has a tree of checksums over its buckets (``digest_index``).
"""

import datetime
import functools
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekeeper.errors import KeeperError
from tablekeeper.operators import digest_index as index
from tablekeeper.operators import retention
from tablekeeper.operators.history import latest_runs
from tablekeeper.operators.lineage import DIFFERENTIAL, FULL, INCREMENTAL
from tablekeeper.session import checkpoint
from tablekeeper.sources import catalogue, event_log, files
from tablekeeper.sources.tables import replace_table

CHANGE = index.CHANGE
COPIES_PER_ROW = 100_000


# --- differences ---------------------------------------------------------------------------------

def counted(df, sign=1):
    return df.withColumn(CHANGE, F.lit(sign).cast("bigint"))


def difference(old, new):
    """Rows whose number of copies differs, with the change from old to new.

    One shuffle with map-side combine; NULLs compare equal.
    """
    both = counted(new).unionByName(counted(old, -1))
    return total_change(both)


def total_change(rows):
    columns = [c for c in rows.columns if c != CHANGE]
    summed = rows.groupBy(*columns).agg(F.sum(CHANGE).alias(CHANGE))
    return summed.filter(F.col(CHANGE) != 0)


def expand_copies(rows):
    """Each row as often as its ``_change`` says; very many copies are spread over tasks."""
    columns = [c for c in rows.columns if c != CHANGE]
    once = rows.filter(F.col(CHANGE) == 1).select(*columns)
    piece = F.lit(COPIES_PER_ROW).cast("bigint")
    last = F.call_function("div", F.col(CHANGE) - 1, piece)
    pieces = rows.filter(F.col(CHANGE) > 1).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_piece")
    ).hint("rebalance")
    size = F.least(piece, F.col(CHANGE) - F.col("_piece") * piece)
    many = pieces.select(*columns, F.explode(F.sequence(F.lit(1).cast("bigint"), size)).alias("_i"))
    return once.unionByName(many.select(*columns))


def _digest(columns):
    return F.xxhash64(*sorted(columns)).cast("decimal(20,0)")


def fingerprint(df):
    """Row count and an order-free checksum, in one row."""
    digest = _digest(df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("checksum"),
    )


def same_contents(left, right):
    """One row: counts and checksums of both sides and whether they agree."""
    a = fingerprint(left).select(F.struct("*").alias("l"), F.lit(1).alias("one"))
    b = fingerprint(right).select(F.struct("*").alias("r"), F.lit(1).alias("one"))
    return a.join(b, "one").select(
        F.col("l.row_count").alias("left_rows"), F.col("r.row_count").alias("right_rows"),
        (F.col("l") == F.col("r")).alias("same"),
    )


def keyed_changes(old, new, key):
    """Keys that were added, removed or changed."""
    rest = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("_a"))
    b = new.select(*key, F.struct(*rest).alias("_b"))
    kind = (
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    )
    joined = a.join(b, key, "full_outer").withColumn("kind", kind)
    return joined.filter(F.col("kind").isNotNull()).select(*key, "kind")


# --- snapshots -----------------------------------------------------------------------------------

def schema_id(df):
    """Text of a table's column names and types."""
    return ", ".join(f"{name} {kind}" for name, kind in sorted(df.dtypes))


def catalog_of(spark, root, table=None):
    """Snapshots below ``root`` that have not been deleted; none before the first."""
    runs = catalogue.scan_manifests(spark, f"{root}/manifests", [table] if table else None)
    if files.exists(spark, f"{root}/deleted"):
        gone = spark.read.schema("profile string, run_id string").json(f"{root}/deleted")
        runs = runs.join(gone, ["profile", "run_id"], "left_anti")
    return runs


def _newest(runs):
    """The newest manifest as a row, None without any."""
    return runs.orderBy(*[F.desc(c) for c in retention.ORDER]).first()


def _tree_path(root, run):
    return run["artifact_path"].replace(f"{root}/data/", f"{root}/trees/", 1)


def tree(spark, root, run):
    """Checksums of a snapshot's buckets and of the groups above them."""
    return index.read_tree(spark.read.schema(index.TREE_SCHEMA).parquet(_tree_path(root, run)))


def snapshot(spark, df, table, root, started_at, mode=FULL, run_id=None, buckets=index.BUCKETS):
    """Take a snapshot of ``df`` as ``table``; returns its run id.

    Without a run to build on, a differential or incremental snapshot becomes a full one. A full one keeps the
    rows in ``buckets`` by their digest; later ones follow its number.
    """
    if mode not in (FULL, DIFFERENTIAL, INCREMENTAL):
        raise KeeperError(f"unknown snapshot mode {mode!r}")
    parent = None
    if mode != FULL:
        earlier = catalog_of(spark, root, table)
        parent = _newest(earlier.where(F.col("backup_type") == FULL) if mode == DIFFERENTIAL else earlier)
    run_id = run_id or uuid.uuid4().hex[:12]
    run_dir = f"{started_at:%Y%m%dT%H%M%S}_{run_id}"
    path = f"{root}/data/{table}/{run_dir}"
    if parent is None:
        mode, chain, parts = FULL, [], [path]
        index.write_indexed(index.with_digest(df, buckets), path)
        leaves = index.leaves(index.read_indexed(spark, path, df.schema))
    else:
        if parent["metadata"]["schema"] != schema_id(df):
            raise KeeperError(f"columns of {table!r} changed, take a full snapshot")
        buckets = int(parent["metadata"]["buckets"])
        chain = [*parent["chain"], parent["run_id"]]
        new = counted(index.with_digest(df, buckets))
        index.write_changes(_indexed(spark, root, table, parent, df.schema), new, path)
        parts = [*_parts(spark, root, table, parent), path]
        # what was written says how the checksums move
        delta = index.read_indexed(spark, path, _with_change(df.schema))
        before = spark.read.schema(index.TREE_SCHEMA).parquet(_tree_path(root, parent))
        leaves = index.leaves(delta, F.col(CHANGE)).unionByName(
            before.where(F.col("level") == index.depth_of(buckets)).select("node", *index.SUMS))
    nodes = index.tree_of(leaves, buckets)
    index.tree_rows(spark, nodes).coalesce(1).write.parquet(_tree_path(root, {"artifact_path": path}))
    row_count, *sums = index.root_of(nodes)
    stamp = f"{started_at:%H:%M:%S %Y-%m-%d}"
    row = {
        "run_id": run_id, "profile": table, "db_type": "table", "backup_type": mode,
        "started_at": stamp, "finished_at": stamp, "duration_ms": 0, "artifact_path": path,
        "compression": "chunked" if parent else "none", "source": {"table": table},
        "metadata": {
            "schema": schema_id(df), "row_count": str(row_count), "checksum": ":".join(map(str, sums)),
            "parts": json.dumps(parts), "buckets": str(buckets), "fields": df.schema.json(),
        },
        "parent_run_id": parent["run_id"] if parent else None, "chain": chain,
    }
    manifest = spark.createDataFrame([row], catalogue.MANIFEST_SCHEMA)
    catalogue.write_manifests(manifest, f"{root}/manifests")
    return run_id


def _find(spark, root, table, run_id):
    wanted = (F.col("run_id") == run_id) | (F.col("artifact_path") == run_id)
    row = _newest(catalog_of(spark, root, table).where(wanted))
    if row is None:
        raise KeeperError(f"no snapshot {run_id!r} of {table!r}")
    return row


def _latest(spark, root, table):
    row = _newest(catalog_of(spark, root, table))
    if row is None:
        raise KeeperError(f"no snapshots of {table!r}")
    return row


def _schema(run):
    return T.StructType.fromJson(json.loads(run["metadata"]["fields"]))


def _with_change(schema):
    return T.StructType([*schema.fields, T.StructField(CHANGE, T.LongType())])


def _parts(spark, root, table, run):
    """Folders a snapshot is made of: a full one and the changes after it."""
    if "parts" in run["metadata"]:
        return json.loads(run["metadata"]["parts"])
    chain = catalog_of(spark, root, table).where(F.col("run_id").isin(list(run["chain"])))
    by_id = {r["run_id"]: r["artifact_path"] for r in chain.select("run_id", "artifact_path").collect()}
    lost = [r for r in run["chain"] if r not in by_id]
    if lost:
        raise KeeperError(f"snapshot {run['run_id']!r} needs deleted snapshot {lost[0]!r}")
    return [by_id[r] for r in run["chain"]] + [run["artifact_path"]]


def _read_parts(spark, root, table, run, schema, buckets=None):
    full, *deltas = _parts(spark, root, table, run)
    base = index.read_indexed(spark, full, schema, buckets)
    changed = [index.read_indexed(spark, path, _with_change(schema), buckets) for path in deltas]
    return base, functools.reduce(DataFrame.unionByName, changed) if changed else None


def _indexed(spark, root, table, run, schema, buckets=None):
    """Indexed rows of a snapshot with their copies; a row may come in several pieces that add up."""
    base, deltas = _read_parts(spark, root, table, run, schema, buckets)
    return counted(base) if deltas is None else counted(base).unionByName(deltas)


def _contents(spark, root, table, run, buckets=None):
    """Rows of a snapshot. Only rows that a later change touches are exchanged."""
    base, deltas = _read_parts(spark, root, table, run, _schema(run), buckets)
    columns = index.plain_columns(base)
    if deltas is None:
        return base.select(*columns)
    same, touched = index.apply_deltas(base, deltas)
    return same.select(*columns).unionByName(expand_copies(touched.select(*columns, CHANGE)))


def contents(spark, root, table, run_id):
    """Rows of the table as one snapshot saw them."""
    return _contents(spark, root, table, _find(spark, root, table, run_id))


def stored_changes(spark, root, table, run_id):
    """Rows that a differential or incremental snapshot stored, with their change in copies."""
    run = _find(spark, root, table, run_id)
    if run["backup_type"] == FULL:
        raise KeeperError(f"snapshot {run_id!r} is a full one")
    rows = index.read_indexed(spark, run["artifact_path"], _with_change(_schema(run)))
    return rows.select(*index.plain_columns(rows), CHANGE)


def restore(spark, root, table, run_id, target, like=None):
    """Replace the table at ``target`` by a snapshot; ``like`` is a DataFrame it must match."""
    run = _find(spark, root, table, run_id)
    if like is not None and run["metadata"]["schema"] != schema_id(like):
        raise KeeperError(f"snapshot {run_id!r} does not match the columns of the target")
    replace_table(_contents(spark, root, table, run), target)


def prune(spark, root, plan, log, timestamp):
    """Delete the snapshots of a deletion plan and log each; returns the snapshots that are left.

    Data that a remaining snapshot builds on stays until that one goes too, so each of them can be restored.
    The deletions are noted before data goes; the next call finishes what one that was cut off left.
    """
    plan = checkpoint(plan.withColumn("run_dir", F.col("artifact_path")))
    if not plan.isEmpty():
        event_log.append_events(retention.deletion_log(plan, timestamp), log)
        plan.select("profile", "run_id").write.mode("append").json(f"{root}/deleted")
    left = catalog_of(spark, root)
    parts = F.from_json(F.col("metadata")["parts"], "array<string>")
    needed = left.select(F.explode(parts).alias("path"))
    written = catalogue.scan_manifests(spark, f"{root}/manifests").select(F.col("artifact_path").alias("path"))
    files.delete_folders(spark, written.join(needed, "path", "left_anti"))
    trees = F.replace(F.col("path"), F.lit(f"{root}/data/"), F.lit(f"{root}/trees/"))
    gone = written.join(left.select(F.col("artifact_path").alias("path")), "path", "left_anti")
    files.delete_folders(spark, gone.select(trees))
    return left


# --- comparison through the trees ------------------------------------------------------------------

def changes_between(spark, root, table, older, newer):
    """(changed rows with their change in copies, buckets read) between two snapshots of a table.

    Trees are compared from the root down; rows are read only in buckets that differ.
    """
    a, b = (_find(spark, root, table, run_id) for run_id in (older, newer))
    if a["metadata"]["schema"] != b["metadata"]["schema"]:
        raise KeeperError(f"columns of {table!r} changed between the snapshots")
    schema, n = _schema(a), int(a["metadata"]["buckets"])
    if int(b["metadata"]["buckets"]) != n:
        raise KeeperError("the snapshots have different numbers of buckets")
    buckets = index.differing_buckets(tree(spark, root, a), tree(spark, root, b), n)
    old, new = (_indexed(spark, root, table, run, schema, buckets) for run in (a, b))
    changed = index.changes(old, new)
    return changed.select(*index.plain_columns(changed), CHANGE), buckets


def changes_since(spark, root, table, run_id, df):
    """The same between a snapshot and the rows of ``df``, which is read once for its tree, and once more if
    any bucket differs."""
    run = _find(spark, root, table, run_id)
    if run["metadata"]["schema"] != schema_id(df):
        raise KeeperError(f"snapshot {run_id!r} does not match the columns of the table")
    n = int(run["metadata"]["buckets"])
    rows = index.with_digest(df, n)
    live = index.tree_of(index.leaves(rows), n)
    buckets = index.differing_buckets(tree(spark, root, run), live, n)
    old = _indexed(spark, root, table, run, df.schema, buckets)
    changed = index.changes(old, counted(rows.where(F.col(index.BUCKET).isin(buckets))))
    return changed.select(*index.plain_columns(changed), CHANGE), buckets


def select_names(tables=None, collections=None, database=None):
    """Names asked for, blanks dropped; None means everything.

    Collection names without a dot get the database in front.
    """
    named = [n.strip() for n in tables or [] if n.strip()]
    grouped = [n.strip() for n in collections or [] if n.strip()]
    if named and grouped:
        raise KeeperError("give tables or collections, not both")
    if grouped:
        return [n if "." in n or not database else f"{database}.{n}" for n in grouped]
    return named or None


def restore_selected(spark, root, target, names=None):
    """Restore the newest snapshot of the chosen tables below ``target``; returns their names."""
    newest = latest_runs(catalog_of(spark, root))
    if names is not None:
        wanted = spark.createDataFrame([(n,) for n in names], "profile string")
        newest = newest.join(wanted, "profile", "left_semi")
    found = {r["profile"]: r for r in newest.collect()}
    lost = sorted(set(names or []) - set(found))
    if lost:
        raise KeeperError(f"no snapshot of table {lost[0]!r}")
    for table, run in sorted(found.items()):
        replace_table(_contents(spark, root, table, run), f"{target}/{table}")
    return sorted(found)


# --- verification ----------------------------------------------------------------------------------

RESULT_SCHEMA = (
    "profile string, profiles array<string>, target_profile string, db_type string, backup_type string, "
    "run_id string, artifact_path string, started_at string, finished_at string, duration_ms bigint, "
    "row_count bigint, buckets_checked int, buckets_differing int, restore_status string, "
    "comparison_status string, status string"
)


def verification_target(settings, source, explicit=None):
    """Name of the profile to verify ``source`` in: the explicit one over the configured one.

    ``settings`` has (db_type, verification target or None) by profile. The target must be another profile of
    the same type.
    """
    for name in (source, explicit):
        if name is not None and name not in settings:
            raise KeeperError(f"unknown profile {name!r}")
    kind, configured = settings[source]
    target = explicit or configured
    if not target:
        raise KeeperError(f"profile {source!r} has no verification target")
    if target not in settings:
        raise KeeperError(f"unknown profile {target!r}")
    if target == source:
        raise KeeperError("the verification target must be another profile")
    if settings[target][0] != kind:
        raise KeeperError(f"verification needs one type, {source!r} has {kind!r}, {target!r} has {settings[target][0]!r}")
    return target


def _stamp(moment):
    return f"{moment:%H:%M:%S %Y-%m-%d}"


def verify_latest(spark, root, table, target, source=None, target_profile=None, log=None):
    """Restore the newest snapshot into the folder ``target`` and compare; returns one result row.

    The tree of the restored rows is compared with the one stored with the snapshot, and then with the tree of
    ``source`` where that is given; of its rows nothing else is read. With ``log``, the events
    ``verification.started`` and ``verification.completed`` or ``verification.failed`` are appended; an error is
    logged as the latter and raised.
    """
    if target.startswith(f"{root}/"):
        raise KeeperError("verification needs a target outside the snapshot folder")
    run = _latest(spark, root, table)
    target_profile = target_profile or target.rstrip("/").rsplit("/", 1)[-1]
    about = {"profile": table, "profiles": [table, target_profile], "target_profile": target_profile,
             "run_id": run["run_id"], "artifact_path": run["artifact_path"]}

    def tell(event, **more):
        if log is not None:
            line = json.dumps({"event": event, "payload": {**about, **more}, "timestamp": _stamp(_now())}, sort_keys=True)
            spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(log)

    tell("verification.started")
    started = _now()
    try:
        replace_table(_contents(spark, root, table, run), target)
        n = int(run["metadata"]["buckets"])

        def live(df):
            return index.tree_of(index.leaves(index.with_digest(df, n)), n)

        stored = tree(spark, root, run)
        restored = live(spark.read.schema(_schema(run)).parquet(target))
        differing = set(index.differing_buckets(stored, restored, n))
        if source is not None:
            differing |= set(index.differing_buckets(stored, live(source), n))
    except Exception as error:
        tell("verification.failed", error=str(error)[:2000])
        raise
    finished = _now()
    status = "failed" if differing else "verified"
    result = {
        **about, "db_type": run["db_type"], "backup_type": run["backup_type"], "started_at": _stamp(started),
        "finished_at": _stamp(finished), "duration_ms": int((finished - started).total_seconds() * 1000),
        "row_count": index.root_of(restored)[0], "buckets_checked": n, "buckets_differing": len(differing),
        "restore_status": "completed", "comparison_status": "differs" if differing else "same", "status": status,
    }
    if differing:
        tell("verification.failed", error=f"{len(differing)} of {n} buckets differ")
    else:
        tell("verification.completed", **{k: v for k, v in result.items() if k not in about})
    return spark.createDataFrame([result], RESULT_SCHEMA)


def _now():
    return datetime.datetime.now(datetime.timezone.utc)


def verify_profile(spark, root, source, settings, places, explicit=None, table_now=None, log=None):
    """``verify_latest`` of profile ``source`` in the folder that ``places`` has for its verification target."""
    target = verification_target(settings, source, explicit)
    return verify_latest(spark, root, source, places[target], table_now, target, log)
