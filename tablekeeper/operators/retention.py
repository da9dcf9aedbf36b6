"""Which runs to delete, by count and by age.

A catalogue row needs ``run_id``, ``profile``, the group columns, ``finished_ms`` and ``mtime_ms``.
"""

import uuid

from pyspark.sql import functions as F

from tablekeeper.errors import KeeperError
from tablekeeper.functions.ordering import newest_per_group
from tablekeeper.operators import chunks
from tablekeeper.session import checkpoint
from tablekeeper.sources import event_log, files

DAY_MS = 86_400_000
ORDER = ["finished_ms", "mtime_ms", "run_id"]


def check_policy(policy):
    """A policy sets at least one limit, and only positive ones."""
    limits = [policy.get("keep_last"), policy.get("max_age_days")]
    if all(v is None for v in limits):
        raise KeeperError("retention needs keep_last or max_age_days")
    if any(v is not None and v <= 0 for v in limits):
        raise KeeperError("retention limits must be positive")
    return policy


def resolve_policies(profiles, own, default=None):
    """Limits per profile: its own value over the default, limit by limit.

    ``profiles`` has profile; ``own`` is a list of settings (profile, keep_last, max_age_days).
    Profiles without any limit have no policy and drop out.
    """
    default = default or {}
    spark = profiles.sparkSession
    schema = "profile string, _keep bigint, _age bigint"
    rows = [(p["profile"], p.get("keep_last"), p.get("max_age_days")) for p in own]
    settings = spark.createDataFrame(rows, schema)
    joined = profiles.select("profile").join(settings, "profile", "left")

    def limit(column, name):
        return F.coalesce(column, F.lit(default.get(name))).cast("bigint").alias(name)

    for policy in [default, *own]:
        if any(policy.get(n) is not None for n in ("keep_last", "max_age_days")):
            check_policy(policy)
    resolved = joined.select(
        "profile", limit("_keep", "keep_last"), limit("_age", "max_age_days")
    )
    return resolved.filter(F.col("keep_last").isNotNull() | F.col("max_age_days").isNotNull())


def _newest():
    return [F.desc(c) for c in ORDER]


def over_count(catalog, policies, group):
    """Runs beyond the newest ``keep_last`` of their group."""
    ruled = catalog.join(policies.filter(F.col("keep_last").isNotNull()), "profile")
    kept = newest_per_group(
        ruled.select(*dict.fromkeys([*group, *ORDER, "keep_last"])), group, _newest(), None,
        ["run_id"], limit="keep_last",
    )
    # run ids are unique, so this join stays even however large one group is
    return ruled.select("run_id").join(kept.select("run_id"), "run_id", "left_anti")


def over_age(catalog, policies, as_of_ms):
    """Runs that finished before ``as_of`` less ``max_age_days``."""
    ruled = catalog.join(policies.filter(F.col("max_age_days").isNotNull()), "profile")
    cutoff = F.lit(as_of_ms) - F.col("max_age_days") * F.lit(DAY_MS)
    return ruled.filter(F.col("finished_ms") < cutoff).select("run_id")


def deletion_plan(catalog, policies, group, as_of_ms):
    """Runs to delete, each once with its sorted reasons."""
    reasons = (
        over_count(catalog, policies, group).withColumn("reason", F.lit("keep_last"))
        .unionByName(
            over_age(catalog, policies, as_of_ms).withColumn("reason", F.lit("max_age_days"))
        )
        .groupBy("run_id")
        .agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    )
    return catalog.join(reasons, "run_id")


def in_run_order(plan):
    return plan.orderBy("run_dir" if "run_dir" in plan.columns else "run_id")


def survivors(catalog, plan):
    return catalog.join(plan.select("run_id"), "run_id", "left_anti")


def deletion_log(plan, timestamp):
    """One ``retention.deleted`` event per deleted run; ``timestamp`` is a column or a text."""
    timestamp = F.lit(timestamp)
    run_dir = F.col("run_dir") if "run_dir" in plan.columns else F.col("run_id")
    return plan.select(
        timestamp.alias("timestamp"), F.lit("retention.deleted").alias("event"),
        F.struct("profile", "reasons", run_dir.alias("run_dir")).alias("payload"),
    )


# --- carrying a plan out ---------------------------------------------------------------------------
#
# A plan is noted as an intent beside the catalogue before anything is changed. Its steps can each be repeated:
# events go to a folder of the log that is named after the intent, the catalogue loses the runs that it still has,
# what the block store will lose is noted before blocks go. A marker ends the intent; the next call first
# finishes those without one.

CATALOG_SCHEMA = "run_id string, profile string, finished_ms bigint, mtime_ms bigint"


def _intents(spark, root):
    return [f"{root}/_retention/{name}" for name in files.names(spark, f"{root}/_retention")]


def open_intents(spark, root):
    """Folders of the plans that were noted and not carried out to the end, the oldest first."""
    return [
        path for path in _intents(spark, root)
        if files.complete(spark, f"{path}/plan") and not files.exists(spark, f"{path}/_done")
    ]


def note_intent(plan, root, timestamp, store=None):
    """Note a deletion plan; returns its folder, None if there is nothing to delete."""
    spark = plan.sparkSession
    run_dir = F.col("run_dir") if "run_dir" in plan.columns else F.col("run_id")
    plan = checkpoint(plan.select("run_id", "profile", "reasons", run_dir.alias("run_dir")))
    if plan.isEmpty():
        return None
    path = f"{root}/_retention/{len(_intents(spark, root)):010d}-{uuid.uuid4().hex[:12]}"
    plan.select(
        "*", F.lit(timestamp).alias("timestamp"), F.lit(store).cast("string").alias("store")
    ).write.parquet(f"{path}/plan")
    return path


def _plan_of(spark, path):
    return spark.read.parquet(f"{path}/plan")


def log_intent(spark, path, log):
    """Log each deletion of an intent, once."""
    plan = _plan_of(spark, path)
    name = path.rsplit("/", 1)[1]
    event_log.append_events_once(deletion_log(plan, F.col("timestamp")), log, f"retention-{name}-deleted")


def publish_intent(spark, path, root):
    """Publish the catalogue without the runs of an intent, if it still has any."""
    plan, catalog = _plan_of(spark, path), files.current(spark, root)
    if not catalog.join(plan.select("run_id"), "run_id", "left_semi").isEmpty():
        files.publish(survivors(catalog, plan), root)


def collect_intent(spark, path, root, log, manifests):
    """Remove the blocks that no run of the catalogue needs, and log how many each profile lost, once."""
    plan = _plan_of(spark, path)
    timestamp, store = plan.select("timestamp", "store").first()
    if store is None:
        return
    if manifests is None:
        raise KeeperError("a noted deletion needs the block manifests to be finished")
    needed = manifests.join(files.current(spark, root).select("run_id"), "run_id", "left_semi")
    noted = f"{path}/garbage"
    if not files.complete(spark, noted):
        garbage = chunks.garbage(chunks.read_store(spark, store), needed)
        garbage.groupBy("profile").agg(F.count(F.lit(1)).alias("chunks_deleted")).write.mode("overwrite").parquet(noted)
    chunks.collect_garbage(spark, store, needed)
    lost = spark.read.schema("profile string, chunks_deleted bigint").parquet(noted)
    if not lost.isEmpty():
        event_log.append_events_once(lost.select(
            F.lit(timestamp).alias("timestamp"), F.lit("retention.chunks_gc").alias("event"),
            F.struct("profile", "chunks_deleted").alias("payload"),
        ), log, f"retention-{path.rsplit('/', 1)[1]}-chunks")


def carry_out(spark, path, root, log, manifests=None):
    """All steps of one intent; those that were done before are passed over or change nothing."""
    log_intent(spark, path, log)
    publish_intent(spark, path, root)
    collect_intent(spark, path, root, log, manifests)
    files.mark(spark, f"{path}/_done")


def apply_retention(spark, root, policies, group, as_of_ms, log, timestamp, store=None, manifests=None):
    """Carry out the deletion plan of the catalogue published at ``root``; returns the remaining catalogue.

    Each deletion is logged, the remaining catalogue is published, and blocks that no remaining run references
    leave the block store at ``store`` (``manifests``: run_id, profile, hash of all runs), with one
    ``retention.chunks_gc`` event per profile that lost blocks. Without deletions nothing is written. A call that
    was cut off is finished by the next one, whatever that one deletes itself; each event is logged once. One
    call at a time may change a catalogue. A catalogue that was never published is empty.
    """
    for path in open_intents(spark, root):
        carry_out(spark, path, root, log, manifests)
    catalog = files.current(spark, root)
    if catalog is None:
        more = "".join(f", {name} string" for name in group if f"{name} " not in CATALOG_SCHEMA)
        return spark.createDataFrame([], CATALOG_SCHEMA + more)
    path = note_intent(deletion_plan(catalog, policies, group, as_of_ms), root, timestamp, store)
    if path is not None:
        carry_out(spark, path, root, log, manifests)
    return files.current(spark, root)


def policy_summary(catalog, policies, plan):
    """Limits, runs and runs to delete per profile that has a policy or runs; nothing is deleted."""
    n = F.count(F.lit(1))
    totals = catalog.groupBy("profile").agg(n.alias("total_runs"))
    pending = plan.groupBy("profile").agg(n.alias("_pending"))
    return (
        totals.join(policies.withColumn("_set", F.lit(True)), "profile", "full")
        .join(pending, "profile", "left")
        .select(
            "profile", F.coalesce("_set", F.lit(False)).alias("configured"), "keep_last",
            "max_age_days", F.coalesce("total_runs", F.lit(0)).alias("total_runs"),
            F.coalesce("_pending", F.lit(0)).alias("pending_deletions"),
        )
    )
