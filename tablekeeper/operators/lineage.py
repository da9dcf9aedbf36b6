"""Which run builds on which: parents, chains and broken chains.

A catalogue row needs ``run_id``, the group columns, ``requested_mode`` and the order columns
(``finished_ms``, ``mtime_ms``, ``run_id``). Only chunked runs take part.
"""

from pyspark.sql import functions as F

from tablekeeper.functions.ordering import ROWS_PER_TASK, group_sizes, running

ORDER = ["finished_ms", "mtime_ms", "run_id"]
FULL, DIFFERENTIAL, INCREMENTAL = "full", "differential", "incremental"


def chunked(catalog):
    return catalog.filter(F.col("compression") == "chunked")


def resolve_parent(new_runs, catalog, group):
    """Effective type, parent and depth of each new run against the stored runs of its group.

    ``new_runs`` has run_id, the group and requested_mode; the catalogue also carries ``backup_type``
    (effective) and ``depth``. The newest run comes from one aggregate, not from sorting the group.
    """
    # every id once: one text for all new runs leaves no key to join by, and each run met each of them
    stored = chunked(catalog).join(new_runs.select("run_id").distinct(), "run_id", "left_anti")
    others = stored.select(
        *group, F.struct(*ORDER, F.col("depth").alias("depth")).alias("r"), "backup_type"
    )
    newest = others.groupBy(*group).agg(
        F.max(F.when(F.col("backup_type") == FULL, F.col("r"))).alias("_full"),
        F.max("r").alias("_any"),
    )
    mode = F.col("requested_mode")
    parent = F.when(mode == DIFFERENTIAL, F.col("_full")).when(mode == INCREMENTAL, F.col("_any"))
    joined = new_runs.join(newest, group, "left").withColumn("_p", parent)
    has = F.col("_p").isNotNull()
    return joined.select(
        "run_id", *group, "requested_mode",
        F.when(has, mode).otherwise(FULL).alias("backup_type"),
        F.col("_p.run_id").alias("parent_run_id"),
        F.coalesce(F.col("_p.depth") + 1, F.lit(0)).cast("bigint").alias("depth"),
    )


def lineage(catalog, group, rows_per_task=ROWS_PER_TASK):
    """Effective type, parent and depth (chain length) of every chunked run of a whole history.

    The chain itself is kept in short form: ``anchor_id`` is the full or differential run a stretch
    starts with, ``position`` the place in that stretch, ``root_id`` the first run of the chain.
    """
    mode = F.col("requested_mode")
    runs = chunked(catalog)
    sizes = group_sizes(runs, group)
    steps = running(
        runs.withColumn("_full", F.when(mode == FULL, F.col("run_id"))),
        group, ORDER,
        {
            "n": ("count", None, True),
            "_first": ("first", "run_id", True),
            "_last_full": ("last", "_full", False),
            "_previous": ("last", "run_id", False),
        },
        rows_per_task, sizes,
    )
    is_full = (mode == FULL) | (F.col("n") == 1)
    steps = (
        steps.withColumn("backup_type", F.when(is_full, FULL).otherwise(mode))
        .withColumn(
            "parent_run_id",
            F.when(is_full, F.lit(None).cast("string"))
            .when(mode == DIFFERENTIAL, F.coalesce("_last_full", "_first"))
            .otherwise(F.col("_previous")),
        )
        .withColumn("_anchor", F.when(
            F.col("backup_type") != INCREMENTAL,
            F.struct(
                F.col("run_id").alias("id"), "n",
                F.coalesce("parent_run_id", "run_id").alias("root"),
                F.when(F.col("backup_type") == FULL, 0).otherwise(1).alias("base"),
            ),
        ))
    )
    steps = running(steps, group, ORDER, {"_a": ("last", "_anchor", True)}, rows_per_task, sizes)
    position = F.col("n") - F.col("_a.n")
    depth = position + F.col("_a.base")
    return steps.select(
        *catalog.columns,
        *([] if "backup_type" in catalog.columns else ["backup_type"]),
        "parent_run_id", depth.alias("depth"), position.alias("position"),
        F.col("_a.id").alias("anchor_id"),
        F.when(depth > 0, F.col("_a.root")).alias("root_id"),
    )


def chain_members(history, wanted, group):
    """Chains of the wanted runs, one row per member, oldest first (``step`` from 0).

    ``history`` is the output of ``lineage``, ``wanted`` has run_id. A wanted run meets only its own
    stretch, so the output is as long as the chains asked for.
    """
    runs = history.join(wanted.select("run_id"), "run_id", "left_semi").select(
        *group, F.col("run_id").alias("for_run"), "anchor_id", "root_id",
        F.col("position").alias("_end"), F.col("depth").alias("_depth"),
    )
    stretch = history.select(
        *group, "anchor_id", F.col("run_id").alias("member"), F.col("position").alias("_at")
    )
    inside = runs.join(stretch, [*group, "anchor_id"]).filter(F.col("_at") < F.col("_end"))
    shift = F.col("_depth") - F.col("_end")
    members = inside.select("for_run", (F.col("_at") + shift).alias("step"), "member")
    # the full run a differential stretch builds on comes first
    base = runs.filter(shift == 1).select(
        "for_run", F.lit(0).cast("bigint").alias("step"), F.col("root_id").alias("member")
    )
    return members.unionByName(base)


def broken_chains(history, deleted, group, rows_per_task=ROWS_PER_TASK):
    """Remaining runs with a deleted run in their chain, and the nearest such run.

    Restores still work, as every manifest lists all its own blocks; this only reports.
    """
    sizes = group_sizes(history, group)
    gone = deleted.select("run_id", F.lit(True).alias("_gone"))
    marked = history.join(gone, "run_id", "left").withColumn(
        "_lost", F.when(F.col("_gone"), F.struct("position", "anchor_id", "run_id"))
    )
    full = F.struct("run_id", F.coalesce("_gone", F.lit(False)).alias("gone"))
    marked = marked.withColumn("_base", F.when(F.col("backup_type") == FULL, full))
    marked = running(
        marked, group, ORDER,
        {"_last_lost": ("last", "_lost", False), "_full": ("last", "_base", False)},
        rows_per_task, sizes,
    ).withColumn("_anchor_full", F.when(F.col("backup_type") == DIFFERENTIAL, F.col("_full")))
    marked = marked.withColumn("_is_anchor", F.col("position") == 0)
    own = F.when(F.col("_is_anchor"), F.coalesce(
        F.col("_anchor_full"), F.struct(F.lit("").alias("run_id"), F.lit(False).alias("gone"))
    ))
    marked = running(
        marked.withColumn("_own", own), group, ORDER, {"_under": ("last", "_own", True)},
        rows_per_task, sizes,
    )
    in_stretch = F.coalesce(F.col("_last_lost.anchor_id") == F.col("anchor_id"), F.lit(False))
    nearest = F.when(in_stretch & (F.col("position") > 0), F.col("_last_lost.run_id")).when(
        F.col("_under.gone"), F.col("_under.run_id")
    )
    return (
        marked.filter(F.col("_gone").isNull())
        .withColumn("nearest_missing", nearest)
        .filter(F.col("nearest_missing").isNotNull())
        .select(*group, "run_id", "depth", "nearest_missing")
    )
