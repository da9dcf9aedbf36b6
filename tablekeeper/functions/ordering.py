"""Ordered work on groups that may be very large.

A plain window sends a whole group to one task. ``newest_per_group`` ranks inside salted parts
first, so the last ranking only sees a few rows per part. ``running`` cuts groups that are too large
for one task into ordered slices and carries one summary row per slice into the next.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablekeeper.session import checkpoint

ROWS_PER_TASK = 5_000_000


def salt_column(df, spread):
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64(*spread), F.lit(max(parts, 2)))


def newest_per_group(df, group, order, k, spread, limit=None):
    """The first ``k`` rows of each group in ``order``, with their ``rank`` (bigint).

    ``order`` must be total. ``spread`` names columns that differ within a group. ``limit`` may name
    a column holding a bound per row (NULL: none); it holds together with ``k``, or alone where ``k`` is None.
    """
    keep = F.lit(True) if k is None else F.col("rank") <= k
    if limit is not None:
        keep &= F.col("rank") <= F.coalesce(F.col(limit), F.col("rank"))
    parts = Window.partitionBy(*group, "_salt").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_salt", salt_column(df, spread))
        .withColumn("rank", F.row_number().over(parts))
        .filter(keep)
        .drop("_salt")
        .withColumn("rank", F.row_number().over(whole))
        .filter(keep)
        .withColumn("rank", F.col("rank").cast("bigint"))
    )


def group_sizes(df, group):
    """(largest group, all rows), counted with map-side combine."""
    row = df.groupBy(*group).count().agg(F.max("count"), F.sum("count")).first()
    return (row[0] or 0), (row[1] or 0)


def running(df, group, order, outputs, rows_per_task=ROWS_PER_TASK, sizes=None):
    """Running values over each group in ascending, unique ``order``.

    ``outputs`` maps a new column to ``(kind, column, inclusive)`` where kind is ``last`` or
    ``first`` (non-NULL value so far), ``max``, ``sum`` or ``count``. ``sizes`` may hand on the
    ``group_sizes`` of the same rows.
    """
    largest, total = sizes or group_sizes(df, group)
    if largest <= rows_per_task:
        return _over_window(df, group, order, outputs)
    slices = max(math.ceil(total / rows_per_task), 2)
    return _over_slices(df, group, order, outputs, slices)


def _over_window(df, group, order, outputs):
    base = Window.partitionBy(*group).orderBy(*order)
    for name, (kind, column, inclusive) in outputs.items():
        frame = base.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        df = df.withColumn(name, _over(kind, column, frame))
    return df


def _over(kind, column, frame):
    value = _value(kind, column).over(frame)
    return F.coalesce(value, F.lit(0)) if kind == "sum" else value


def _value(kind, column):
    if kind == "last":
        return F.last(column, ignorenulls=True)
    if kind == "first":
        return F.first(column, ignorenulls=True)
    if kind == "max":
        return F.max(column)
    if kind == "sum":
        return F.sum(column)
    return F.count(F.lit(1))


def _over_slices(df, group, order, outputs, slices):
    # The slice number comes from sampling, so it is fixed in a reliable checkpoint before use.
    cut = checkpoint(
        df.repartitionByRange(slices, *group, *order).withColumn("_slice", F.spark_partition_id())
    )
    summaries = []
    for name, (kind, column, _) in outputs.items():
        if kind in ("last", "first"):
            pick = F.max if kind == "last" else F.min
            place = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)],
                             F.col(column).alias("v"))
            summaries.append(pick(F.when(F.col(column).isNotNull(), place))["v"].alias(f"_c_{name}"))
        else:
            summaries.append(_value(kind, column).alias(f"_c_{name}"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = cut.groupBy(*group, "_slice").agg(*summaries)
    for name, (kind, _, _) in outputs.items():
        over = "sum" if kind == "count" else kind
        carry = carry.withColumn(f"_b_{name}", _over(over, f"_c_{name}", before))
    carry = carry.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_slice").alias("_s"),
        *[F.col(f"_b_{name}") for name in outputs],
    )
    local = _over_window(cut, [*group, "_slice"], order, outputs)
    match = F.col("_slice") == F.col("_s")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = local.join(carry, match, "left")
    for name, (kind, _, _) in outputs.items():
        here, earlier = F.col(name), F.col(f"_b_{name}")
        if kind == "last":
            value = F.coalesce(here, earlier)
        elif kind == "first":
            value = F.coalesce(earlier, here)
        elif kind == "max":
            value = F.greatest(here, earlier)
        else:
            value = here + F.coalesce(earlier, F.lit(0))
        joined = joined.withColumn(name, value)
    return joined.select(*df.columns, *outputs)
