"""Fixed windows per key, opened by the first event after the last window ended.

An event opens a window when it is later than the end of the open one; the first ``limit`` events of
a window are allowed, denied ones do not count.
"""

import math

import numpy as np
from pyspark.sql import functions as F

from tablekeeper.functions.ordering import ROWS_PER_TASK, group_sizes, running
from tablekeeper.session import checkpoint

WINDOW_MS = 60_000
LIMIT = 5


def throttle(events, window_ms=WINDOW_MS, limit=LIMIT, rows_per_task=ROWS_PER_TASK):
    """Events (``key, at, id``) with ``allowed``.

    Ordinary keys are walked through in order, many keys per task. Keys with more events than one
    task should see go another, exact way that never orders a whole key in one place.
    """
    return windows(events, window_ms, limit, rows_per_task).drop("opened")


def windows(events, window_ms=WINDOW_MS, limit=LIMIT, rows_per_task=ROWS_PER_TASK, ties=("id",)):
    """Events with ``opened`` (when their window began) and ``allowed``; ``ties`` order those of one time."""
    ties = list(ties)
    sizes = events.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > rows_per_task).select("key")
    if large.isEmpty():
        return _walk(events, window_ms, limit, ties)
    ordinary = events.join(large, "key", "left_anti")
    hot = events.join(large, "key", "left_semi")
    return _walk(ordinary, window_ms, limit, ties).unionByName(
        _jump(hot, window_ms, limit, rows_per_task, ties)
    )


# --- ordinary keys -------------------------------------------------------------------------------

def _walker(window_ms, limit):
    def walk(batches):
        key, reset, used = None, -1, 0
        for batch in batches:
            at = batch["at"].to_numpy()
            keys = batch["key"].to_numpy()
            allowed, opened = np.zeros(len(batch), dtype=bool), np.zeros(len(batch), dtype=np.int64)
            ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(batch))
            start = 0
            for end in ends:
                if end == start:
                    continue
                if keys[start] != key:
                    key, reset = keys[start], None
                while start < end:
                    if reset is None or at[start] > reset:
                        reset, used = at[start] + window_ms, 0
                    stop = start + int(np.searchsorted(at[start:end], reset, side="right"))
                    take = min(limit - used, stop - start)
                    allowed[start : start + take] = True
                    opened[start:stop] = reset - window_ms
                    used += take
                    start = stop
            yield batch.assign(opened=opened, allowed=allowed)

    return walk


def _walk(events, window_ms, limit, ties):
    ordered = events.repartition("key").sortWithinPartitions("key", "at", *ties)
    fields = ", ".join(f"{name} {kind}" for name, kind in events.dtypes)
    return ordered.mapInPandas(_walker(window_ms, limit), f"{fields}, opened long, allowed boolean")


# --- very large keys -----------------------------------------------------------------------------

def _next_opening(times, window_ms, rows_per_task):
    """For each distinct time of a key the first one after the window it would open."""
    marks = times.select("key", "at", (-F.col("at")).alias("_back"), F.lit(1).alias("_kind"))
    probes = times.select(
        "key", "at", (-(F.col("at") + window_ms)).alias("_back"), F.lit(0).alias("_kind")
    )
    both = marks.unionByName(probes).withColumn(
        "_mark", F.when(F.col("_kind") == 1, F.col("at"))
    )
    # times run backwards: the last mark before a probe is the first time after its window
    seen = running(both, ["key"], ["_back", "_kind", "at"], {"_next": ("last", "_mark", False)},
                   rows_per_task)
    return seen.filter(F.col("_kind") == 0).select("key", "at", F.col("_next").alias("to"))


def _openings(times, window_ms, rows_per_task):
    """Times that open a window, by following jumps that double in length each round."""
    span = times.groupBy("key").agg((F.max("at") - F.min("at")).alias("s")).agg(F.max("s")).first()[0]
    rounds = max(1, math.ceil(math.log2((span or 0) / window_ms + 2)))
    jump = checkpoint(_next_opening(times, window_ms, rows_per_task))
    opened = times.groupBy("key").agg(F.min("at").alias("at"))
    for _ in range(rounds):
        further = opened.join(jump, ["key", "at"]).filter(F.col("to").isNotNull())
        opened = checkpoint(opened.unionByName(further.select("key", F.col("to").alias("at"))).distinct())
        then = jump.select("key", F.col("at").alias("to"), F.col("to").alias("_then"))
        jump = checkpoint(
            jump.join(then, ["key", "to"], "left").select("key", "at", F.col("_then").alias("to"))
        )
    return opened


def _jump(events, window_ms, limit, rows_per_task, ties):
    times = checkpoint(events.groupBy("key", "at").agg(F.min(F.struct(*ties)).alias("_tie")).select(
        "key", "at", "_tie.*"))
    opened = _openings(times.select("key", "at"), window_ms, rows_per_task)
    # the opening event is the first one at that time
    first = times.join(opened, ["key", "at"]).select("key", "at", *ties, F.lit(True).alias("_opens"))
    sizes = group_sizes(events, ["key"])
    numbered = running(
        _left(events, first, ["key", "at", *ties]), ["key"], ["at", *ties],
        {"_n": ("count", None, True)}, rows_per_task, sizes,
    ).withColumn("_start", F.when(F.col("_opens"), F.struct(F.col("_n").alias("n"), F.col("at").alias("at"))))
    placed = running(
        numbered, ["key"], ["at", *ties], {"_from": ("last", "_start", True)}, rows_per_task,
        sizes,
    )
    allowed = F.col("_n") - F.col("_from.n") < limit
    return placed.select(*events.columns, F.col("_from.at").alias("opened"), allowed.alias("allowed"))


def _left(events, marks, names):
    """Events with the mark of the same row; NULLs match."""
    marks = marks.select(*[F.col(n).alias(f"_m_{n}") for n in names], "_opens")
    same = [F.col(n).eqNullSafe(F.col(f"_m_{n}")) for n in names]
    return events.join(marks, same, "left").drop(*[f"_m_{n}" for n in names])
