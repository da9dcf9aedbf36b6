"""Alert changes as a stream, also for servers that have gone silent.

Checks happen at fixed instants, as in ``operators.alerts.check_history``. A server is due
when the watermark passes its next instant, which other servers' reports (or a heartbeat) push on.
Servers are kept in groups by their hash, so that a batch reads, writes and sets the timer of a group once,
not of every server.
"""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tablekeeper.operators.alerts import DEFAULT_MAX_AGE_MS, first_instant
from tablekeeper.streaming.state import use_state_store

OUTPUT = (
    "server_id string, checked_at bigint, last_success bigint, last_status string, "
    "previous string, state string, kind string"
)
SHORT = "server_id string, at timestamp, n bigint, success bigint, reported bigint, run_id string, status string"
PENDING = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("success", T.LongType()),
    T.StructField("reported", T.LongType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("status", T.StringType()),
])
#: A checkpoint keeps to the number it began with.
GROUPS = 4096
GROUP = "_group"
# ``pending`` holds at most one entry per instant the watermark has not reached
SERVER = T.StructType([
    T.StructField("server_id", T.StringType()),
    T.StructField("next", T.LongType()),
    T.StructField("success", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("pending", T.ArrayType(PENDING)),
])
STATE = T.StructType([T.StructField("servers", T.ArrayType(SERVER))])


def _group():
    """The group of a server; a heartbeat has none. It is text, as pandas turns numbers beside NULLs into fractions."""
    number = F.pmod(F.xxhash64("server_id"), F.lit(GROUPS)).cast("string")
    return F.when(F.col("server_id").isNotNull(), number).alias(GROUP)


def _shorten(start, period):
    """Combine reports of one server and instant before they are sent to the server's task."""

    def shorten(batches):
        for batch in batches:
            at = batch["reported_at"]
            batch = batch.assign(
                n=-(-(at - start).clip(lower=0) // period),
                success=at.where(batch["status"] == "success").astype("Int64"),
            )
            batch = batch.sort_values(["reported_at", "run_id"])
            rows = batch.groupby(["server_id", "n"], as_index=False, dropna=False).agg(
                success=("success", "max"), reported=("reported_at", "last"),
                run_id=("run_id", "last"), status=("status", "last"),
            )
            stamp = pd.to_datetime(rows["reported"], unit="ms")
            yield rows.assign(at=stamp)[
                ["server_id", "at", "n", "success", "reported", "run_id", "status"]
            ]

    return shorten


def _number(value):
    return None if value is None or pd.isna(value) else int(value)


def _larger(a, b):
    return b if a is None else a if b is None else max(a, b)


class AlertProcessor(StatefulProcessor):
    def __init__(self, start, period, max_age, checks, by_arrival):
        self.start, self.period, self.max_age, self.checks = start, period, max_age, checks
        self.by_arrival = by_arrival

    def init(self, handle):
        self.handle = handle
        self.now = handle.getValueState("servers", STATE)

    def _read(self):
        """{server: (next instant, last success, last status, state, pending by instant)} of a group."""
        kept = self.now.get()
        if kept is None:
            return {}
        return {
            row[0]: (*tuple(row)[1:5], {p[0]: tuple(p)[1:] for p in row[5]}) for row in kept[0]
        }

    def _write(self, servers):
        self.now.update(([
            (name, *values, [(n, *news) for n, news in pending.items()])
            for name, (*values, pending) in servers.items()
        ],))

    def _instant(self, n):
        return self.start + n * self.period

    def handleInputRows(self, key, rows, timerValues):
        if key[0] is None:  # a heartbeat
            return
        servers, first_due = self._read(), None
        for batch in rows:
            columns = [batch[c].tolist() for c in ("server_id", "n", "success", "reported", "run_id", "status")]
            for server, n, reached, reported, run_id, result in zip(*columns):
                due, success, status, state, pending = servers.get(server) or (None, None, None, None, {})
                # what arrives after its instant was checked counts from the next check on
                n = int(n) if state is None else max(int(n), due)
                new = (_number(reached), int(reported), run_id, result)
                if n in pending:
                    old = pending[n]
                    newer = max(old, new, key=lambda r: (r[1], r[2]))
                    new = (_larger(old[0], new[0]), *newer[1:])
                pending[n] = new
                if state is None and (due is None or n < due):  # never checked so far
                    due = n
                    first_due = n if first_due is None else min(first_due, n)
                servers[server] = (due, success, status, state, pending)
        self._write(servers)
        if first_due is not None:
            self.handle.registerTimer(self._instant(first_due))
        return
        yield

    def handleInitialState(self, key, initialState, timerValues):
        """Enrolled servers: known from their first check on, without a run."""
        if key[0] is None:
            return
        servers, first_due = self._read(), None
        for server, n in zip(initialState["server_id"].tolist(), initialState["n"].tolist()):
            if server not in servers:
                servers[server] = (int(n), None, None, None, {})
                first_due = int(n) if first_due is None else min(first_due, int(n))
        if first_due is not None:
            self._write(servers)
            self.handle.registerTimer(self._instant(first_due))

    def _check(self, server, kept, now, changes):
        """What is kept of a server after its checks up to ``now``; adds its changes."""
        due, success, status, state, pending = kept
        while self._instant(due) <= now and (self.checks is None or due < self.checks):
            if due in pending:
                got = pending.pop(due)
                success, status = _larger(success, got[0]), got[3]
            at = self._instant(due)
            if success is None or at - success > self.max_age:
                new = "overdue"
            else:
                new = "failing" if status == "failed" else "ok"
            state = state or "ok"
            if new != state:
                kind = "problem" if state == "ok" else "recovered" if new == "ok" else None
                changes.append((server, at, success, status, state, new, kind))
            state, due = new, due + 1
        return due, success, status, state, pending

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        servers = self._read()
        if self.by_arrival:
            now = timerValues.getCurrentProcessingTimeInMs()
        else:
            now = timerValues.getCurrentWatermarkInMs()
        changes = []
        due = {
            server: self._check(server, kept, now, changes) for server, kept in servers.items()
            if self._instant(kept[0]) < now and (self.checks is None or kept[0] < self.checks)
        }
        if due:  # else another timer of the group came before
            servers.update(due)
            self._write(servers)
            left = [kept[0] for kept in servers.values() if self.checks is None or kept[0] < self.checks]
            if left:
                self.handle.registerTimer(self._instant(min(left)))
        if changes:
            columns = [part.split()[0] for part in OUTPUT.split(", ")]
            frame = pd.DataFrame(changes, columns=columns)
            yield frame.astype({"last_success": "Int64"})

    def close(self):
        pass


def alert_changes(
    reports, start, period, max_age=DEFAULT_MAX_AGE_MS, delay=None, checks=None, servers=None
):
    """State changes of a stream of reports (server_id, run_id, status, reported_at).

    Without ``delay`` checks follow the clock, as reports are stamped on arrival: nothing is dropped,
    and what comes in after a check counts from the next one. With ``delay`` checks follow the
    watermark, for replaying a history; reports later than that behind the newest one may be dropped.
    A heartbeat is a row without a server; it moves the watermark only. ``servers`` (``server_id``, ``since``) are
    checked from then on even if they never report; they are the state that the stream starts with.
    """
    use_state_store(reports.sparkSession)
    by_arrival = delay is None
    short = reports.select("server_id", "run_id", "status", "reported_at").mapInPandas(
        _shorten(start, period), SHORT
    )
    if not by_arrival:
        short = short.withWatermark("at", delay)
    processor = AlertProcessor(start, period, max_age, checks, by_arrival)
    mode = "processingTime" if by_arrival else "eventTime"
    enrolled = None
    if servers is not None:
        since = F.coalesce("since", F.lit(start)).cast("bigint")
        enrolled = servers.where(F.col("server_id").isNotNull()).select(
            _group(), "server_id", first_instant(since, start, period).alias("n")).groupBy(GROUP)
    return short.select("*", _group()).groupBy(GROUP).transformWithStateInPandas(
        processor, OUTPUT, "append", mode, initialState=enrolled)
