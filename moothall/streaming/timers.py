"""Streams whose keys have timers: jobs with leases and retries, and the next sync of each source.

Rows may come in any order within the watermark's delay. A key keeps them
until the watermark has passed them and then folds them in order of their
time, so that the outcome depends on neither files nor triggers; deadlines
that lie between two rows count at their own time. Times to live of state
count by the clock only, so finished and idle keys leave by the same timers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Folds a key's rows (at, event_id, kind) in order of time; `at` is in microseconds.

    Subclasses give the schema of what they keep of a key and the names of
    what they tell, `take` a row, state a `deadline` and `expire` at it. A key that keeps nothing and waits
    for nothing has no state.
    """

    kept = ""
    tells: tuple[str, ...] = ()

    def deadline(self, kept: tuple) -> int | None:
        raise NotImplementedError

    def take(self, kept: tuple | None, at: int, event_id: int, kind: str) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def expire(self, kept: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, kind string")
        self.own = handle.getValueState("own", self.kept)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [(r["at"], r["event_id"], r["kind"]) for r in rows]
        if new:
            self.waiting.appendList(new)
            self._wake(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
        own = tuple(self.own.get()) if self.own.exists() else None
        out: list[tuple] = []
        n = 0
        while True:
            row = held[n] if n < len(held) and held[n][0] <= passed else None
            end = self.deadline(own) if own else None
            if end is not None and end <= passed and (row is None or end < row[0]):
                own, new = self.expire(own, end)
            elif row is not None:
                own, new = self.take(own, *row)
                n += 1
            else:
                break
            out += new
        self.waiting.clear()
        if held[n:]:
            self.waiting.appendList(held[n:])
        if own:
            self.own.update(own)
        else:
            self.own.clear()
        nxt = [t for t in (held[n][0] if held[n:] else None, self.deadline(own) if own else None) if t is not None]
        if nxt:
            self._wake(min(nxt))
        told = Row(self.key, *self.tells)
        return iter([told(*key, *r) for r in out])

    def _wake(self, at: int) -> None:
        """Leave one timer, not later than this."""
        ms = -(-at // 1000)
        set_before = list(self.handle.listTimers())
        if set_before and min(set_before) <= ms:
            return
        for t in set_before:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms)


class _Job(NamedTuple):
    status: str
    retries: int
    priority: int
    until: int


class Jobs(InOrder):
    """A job is claimed (start), ends (done, fatal) or fails and is tried again (retry) with less priority, 20 a try more each time, until it's a dead letter.

    A claim without an outcome for `lease` goes stale and is pending again; a
    pending job that nothing happens to for `idle` is expired. Finished and
    expired jobs leave the state, and what comes later is a new job.
    """

    kept = "status string, retries long, priority long, until long"
    tells = ("event_id", "at", "status", "retries", "priority")

    def __init__(self, key: str, lease: int, idle: int, tries: int, priority: int) -> None:
        self.key = key
        self.lease, self.idle, self.tries, self.priority = lease, idle, tries, priority

    def deadline(self, kept: tuple) -> int | None:
        return kept[3]

    def take(self, kept, at, event_id, kind):
        job = _Job(*kept) if kept else _Job("pending", 0, self.priority, at + self.idle)
        if kind == "start":
            job = job._replace(status="processing", until=at + self.lease)
        elif kind == "done":
            job = job._replace(status="completed")
        elif kind == "fatal":
            job = job._replace(status="failed")
        elif job.retries + 1 < self.tries:
            job = _Job("pending", job.retries + 1, job.priority - 20 * (job.retries + 1), at + self.idle)
        else:
            job = job._replace(status="dead_letter", retries=job.retries + 1)
        said = [(event_id, at, job.status, job.retries, job.priority)]
        return (tuple(job) if job.status in ("pending", "processing") else None), said

    def expire(self, kept, at):
        job = _Job(*kept)
        if job.status == "processing":
            job = job._replace(status="pending", until=at + self.idle)
            return tuple(job), [(None, at, "pending", job.retries, job.priority)]
        return None, [(None, at, "expired", job.retries, job.priority)]


class Syncs(InOrder):
    """A source is due some time after its last sync, sooner after one that failed; what is due is told once."""

    kept = "due long, reason string"
    tells = ("at", "reason")

    def __init__(self, key: str, every: int, after_error: int) -> None:
        self.key = key
        self.every, self.after_error = every, after_error

    def deadline(self, kept: tuple) -> int | None:
        return kept[0]

    def take(self, kept, at, event_id, kind):
        return (at + (self.after_error if kind == "error" else self.every), kind), []

    def expire(self, kept, at):
        return None, [(at, kept[1])]


def _ordered(events: DataFrame, key: str, kind: Column, late: str):
    """The rows that have a key, a time and a kind, by key."""
    rows = events.select(key, "ts", "event_id", kind.alias("kind")).where(F.col(key).isNotNull() & F.col("ts").isNotNull() & F.col("kind").isNotNull())
    return rows.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("at"), "event_id", "kind").groupBy(key)


def job_changes(events: DataFrame, key: str, kind: Column, late: str = "1 day", lease: int = 30 * MINUTE, idle: int = 2 * DAY, tries: int = 3, priority: int = 100) -> DataFrame:
    """Each change of a job (key): (key, event_id, ts, status, retries, priority), of the stream's rows (ts, event_id) whose kind is start, done, retry or fatal.

    Changes by a timer have no event_id. Rows later than the watermark (which
    follows the rows that are taken), and those without key, time or kind, are
    left out; of rows at the same time
    the smaller event_id goes first, a null one before all; a repeated row
    counts again. Times are in microseconds.
    """
    schema = f"`{key}` {events.schema[key].dataType.simpleString()}, event_id long, at long, status string, retries long, priority long"
    out = _ordered(events, key, kind, late).transformWithState(Jobs(key, lease, idle, tries, priority), schema, "append", "eventTime")
    return out.select(key, "event_id", F.timestamp_micros("at").alias("ts"), "status", "retries", "priority")


def due_syncs(events: DataFrame, key: str, kind: Column, late: str = "1 day", every: int = DAY, after_error: int = 2 * HOUR) -> DataFrame:
    """When each source (key) is due again: (key, due, reason) of the stream's syncs (ts, event_id, kind: error or else); a sync before a source is due puts it off.

    What is late, null, at one time or repeated is handled as in `job_changes`.
    """
    schema = f"`{key}` {events.schema[key].dataType.simpleString()}, at long, reason string"
    out = _ordered(events, key, kind, late).transformWithState(Syncs(key, every, after_error), schema, "append", "eventTime")
    return out.select(key, F.timestamp_micros("at").alias("due"), "reason")
