"""Streams drained over the event files, and their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moothall.catalog import Catalog
from moothall.plans.registry import civic
from moothall.session import shared_folder
from moothall.streaming import events, timers


def drained(c: Catalog, stream: DataFrame, mode: str, provider: str | None = None) -> DataFrame:
    """What the stream has put out when all files are read: the last batch where each repeats the whole, else all of them, with their numbers (batch) where a row may replace an earlier one."""
    at = shared_folder(c.spark, "stream")
    last: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")
        last.append(batch)

    events.drain(stream, mode, write, f"{at}/checkpoint", provider)
    if not last:  # no file, no batch
        return c.spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0)) if mode == "update" else c.spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return c.spark.read.parquet(f"{at}/out/batch={last[-1]}")
    out = c.spark.read.parquet(f"{at}/out")
    return out if mode == "update" else out.drop("batch")


def source(c: Catalog) -> DataFrame:
    return events.read_events(c.spark, f"{c.sf_dir}/event[s].parquet")  # a pattern, as a table may be one file


@civic("str10_funnel_stream", "SELECT event AS event_type, count(*) AS n FROM ev GROUP BY 1")
def _(c: Catalog):
    return drained(c, events.funnel(source(c)), "complete")


@civic("str13_daily_windows_complete", "SELECT date_trunc('day', ts) AS start, event AS event_type, count(*) AS n FROM ev GROUP BY 1, 2")
def _(c: Catalog):
    stream = source(c).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return drained(c, stream, "complete").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@civic("str13_closed_windows_append", "SELECT start, event_type, n FROM (SELECT date_trunc('day', ts) AS start, event AS event_type, count(*) AS n FROM ev GROUP BY 1, 2), (SELECT max(ts) AS m FROM ev) WHERE start + INTERVAL 1 DAY <= m - INTERVAL 1 DAY")
def _(c: Catalog):
    return drained(c, events.window_counts(source(c)), "append").withColumn("start", F.col("start").cast("timestamp_ntz"))


@civic("str13_sessions_batch", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(j) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS j FROM events)) GROUP BY user_id, s")
def _(c: Catalog):
    e = c.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.sessions(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def _jobs_sql(tries: int) -> str:
    """Errors since the last purchase count; a job that once had `tries` of them is dead."""
    return f"""WITH s AS (SELECT user_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM events),
e AS (SELECT user_id, seg, count(*) FILTER (event_type = 'error') AS n FROM s GROUP BY 1, 2), l AS (SELECT user_id, max(seg) AS seg, max(n) AS worst FROM e GROUP BY 1)
SELECT l.user_id, CASE WHEN worst >= {tries} THEN {tries} ELSE e.n END AS failed, CASE WHEN worst >= {tries} THEN 'dead_letter' WHEN e.n > 0 OR l.seg = 0 THEN 'pending' ELSE 'completed' END AS status FROM l JOIN e ON e.user_id = l.user_id AND e.seg = l.seg"""


def last_states(c: Catalog, tries: int) -> DataFrame:
    rows = drained(c, events.retry_jobs(source(c), tries), "update")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("failed", "status"), F.col("batch")).alias("state")).select("user_id", "state.failed", "state.status")


@civic("str03_retried_jobs", _jobs_sql(3))
def _(c: Catalog):
    return last_states(c, 3)


@civic("str04_second_failure_path", _jobs_sql(4))
def _(c: Catalog):
    """One attempt more before a job is dead."""
    return last_states(c, 4)


@civic("str09_retained_events", "SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def _(c: Catalog):
    """Events appended once each, of the last seven days; the watermark bounds the ids that the stream remembers."""
    kept = drained(c, events.retained(source(c)), "append")
    until = kept.agg(F.max("ts")).first()[0]
    return kept.where(F.col("ts") >= F.lit(until) - F.expr("interval 7 day")).select("event_id", "user_id")


def _passed(kinds: str) -> str:
    """Until when a stream of these rows, with a day's delay, has folded them at the end."""
    return f"SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY AS w FROM ev WHERE event IN ({kinds})"


_SYNCS, _JOBS = "'purchase', 'error'", "'click', 'purchase', 'error'"


@civic("str02_due_syncs", f"SELECT visitor, ts + wait AS due, event AS reason FROM (SELECT visitor, ts, event, CASE event WHEN 'error' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 DAY END AS wait, lead(ts) OVER (PARTITION BY visitor ORDER BY ts, event_id) AS next FROM ev WHERE event IN ({_SYNCS})), ({_passed(_SYNCS)}) WHERE ts + wait <= w AND coalesce(next > ts + wait, true)")
def _(c: Catalog):
    """A visitor stands for a source, an error for a sync that failed, a purchase for one that didn't."""
    kind = F.when(F.col("event_type").isin("purchase", "error"), F.col("event_type"))
    due = drained(c, timers.due_syncs(source(c), "user_id", kind), "append", timers.PROVIDER)
    return due.select(F.col("user_id").alias("visitor"), F.col("due").cast("timestamp_ntz").alias("due"), "reason")


@civic("str03_job_changes", f"""WITH e AS (SELECT visitor, event_id, ts, CASE WHEN event = 'click' THEN 'start' WHEN event = 'purchase' THEN 'done' WHEN k % 4 = 0 THEN 'fatal' ELSE 'retry' END AS kind FROM ev, ({_passed(_JOBS)}) WHERE event IN ({_JOBS}) AND ts <= w),
n AS (SELECT *, lead(ts) OVER o AS next, CASE WHEN lag(kind) OVER o IN ('done', 'fatal') THEN 1 WHEN lag(kind) OVER o = 'start' AND ts - lag(ts) OVER o > INTERVAL 2 DAY + INTERVAL 30 MINUTE THEN 1 WHEN lag(kind) OVER o = 'retry' AND ts - lag(ts) OVER o > INTERVAL 2 DAY THEN 1 ELSE 0 END AS fresh FROM e WINDOW o AS (PARTITION BY visitor ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY visitor ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM n),
r AS (SELECT *, count(*) FILTER (kind = 'retry') OVER (PARTITION BY visitor, seg ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m FROM g),
s AS (SELECT *, CASE WHEN kind = 'retry' THEN (m - 1) % 3 + 1 ELSE m % 3 END AS retries FROM r),
p AS (SELECT *, CASE retries WHEN 0 THEN 100 WHEN 1 THEN 80 ELSE 40 END AS priority FROM s)
SELECT visitor, event_id, ts, CASE WHEN kind = 'start' THEN 'processing' WHEN kind = 'done' THEN 'completed' WHEN kind = 'fatal' THEN 'failed' WHEN retries = 3 THEN 'dead_letter' ELSE 'pending' END AS status, retries, priority FROM p
UNION ALL SELECT visitor, NULL, ts + INTERVAL 30 MINUTE, 'pending', retries, priority FROM p, ({_passed(_JOBS)}) WHERE kind = 'start' AND ts + INTERVAL 30 MINUTE <= w AND coalesce(next > ts + INTERVAL 30 MINUTE, true)
UNION ALL SELECT visitor, NULL, x, 'expired', retries, priority FROM (SELECT *, ts + CASE kind WHEN 'start' THEN INTERVAL 2 DAY + INTERVAL 30 MINUTE ELSE INTERVAL 2 DAY END AS x FROM p WHERE kind = 'start' OR kind = 'retry' AND retries < 3), ({_passed(_JOBS)}) WHERE x <= w AND coalesce(next > x, true)""")
def _(c: Catalog):
    """A visitor stands for a job: a click claims it, a purchase completes it, of errors each fourth (by k) may not be retried; leases end and idle jobs expire by timers."""
    error = F.when(F.get_json_object("props", "$.k").cast("long") % 4 == 0, "fatal").otherwise("retry")
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", error)
    out = drained(c, timers.job_changes(source(c), "user_id", kind), "append", timers.PROVIDER)
    return out.select(F.col("user_id").alias("visitor"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "status", "retries", "priority")
