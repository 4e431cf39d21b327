"""Queries of tables that are kept: retention by day, trending by sketches, jobs that are claimed once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from moothall import api
from moothall.catalog import EVENTS_AS_OF, Catalog
from moothall.operators import daily
from moothall.plans.registry import civic
from moothall.plans.streams import source
from moothall.session import shared_folder
from moothall.streaming import events
from moothall.streaming.ledger import JobQueue

NOW = dt.datetime.fromisoformat(EVENTS_AS_OF) + dt.timedelta(hours=12)


@civic("api08_purged_days", f"SELECT day, n, CAST((SELECT count(*) FROM events WHERE ts < TIMESTAMP '{EVENTS_AS_OF} 12:00:00' - INTERVAL 7 DAY) AS BIGINT) AS deleted FROM (SELECT ts::DATE::VARCHAR AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{EVENTS_AS_OF} 12:00:00' - INTERVAL 7 DAY GROUP BY 1)")
def _(c: Catalog):
    """Rows left by day after events of over seven days are deleted, and how many went; a second purge finds none."""
    at = shared_folder(c.spark, "days")
    daily.write_days(c.table("events").select("event_id", "user_id", "ts"), at)
    gone = daily.purge(c.spark, at, NOW - dt.timedelta(days=7))
    gone += daily.purge(c.spark, at, NOW - dt.timedelta(days=7))
    return c.spark.read.parquet(at).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n")).withColumn("deleted", F.lit(gone).cast("long"))


@civic("snk13_trending_sketches", f"SELECT entity, count(DISTINCT user_id) AS visitors FROM ratings WHERE ts::DATE BETWEEN DATE '{EVENTS_AS_OF}' - 6 AND DATE '{EVENTS_AS_OF}' GROUP BY 1")
def _(c: Catalog):
    """Visitors of the last seven days by exact sets of days: most events first, then late ones, some of them twice."""
    at, r = shared_folder(c.spark, "sketches"), c.ratings()
    late = F.pmod(F.xxhash64("user_id", "ts"), F.lit(5)) == 0
    for load in (r.where(~late), r.where(late), r.where(late & (F.col("user_id") % 2 == 0))):
        daily.add_sketches(load, at, "entity", "user_id")
    return daily.trending(c.spark, at, "entity", NOW.date())


@civic("str01_claimed_jobs", "SELECT job_id, claim, CASE claim % 2 WHEN 1 THEN 'a' ELSE 'b' END AS worker FROM (SELECT event_id AS job_id, (row_number() OVER (ORDER BY value DESC, event_id) - 1) // 100 + 1 AS claim FROM events WHERE event_type = 'error' AND value IS NOT NULL) WHERE claim <= 4")
def _(c: Catalog):
    """Errors arrive as jobs, every batch twice; two workers claim a hundred at a time, highest value first, two times each."""
    queue, at = JobQueue(c.spark, shared_folder(c.spark, "jobs")), shared_folder(c.spark, "stream")
    jobs = source(c).where("event_type = 'error' and value is not null").select(F.col("event_id").alias("job_id"), F.col("value").alias("priority"))

    def twice(batch, number):
        queue.arrive(batch, number)
        queue.arrive(batch, number)

    events.drain(jobs, "append", twice, f"{at}/checkpoint")
    for worker in "abab":
        queue.claim(worker, 100)
    return queue.claims().select("job_id", "claim", "worker")


@civic("flt20_guarded_sql", "SELECT state AS update, count(*) AS n, 6 AS refused FROM jurisdictions GROUP BY 1")
def _(c: Catalog):
    """A column may be called as a command is; six texts that are no query over the views are refused."""
    bad = ("DROP VIEW meetings", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) INSERT INTO meetings SELECT * FROM x", "SELECT * FROM parquet.`/tmp`", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT (SELECT count(*) FROM other)")
    refused = sum(api.plan_problem(c.spark, sql) is not None for sql in bad)
    return api.run_sql(c, "SELECT state AS update, count(*) AS n /* drop; */ FROM jurisdictions WHERE name <> 'DELETE FROM x;' GROUP BY 1 -- insert").withColumn("refused", F.lit(refused))
