"""Sinks and incremental loads as merges of a batch into a snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from moothall.catalog import Catalog
from moothall.operators import merge
from moothall.plans.registry import civic


@civic("snk01_meeting_upsert", "WITH n AS (SELECT id, title || '!' AS title, NULL AS summary FROM meetings WHERE id % 2 = 0 UNION ALL SELECT id + 10000000, title, summary FROM meetings WHERE id % 50 = 0) SELECT coalesce(n.id, m.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE m.title END AS title, coalesce(n.summary, m.summary) AS summary FROM meetings m FULL JOIN n ON n.id = m.id")
def _(c: Catalog):
    old = c.meetings().select("id", "title", "summary")
    new = old.where("id % 2 = 0").select("id", F.concat("title", F.lit("!")).alias("title"), F.lit(None).cast("string").alias("summary")).unionByName(old.where("id % 50 = 0").withColumn("id", F.col("id") + 10_000_000))
    return merge.upsert(old, new, ["id"], keep=["summary"])


def keyed_items(c: Catalog):
    """One row for each meeting and sequence."""
    return c.items().groupBy("meeting_id", "sequence").agg(F.min("summary").alias("summary"), F.min("matter_id").alias("matter_id"))


@civic("snk02_item_upsert_frozen", "SELECT meeting_id, sequence, min(summary) AS summary, CASE WHEN min(summary) IS NOT NULL THEN min(matter_id) ELSE -1 END AS matter_id FROM items GROUP BY 1, 2")
def _(c: Catalog):
    old = keyed_items(c)
    new = old.select("meeting_id", "sequence", F.lit(None).cast("string").alias("summary"), F.lit(-1).cast("long").alias("matter_id"))
    return merge.upsert(old, new, ["meeting_id", "sequence"], keep=["summary"], frozen=["matter_id"], frozen_when="summary")


@civic("snk03_matter_upsert", "SELECT id, greatest(id % 7, id % 5) AS n, coalesce(CASE WHEN id % 2 = 0 THEN 'new' END, summary) AS summary FROM matters")
def _(c: Catalog):
    old = c.matters().select("id", (F.col("id") % 7).alias("n"), "summary")
    new = c.matters().select("id", (F.col("id") % 5).alias("n"), F.when(F.col("id") % 2 == 0, "new").alias("summary"))
    return merge.upsert(old, new, ["id"], keep=["summary"], largest=["n"])


@civic("snk04_insert_absent", "SELECT id, title FROM matters WHERE id % 3 <> 0 UNION ALL SELECT id, 'late' FROM matters WHERE id % 3 = 0")
def _(c: Catalog):
    m = c.matters().select("id", "title")
    return merge.insert_absent(m.where("id % 3 <> 0"), m.select("id", F.lit("late").alias("title")), ["id"])


@civic("snk05_city_requests", "SELECT k % 20 AS city, count(*) AS n, min(ts) AS first, max(ts) AS last FROM ev WHERE event = 'view' GROUP BY 1")
def _(c: Catalog):
    return c.events().where("event = 'view'").groupBy((F.col("k") % 20).alias("city")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@civic("snk06_last_vote_wins", "SELECT user_id, comment_id, arg_max(vote, (ts, event_id)) AS vote FROM opinions GROUP BY 1, 2")
def _(c: Catalog):
    return merge.last_write(c.opinions(), ["user_id", "comment_id"], ["ts", "event_id"], ["vote"])


@civic("snk07_first_vote_wins", "SELECT user_id, comment_id, arg_min(vote, (ts, event_id)) AS vote FROM opinions GROUP BY 1, 2")
def _(c: Catalog):
    return merge.first_write(c.opinions(), ["user_id", "comment_id"], ["ts", "event_id"], ["vote"])


@civic("snk08_replace_topics", "SELECT DISTINCT k AS id, event AS topic FROM ev WHERE k % 4 <> 0 UNION ALL SELECT DISTINCT k, 'fresh' FROM ev WHERE k % 4 = 0")
def _(c: Catalog):
    old = c.events().select(F.col("k").alias("id"), F.col("event").alias("topic")).distinct()
    return merge.replace_children(old, old.where("id % 4 = 0").select("id", F.lit("fresh").alias("topic")), "id")


@civic("snk09_enqueue_reset", "SELECT k AS job, max(event_id) AS last, arg_max(event, event_id) AS status FROM ev GROUP BY 1")
def _(c: Catalog):
    e = c.events().select(F.col("k").alias("job"), "event_id", "event")
    return merge.last_write(e, ["job"], ["event_id"], ["event_id", "event"]).select("job", F.col("event_id").alias("last"), F.col("event").alias("status"))


@civic("snk10_fill_null_summaries", "SELECT id, coalesce(summary, CASE WHEN id % 2 = 0 THEN 'filled' END) AS summary FROM matters")
def _(c: Catalog):
    new = c.matters().where("id % 2 = 0").select("id", F.lit("filled").alias("s"))
    return c.matters().select("id", "summary").join(new, "id", "left").select("id", F.coalesce("summary", "s").alias("summary"))


@civic("snk13_trending_view", "SELECT k, count(*) AS n, count(DISTINCT coalesce(visitor, event_id)) AS people FROM ev GROUP BY 1 ORDER BY n DESC, k LIMIT 100")
def _(c: Catalog):
    return c.events().groupBy("k").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("visitor", "event_id")).alias("people")).orderBy(F.desc("n"), "k").limit(100)


@civic("snk14_retention", "SELECT count(*) FILTER (ts >= m - INTERVAL 7 DAY) AS kept, count(*) FILTER (ts < m - INTERVAL 7 DAY) AS removed FROM ev, (SELECT max(ts) AS m FROM ev)")
def _(c: Catalog):
    e = c.events()
    newest = e.agg(F.max("ts").alias("m"))
    old = F.col("ts") < F.col("m") - F.expr("interval 7 day")
    return e.join(F.broadcast(newest)).agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("removed"))  # one row of a maximum


@civic("str06_matter_state", "SELECT matter_id, item_id, CASE WHEN lag(n_attachments) OVER w IS NULL THEN 'new' WHEN lag(n_attachments) OVER w = n_attachments THEN 'same' ELSE 'changed' END AS state FROM (SELECT matter_id, item_id, any_value(n_attachments ORDER BY sponsor_id, date) AS n_attachments, min(date) AS date FROM (SELECT * FROM items ORDER BY date) WHERE matter_id IS NOT NULL AND sequence = 1 GROUP BY 1, 2 HAVING count(*) = 1) WINDOW w AS (PARTITION BY matter_id ORDER BY date, item_id)")
def _(c: Catalog):
    from pyspark.sql import Window

    one = c.items().where("matter_id is not null and sequence = 1").groupBy("matter_id", "item_id").agg(F.min("n_attachments").alias("n"), F.min("date").alias("date"), F.count("*").alias("c")).where("c = 1")
    before = F.lag("n").over(Window.partitionBy("matter_id").orderBy("date", "item_id"))
    return one.select("matter_id", "item_id", F.when(before.isNull(), "new").when(before == F.col("n"), "same").otherwise("changed").alias("state"))


@civic("str08_enqueue_decision", "SELECT meeting_id, NOT bool_and(summary IS NOT NULL OR agenda_number IS NULL) AS enqueue FROM items GROUP BY 1")
def _(c: Catalog):
    return c.items().groupBy("meeting_id").agg((~F.every(F.col("summary").isNotNull() | F.col("agenda_number").isNull())).alias("enqueue"))


@civic("str11_latency_histogram", "SELECT event, count(*) FILTER (value <= 1) AS le_1, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 100) AS le_100, count(*) AS total FROM ev GROUP BY 1")
def _(c: Catalog):
    return c.events().groupBy("event").agg(*(F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in (1, 10, 100)), F.count("*").alias("total"))


@civic("str14_participant_numbers", "SELECT comment_id, user_id, row_number() OVER (PARTITION BY comment_id ORDER BY first, user_id) AS number FROM (SELECT comment_id, user_id, min(ts) AS first FROM opinions GROUP BY 1, 2)")
def _(c: Catalog):
    from pyspark.sql import Window

    first = c.opinions().groupBy("comment_id", "user_id").agg(F.min("ts").alias("first"))
    return first.select("comment_id", "user_id", F.row_number().over(Window.partitionBy("comment_id").orderBy("first", "user_id")).cast("long").alias("number"))


@civic("str15_trust", "SELECT event_id, coalesce(max(CASE WHEN event = 'purchase' THEN 1 END) OVER (PARTITION BY visitor ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS trusted FROM ev")
def _(c: Catalog):
    from pyspark.sql import Window

    w = Window.partitionBy("visitor").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return c.events().select("event_id", F.coalesce(F.max(F.when(F.col("event") == "purchase", 1)).over(w), F.lit(0)).cast("long").alias("trusted"))
