"""Ranking, ordering, pagination, priorities and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from moothall.catalog import AS_OF, EVENTS_AS_OF, Catalog, as_of
from moothall.operators import relational as R
from moothall.plans.registry import civic


@civic("win01_dropoffs", "SELECT event, k, count(*) AS n FROM (SELECT DISTINCT ON (visitor) visitor, event, k FROM ev ORDER BY visitor, ts DESC, event_id DESC) GROUP BY 1, 2")
def _(c: Catalog):
    return R.best_per_key(c.events(), ["visitor"], [F.desc("ts"), F.desc("event_id")]).groupBy("event", "k").agg(F.count("*").alias("n"))


@civic("win02_dedupe_items", """WITH s AS (SELECT *, CASE WHEN agenda_number IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN summary IS NOT NULL THEN 5 ELSE 0 END + n_attachments AS score FROM items)
SELECT item_id, score FROM (SELECT item_id, score, row_number() OVER (PARTITION BY meeting_id, matter_id ORDER BY score DESC, sequence, item_id, sponsor_id, date) AS r FROM s WHERE matter_id IS NOT NULL) WHERE r = 1 UNION ALL SELECT item_id, score FROM s WHERE matter_id IS NULL""")
def _(c: Catalog):
    score = F.when(F.col("agenda_number").isNotNull(), 10).otherwise(0) + F.when(F.col("summary").isNotNull(), 5).otherwise(0) + F.col("n_attachments")
    s = c.items().withColumn("score", score)
    best = R.best_per_key(s.where("matter_id is not null"), ["meeting_id", "matter_id"], [F.desc("score"), F.asc("sequence"), F.asc("item_id"), F.asc("sponsor_id"), F.asc("date")])
    return best.unionByName(s.where("matter_id is null")).select("item_id", "score")


@civic("win03_highest_version", "SELECT committee, max(v) AS version, arg_max(id, (v, -id)) AS id FROM (SELECT committee, id, regexp_extract(file, '-(\\d+)$', 1)::INT AS v FROM matters) GROUP BY 1")
def _(c: Catalog):
    v = F.regexp_extract("file", r"-(\d+)$", 1).cast("int")
    return c.matters().withColumn("v", v).groupBy("committee").agg(F.max("v").alias("version"), F.max_by("id", F.struct("v", (-F.col("id")).alias("i"))).alias("id"))


@civic("win04_version_per_base", "SELECT base, max(v) AS v FROM (SELECT split_part(file, '-', 1) || ' ' || title AS base, regexp_extract(file, '-(\\d+)$', 1)::INT AS v FROM matters) GROUP BY 1")
def _(c: Catalog):
    base = F.concat_ws(" ", F.split_part("file", F.lit("-"), F.lit(1)), "title")
    return c.matters().groupBy(base.alias("base")).agg(F.max(F.regexp_extract("file", r"-(\d+)$", 1).cast("int")).alias("v"))


@civic("win05_top_meetings", "SELECT id, size, date FROM meetings ORDER BY size DESC, date DESC NULLS LAST, id LIMIT 25")
def _(c: Catalog):
    return c.meetings().orderBy(F.desc("size"), F.desc_nulls_last("date"), "id").limit(25).select("id", "size", "date")


@civic("win06_votes_nulls_last", "SELECT meeting_id, member_id, vote_date FROM votes WHERE matter_id = 9 ORDER BY vote_date DESC NULLS LAST, sequence NULLS LAST, meeting_id, member_id LIMIT 40")
def _(c: Catalog):
    return c.votes().where("matter_id = 9").orderBy(F.desc_nulls_last("vote_date"), F.asc_nulls_last("sequence"), "meeting_id", "member_id").limit(40).select("meeting_id", "member_id", "vote_date")


@civic("win07_memberships_open_first", "SELECT committee, left_at IS NULL AS open, row_number() OVER (ORDER BY left_at IS NULL DESC, joined_at DESC, committee) AS nth FROM memberships WHERE member_id = 3")
def _(c: Catalog):
    open_ = F.col("left_at").isNull()
    w = Window.orderBy(open_.desc(), F.desc("joined_at"), "committee")  # one member's rows
    return c.memberships().where("member_id = 3").select("committee", open_.alias("open"), F.row_number().over(w).cast("long").alias("nth"))


@civic("win08_page_of_city", "SELECT id, date FROM meetings WHERE city_key = 4 ORDER BY date DESC NULLS FIRST, id LIMIT 20 OFFSET 20")
def _(c: Catalog):
    return c.meetings().where("city_key = 4").orderBy(F.desc_nulls_first("date"), "id").offset(20).limit(20).select("id", "date")


@civic("win09_page_then_expand", "SELECT p.id, i.item_id, i.meeting_id FROM (SELECT m.id, count(*) AS n FROM matters m JOIN items i ON i.matter_id = m.id GROUP BY 1 ORDER BY n DESC, m.id LIMIT 10 OFFSET 5) p JOIN items i ON i.matter_id = p.id")
def _(c: Catalog):
    i = c.items().where("matter_id is not null").select(F.col("matter_id").alias("id"), "item_id", "meeting_id")
    page = i.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").offset(5).limit(10).select("id")
    return i.join(F.broadcast(page), "id")  # ten rows


@civic("win10_top_per_city", "SELECT city_key, id, date FROM (SELECT *, row_number() OVER (PARTITION BY city_key ORDER BY date DESC NULLS LAST, id) AS r FROM meetings) WHERE r <= 3 ORDER BY date DESC NULLS LAST, id LIMIT 40")
def _(c: Catalog):
    top = R.best_per_key(c.meetings(), ["city_key"], [F.desc_nulls_last("date"), F.asc("id")], 3)
    return top.orderBy(F.desc_nulls_last("date"), "id").limit(40).select("city_key", "id", "date")


@civic("win11_dashboard_feed", f"""WITH h AS (SELECT city_key, id, date FROM (SELECT *, row_number() OVER (PARTITION BY city_key ORDER BY size DESC, id) AS r FROM meetings WHERE city_key < 5) WHERE r <= 3),
u AS (SELECT city_key, id, date FROM (SELECT *, row_number() OVER (PARTITION BY city_key ORDER BY date, id) AS r FROM meetings WHERE city_key < 5 AND date >= TIMESTAMP '{AS_OF}') WHERE r <= 3)
SELECT 'happening' AS kind, * FROM h UNION ALL SELECT 'upcoming', * FROM u WHERE id NOT IN (SELECT id FROM h)""")
def _(c: Catalog):
    m = c.meetings().where("city_key < 5")
    h = R.best_per_key(m, ["city_key"], [F.desc("size"), F.asc("id")], 3).select(F.lit("happening").alias("kind"), "city_key", "id", "date")
    u = R.best_per_key(m.where(F.col("date") >= as_of()), ["city_key"], [F.asc("date"), F.asc("id")], 3).select(F.lit("upcoming").alias("kind"), "city_key", "id", "date")
    return h.unionByName(u.join(h.select("id"), "id", "left_anti").select("kind", "city_key", "id", "date"))


@civic("win12_active_ranking", f"SELECT item_id, row_number() OVER (PARTITION BY meeting_id ORDER BY sequence, item_id, sponsor_id) AS rank FROM items WHERE date > TIMESTAMP '{AS_OF}'")
def _(c: Catalog):
    w = Window.partitionBy("meeting_id").orderBy("sequence", "item_id", "sponsor_id")
    return c.items().where(F.col("date") > as_of()).select("item_id", F.row_number().over(w).cast("long").alias("rank"))


@civic("win13_queue_order", "SELECT city_key, id FROM (SELECT city_key, id, row_number() OVER (PARTITION BY city_key ORDER BY size DESC, date NULLS FIRST, id) AS r FROM meetings WHERE status IS NULL) WHERE r = 1")
def _(c: Catalog):
    return R.best_per_key(c.meetings().where("status is null"), ["city_key"], [F.desc("size"), F.asc_nulls_first("date"), F.asc("id")]).select("city_key", "id")


SYNC = f"SELECT city_key, count(*) FILTER (date >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND date <= TIMESTAMP '{AS_OF}') AS recent, epoch(TIMESTAMP '{AS_OF}' - max(date) FILTER (date <= TIMESTAMP '{AS_OF}')) / 3600 AS hours FROM meetings GROUP BY 1"


def sync_state(c: Catalog):
    """Recent meetings, and hours since the last, of each city."""
    d = F.col("date")
    last = F.max(F.when(d <= as_of(), d))
    hours = (F.unix_timestamp(as_of().cast("timestamp")) - F.unix_timestamp(last.cast("timestamp"))) / 3600
    return c.meetings().groupBy("city_key").agg(F.count_if(d.between(as_of() - F.expr("interval 30 day"), as_of())).alias("recent"), hours.alias("hours"))


@civic("win14_sync_priority", f"SELECT city_key, CASE WHEN hours IS NULL THEN 1000 ELSE recent * 10 + least(hours / 24, 10) END AS priority FROM ({SYNC})")
def _(c: Catalog):
    return sync_state(c).select("city_key", F.when(F.col("hours").isNull(), 1000.0).otherwise(F.col("recent") * 10 + F.least(F.col("hours") / 24, F.lit(10.0))).alias("priority"))


@civic("win15_due_for_sync", f"SELECT city_key, hours IS NULL OR hours >= CASE WHEN recent >= 8 THEN 12 WHEN recent >= 4 THEN 24 ELSE 168 END AS due FROM ({SYNC})")
def _(c: Catalog):
    wait = F.when(F.col("recent") >= 8, 12).when(F.col("recent") >= 4, 24).otherwise(168)
    return sync_state(c).select("city_key", (F.col("hours").isNull() | (F.col("hours") >= wait)).alias("due"))


@civic("win16_job_priority", f"SELECT id, greatest(0, 150 - d) AS meeting, greatest(-100, 50 - d) AS matter FROM (SELECT id, coalesce(abs(floor(epoch(date - TIMESTAMP '{AS_OF}') / 86400))::BIGINT, 999) AS d FROM meetings)")
def _(c: Catalog):
    seconds = F.unix_timestamp(F.col("date").cast("timestamp")) - F.unix_timestamp(as_of().cast("timestamp"))
    d = F.coalesce(F.abs(F.floor(seconds / 86400)), F.lit(999).cast("long"))
    return c.meetings().select("id", F.greatest(F.lit(0).cast("long"), 150 - d).alias("meeting"), F.greatest(F.lit(-100).cast("long"), 50 - d).alias("matter"))


@civic("win17_best_texts", "SELECT id, score FROM (SELECT id, least(10, length(text) // 500) AS score FROM texts WHERE length(text) >= 200 ORDER BY id DESC LIMIT 60) ORDER BY score DESC, id LIMIT 20")
def _(c: Catalog):
    t = c.texts().where(F.length("text") >= 200).orderBy(F.desc("id")).limit(60)
    return t.select("id", F.least(F.lit(10).cast("long"), F.expr("length(text) div 500")).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@civic("win18_random_matter", "SELECT matter_id, count(*) AS n FROM items WHERE matter_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 ORDER BY md5('7:' || matter_id), matter_id LIMIT 1")
def _(c: Catalog):
    """Random by a hash of the id and a seed, so that the choice depends on no partition."""
    busy = c.items().where("matter_id is not null").groupBy("matter_id").agg(F.count("*").alias("n")).where("n >= 2")
    return busy.orderBy(F.md5(F.concat(F.lit("7:"), F.col("matter_id").cast("string")).cast("binary")), "matter_id").limit(1)


@civic("win19_committee_by_mode", "SELECT meeting_id, committee FROM (SELECT i.meeting_id, m.committee, row_number() OVER (PARTITION BY i.meeting_id ORDER BY count(*) DESC, m.committee) AS r FROM items i JOIN matters m ON m.id = i.matter_id GROUP BY 1, 2) WHERE r = 1")
def _(c: Catalog):
    m = c.matters().select(F.col("id").alias("matter_id"), "committee")
    n = c.items().join(m, "matter_id").groupBy("meeting_id", "committee").agg(F.count("*").alias("n"))
    return R.best_per_key(n, ["meeting_id"], [F.desc("n"), F.asc("committee")]).select("meeting_id", "committee")


@civic("set01_meetings_of_topic", "SELECT DISTINCT m.id FROM meetings m JOIN items i ON i.meeting_id = m.id WHERE i.summary = 'Summary R'")
def _(c: Catalog):
    return c.meetings().select("id").join(c.items().where("summary = 'Summary R'").select(F.col("meeting_id").alias("id")), "id", "left_semi")


@civic("set02_city_names", "SELECT DISTINCT name FROM jurisdictions ORDER BY 1")
def _(c: Catalog):
    return c.jurisdictions().select("name").distinct().orderBy("name")


@civic("set03_first_spelling", "SELECT committee, string_agg(title, ',' ORDER BY o) AS names FROM (SELECT committee, lower(title) AS t, arg_min(title, id) AS title, min(id) AS o FROM matters GROUP BY 1, 2) GROUP BY 1")
def _(c: Catalog):
    first = c.matters().groupBy("committee", F.lower("title").alias("t")).agg(F.min_by("title", "id").alias("title"), F.min("id").alias("o"))
    return first.groupBy("committee").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "title"))), lambda x: x["title"]), ",").alias("names"))


@civic("set04_upcoming_minus_happening", f"SELECT id FROM meetings WHERE date >= TIMESTAMP '{AS_OF}' EXCEPT SELECT meeting_id FROM items WHERE sequence = 1")
def _(c: Catalog):
    return c.meetings().where(F.col("date") >= as_of()).select("id").join(c.items().where("sequence = 1").select(F.col("meeting_id").alias("id")), "id", "left_anti").distinct()


@civic("set05_concat_results", "SELECT id, 'm' AS kind FROM meetings WHERE size > 490000 UNION ALL SELECT id, 'p' FROM matters WHERE kind = 'PROMO'")
def _(c: Catalog):
    return c.meetings().where("size > 490000").select("id", F.lit("m").alias("kind")).unionByName(c.matters().where("kind = 'PROMO'").select("id", F.lit("p").alias("kind")))


@civic("set06_keyword_intersection", f"SELECT visitor, len(list_intersect(a, b)) AS n FROM (SELECT visitor, list(DISTINCT k) FILTER (ts < TIMESTAMP '{EVENTS_AS_OF}') AS a, list(DISTINCT k) FILTER (ts >= TIMESTAMP '{EVENTS_AS_OF}') AS b FROM ev GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL")
def _(c: Catalog):
    before = F.col("ts") < as_of(EVENTS_AS_OF)
    e = c.events().groupBy("visitor").agg(F.collect_set(F.when(before, F.col("k"))).alias("a"), F.collect_set(F.when(~before, F.col("k"))).alias("b"))
    return e.where("size(a) > 0 and size(b) > 0").select("visitor", F.size(F.array_intersect("a", "b")).cast("long").alias("n"))
