"""Reads: lookups, batches of children, filters and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from moothall.catalog import AS_OF, Catalog, as_of
from moothall.operators import relational as R
from moothall.plans.registry import civic


@civic("src01_meeting_by_key", "SELECT id, city_key, title, date, status FROM meetings WHERE id = 42")
def _(c: Catalog):
    return c.meetings().where("id = 42").select("id", "city_key", "title", "date", "status")


@civic("src02_matters_batch", "SELECT m.id, m.title, greatest(1, (SELECT count(*) FROM items i WHERE i.matter_id = m.id)) AS appearances FROM matters m WHERE id IN (3, 7, 11, 19)")
def _(c: Catalog):
    ids = [3, 7, 11, 19]
    n = R.any_of(c.items(), "matter_id", ids).groupBy("matter_id").agg(F.count("*").alias("n"))
    m = R.any_of(c.matters(), "id", ids)
    return m.join(n, m.id == n.matter_id, "left").select("id", "title", F.greatest(F.lit(1).cast("long"), F.coalesce("n", F.lit(0).cast("long"))).alias("appearances"))


@civic("src03_items_by_meeting", "SELECT meeting_id, string_agg(sequence || ':' || coalesce(matter_id::VARCHAR, ''), ' ' ORDER BY sequence, matter_id NULLS FIRST) AS items FROM items GROUP BY 1")
def _(c: Catalog):
    nested = R.children(c.items(), "meeting_id", "sequence", ["matter_id"], "items")
    return nested.select("meeting_id", F.array_join(F.transform("items", lambda x: F.concat(x["sequence"].cast("string"), F.lit(":"), F.coalesce(x["matter_id"].cast("string"), F.lit("")))), " ").alias("items"))


@civic("src04_topics_of_entities", "SELECT entity, string_agg(DISTINCT event, ',' ORDER BY event) AS topics FROM (SELECT k % 20 AS entity, event FROM ev) GROUP BY 1")
def _(c: Catalog):
    return c.events().groupBy((F.col("k") % 20).alias("entity")).agg(F.array_join(F.sort_array(F.collect_set("event")), ",").alias("topics"))


@civic("src05_cities_filtered", "SELECT banana, name, state, vendor FROM jurisdictions WHERE lower(vendor) = 'granicus' AND lower(state) = 'am'")
def _(c: Catalog):
    return R.optional_filters(c.jurisdictions(), state="AM", vendor="granicus", name=None).select("banana", "name", "state", "vendor")


@civic("src08_fetch_window", "SELECT id, date FROM meetings WHERE date >= TIMESTAMP '2001-06-01' - INTERVAL 14 DAY AND date <= TIMESTAMP '2001-06-01' + INTERVAL 14 DAY")
def _(c: Catalog):
    day = F.date_trunc("day", as_of()).cast("timestamp_ntz")
    return c.meetings().where((F.col("date") >= day - F.expr("interval 14 day")) & (F.col("date") <= day + F.expr("interval 14 day"))).select("id", "date")


@civic("flt01_upcoming_meetings", f"SELECT id, date, status FROM meetings WHERE (status IS NULL OR status NOT IN ('cancelled', 'postponed')) AND date BETWEEN TIMESTAMP '{AS_OF}' AND TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY ORDER BY date, id LIMIT 50")
def _(c: Catalog):
    m = R.without_status(c.meetings(), ["cancelled", "postponed"])
    return m.where(F.col("date").between(as_of(), as_of() + F.expr("interval 30 day"))).orderBy(F.asc_nulls_last("date"), "id").limit(50).select("id", "date", "status")


@civic("flt02_happening_items", f"SELECT i.item_id, i.sequence, m.title, m.date FROM items i LEFT JOIN meetings m ON i.meeting_id = m.id WHERE i.date > TIMESTAMP '{AS_OF}' AND (m.status IS NULL OR m.status NOT IN ('cancelled', 'postponed', 'deferred'))")
def _(c: Catalog):
    i, m = c.items().withColumnRenamed("date", "expires"), c.meetings()
    joined = i.join(m, i.meeting_id == m.id, "left").where(F.col("expires") > as_of())
    return R.without_status(joined, ["cancelled", "postponed", "deferred"]).select("item_id", "sequence", "title", "date")


@civic("flt03_keyword_in_texts", "SELECT id, city FROM texts WHERE contains(text, 'the') AND NOT contains(text, 'The')")
def _(c: Catalog):
    return c.texts().where(F.col("text").contains("the") & ~F.col("text").contains("The")).select("id", "city")


@civic("flt04_keyword_upcoming", f"SELECT i.item_id, m.date FROM items i JOIN meetings m ON m.id = i.meeting_id WHERE contains(i.summary, 'mary R') AND m.date BETWEEN TIMESTAMP '{AS_OF}' AND TIMESTAMP '{AS_OF}' + INTERVAL 14 DAY")
def _(c: Catalog):
    m = c.meetings().where(F.col("date").between(as_of(), as_of() + F.expr("interval 14 day"))).select("id", F.col("date").alias("meeting_date"))
    i = c.items().where(F.col("summary").contains("mary R"))
    return i.join(m, i.meeting_id == m.id).select("item_id", F.col("meeting_date").alias("date"))


@civic("flt05_keyword_matters", "SELECT id, title, summary FROM matters WHERE committee IN ('Brand#2', 'Brand#17') AND contains(summary, 'red')")
def _(c: Catalog):
    return R.any_of(c.matters(), "committee", ["Brand#2", "Brand#17"]).where(F.col("summary").contains("red")).select("id", "title", "summary")


@civic("flt06_file_contains", "SELECT id, file FROM matters WHERE file ILIKE '%brand#1%'")
def _(c: Catalog):
    return c.matters().where(F.col("file").ilike("%brand#1%")).select("id", "file")


@civic("flt07_topic_text_like", """SELECT entity FROM (SELECT k % 20 AS entity, '["' || string_agg(DISTINCT event, '","' ORDER BY event) || '"]' AS topics FROM ev WHERE event <> 'purchase' OR k % 3 = 0 GROUP BY 1) WHERE topics LIKE '%purch%'""")
def _(c: Catalog):
    e = c.events().where("event <> 'purchase' or k % 3 = 0").groupBy((F.col("k") % 20).alias("entity")).agg(F.to_json(F.sort_array(F.collect_set("event"))).alias("topics"))
    return e.where(F.col("topics").like("%purch%")).select("entity")


@civic("flt08_alerts_for_city", "SELECT visitor FROM (SELECT visitor, list(DISTINCT k % 20) AS cities FROM ev WHERE event = 'purchase' GROUP BY 1) WHERE list_contains(cities, 7)")
def _(c: Catalog):
    alerts = c.events().where("event = 'purchase'").groupBy("visitor").agg(F.collect_set(F.col("k") % 20).alias("cities"))
    return alerts.where(F.array_contains("cities", F.lit(7).cast("long"))).select("visitor")


@civic("flt09_meetings_with_items", "SELECT id FROM meetings m WHERE summary IS NOT NULL AND EXISTS (SELECT 1 FROM items i WHERE i.meeting_id = m.id AND i.summary IS NOT NULL)")
def _(c: Catalog):
    return c.meetings().where("summary is not null").join(c.items().where("summary is not null").select(F.col("meeting_id").alias("id")), "id", "left_semi").select("id")


@civic("flt10_members_at", "SELECT committee, member_id FROM memberships WHERE joined_at <= TIMESTAMP '1999-01-01' AND (left_at IS NULL OR left_at > TIMESTAMP '1999-01-01')")
def _(c: Catalog):
    return R.valid_at(c.memberships(), as_of("1999-01-01")).select("committee", "member_id")


@civic("flt16_processing_split", "SELECT CASE WHEN summary IS NOT NULL THEN 'done' WHEN n_attachments = 0 AND agenda_number IS NULL THEN 'drop' ELSE 'todo' END AS state, count(*) AS n FROM items GROUP BY 1")
def _(c: Catalog):
    state = F.when(F.col("summary").isNotNull(), "done").when((F.col("n_attachments") == 0) & F.col("agenda_number").isNull(), "drop").otherwise("todo")
    return c.items().groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@civic("flt21_upcoming_or_past", f"SELECT CASE WHEN date IS NULL OR TIMESTAMP '{AS_OF}' < date + INTERVAL 6 HOUR THEN 'upcoming' ELSE 'past' END AS side, count(*) AS n FROM meetings GROUP BY 1")
def _(c: Catalog):
    side = F.when(F.col("date").isNull() | (as_of() < F.col("date") + F.expr("interval 6 hour")), "upcoming").otherwise("past")
    return c.meetings().groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@civic("prj02_coverage_tier", """SELECT banana, CASE WHEN matters > 0 THEN 'matter' WHEN items > 0 THEN 'item' WHEN summarized > 0 THEN 'monolithic' ELSE 'synced' END AS tier,
  CASE WHEN matters > 0 THEN matters WHEN items > 0 THEN items WHEN summarized > 0 THEN summarized ELSE synced END AS n
FROM (SELECT j.banana, count(DISTINCT CASE WHEN i.summary IS NOT NULL AND j.city_key % 2 = 0 THEN i.matter_id END) AS matters, count(DISTINCT CASE WHEN i.summary IS NOT NULL AND j.city_key % 3 <> 0 THEN i.item_id END) AS items, count(DISTINCT CASE WHEN m.summary IS NOT NULL THEN m.id END) AS summarized, count(DISTINCT m.id) AS synced
  FROM jurisdictions j JOIN meetings m USING (city_key) LEFT JOIN items i ON i.meeting_id = m.id WHERE j.has_geom GROUP BY 1) WHERE synced > 0""")
def _(c: Catalog):
    j, m, i = c.jurisdictions().where("has_geom").select("banana", "city_key"), c.meetings(), c.items()
    by_meeting = m.select("id", "city_key", F.col("summary").isNotNull().alias("has"))
    per_city = by_meeting.groupBy("city_key").agg(F.count_if("has").alias("summarized"), F.count("*").alias("synced"))
    done = i.where("summary is not null").join(by_meeting.select(F.col("id").alias("meeting_id"), "city_key"), "meeting_id")
    per_item = done.groupBy("city_key").agg(F.count_distinct("matter_id").alias("matters"), F.count_distinct("item_id").alias("items"))
    x = j.join(per_city, "city_key").join(per_item, "city_key", "left")
    x = x.select("banana", "summarized", "synced", F.when(F.col("city_key") % 2 == 0, F.coalesce("matters", F.lit(0))).otherwise(0).alias("matters"), F.when(F.col("city_key") % 3 != 0, F.coalesce("items", F.lit(0))).otherwise(0).alias("items"))
    tiers = [("matter", "matters"), ("item", "items"), ("monolithic", "summarized"), ("synced", "synced")]
    tier = F.coalesce(*(F.when(F.col(v) > 0, F.lit(t)) for t, v in tiers))
    n = F.coalesce(*(F.when(F.col(v) > 0, F.col(v)) for _, v in tiers))
    return x.select("banana", tier.alias("tier"), n.cast("long").alias("n")).where("tier is not null")


@civic("prj03_name_fallback", "SELECT i.item_id, coalesce(nullif(p.committee, ''), i.agenda_number) AS committee FROM items i LEFT JOIN (SELECT id, CASE WHEN id % 5 = 0 THEN '' ELSE committee END AS committee FROM matters) p ON p.id = i.matter_id")
def _(c: Catalog):
    m = c.matters().select(F.col("id").alias("matter_id"), F.when(F.col("id") % 5 == 0, "").otherwise(F.col("committee")).alias("committee"))
    return c.items().join(m, "matter_id", "left").select("item_id", F.coalesce(F.nullif("committee", F.lit("")), "agenda_number").alias("committee"))
