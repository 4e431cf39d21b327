"""Aggregations: counts, pivots, tallies, trends, roll-ups and the deliberation's scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from moothall.catalog import AS_OF, EVENTS_AS_OF, Catalog, as_of
from moothall.operators import opinions
from moothall.operators import relational as R
from moothall.plans.registry import civic


def zero():
    return F.lit(0).cast("long")


@civic("agg01_popular_topics", "SELECT event AS topic, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, topic LIMIT 3")
def _(c: Catalog):
    return c.events().groupBy(F.col("event").alias("topic")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(3)


@civic("agg02_platform_metrics", f"""SELECT (SELECT count(*) FROM meetings) AS meetings, (SELECT count(*) FROM meetings WHERE summary IS NOT NULL) AS summarized, (SELECT count(*) FROM meetings WHERE date >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS recent_meetings,
 (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM items WHERE summary IS NOT NULL) AS item_summaries, (SELECT count(DISTINCT matter_id) FROM items) AS matters, (SELECT count(*) FROM votes) AS votes, (SELECT count(DISTINCT member_id) FROM votes) AS voters,
 (SELECT count(*) FROM votes WHERE vote_date >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS recent_votes, (SELECT count(*) FROM jurisdictions) AS cities""")
def _(c: Catalog):
    since = as_of() - F.expr("interval 30 day")
    m = c.meetings().agg(F.count("*").alias("meetings"), F.count("summary").alias("summarized"), F.count_if(F.col("date") >= since).alias("recent_meetings"))
    i = c.items().agg(F.count("*").alias("items"), F.count("summary").alias("item_summaries"), F.count_distinct("matter_id").alias("matters"))
    v = c.votes().agg(F.count("*").alias("votes"), F.count_distinct("member_id").alias("voters"), F.count_if(F.col("vote_date") >= since).alias("recent_votes"))
    one = [x.withColumn("__one", F.lit(1)) for x in (m, i, v, c.jurisdictions().agg(F.count("*").alias("cities")))]
    out = one[0]
    for x in one[1:]:  # rows of totals, one each
        out = out.join(x, "__one")
    return out.drop("__one")


@civic("agg03_stats", "SELECT (SELECT count(*) FROM jurisdictions WHERE kind = 'city') AS cities, (SELECT count(*) FROM meetings) AS meetings, (SELECT count(*) FROM meetings WHERE summary IS NOT NULL) AS summarized")
def _(c: Catalog):
    m = c.meetings().agg(F.count("*").alias("meetings"), F.count("summary").alias("summarized"), F.lit(1).alias("__one"))
    return c.jurisdictions().agg(F.count_if(F.col("kind") == "city").alias("cities"), F.lit(1).alias("__one")).join(m, "__one").drop("__one")


@civic("agg04_distinct_counts", "SELECT count(DISTINCT m.city_key) AS cities, count(DISTINCT i.meeting_id) AS meetings, count(DISTINCT i.matter_id) AS matters FROM items i JOIN meetings m ON m.id = i.meeting_id WHERE i.summary IS NOT NULL")
def _(c: Catalog):
    i = c.items().where("summary is not null")
    return i.join(c.meetings().select(F.col("id").alias("meeting_id"), "city_key"), "meeting_id").agg(F.count_distinct("city_key").alias("cities"), F.count_distinct("meeting_id").alias("meetings"), F.count_distinct("matter_id").alias("matters"))


@civic("agg05_votes_by_city", "SELECT split_part(title, ' ', 1) AS word, count(*) AS votes, count(DISTINCT member_id) AS voters FROM votes JOIN matters ON id = matter_id GROUP BY 1 ORDER BY votes DESC, word LIMIT 10")
def _(c: Catalog):
    m = c.matters().select(F.col("id").alias("matter_id"), F.split_part("title", F.lit(" "), F.lit(1)).alias("word"))
    return c.votes().join(m, "matter_id").groupBy("word").agg(F.count("*").alias("votes"), F.count_distinct("member_id").alias("voters")).orderBy(F.desc("votes"), "word").limit(10)


@civic("agg06_city_meeting_stats", "SELECT city_key, count(*) AS total, count(CASE WHEN size > 100000 THEN 1 END) AS with_packet, count(summary) AS summarized FROM meetings GROUP BY 1")
def _(c: Catalog):
    return c.meetings().groupBy("city_key").agg(F.count("*").alias("total"), F.count_if(F.col("size") > 100000).alias("with_packet"), F.count("summary").alias("summarized"))


@civic("agg07_match_counts", f"SELECT visitor, count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY) AS recent FROM ev GROUP BY 1")
def _(c: Catalog):
    return c.events().groupBy("visitor").agg(F.count("*").alias("total"), F.count_if(F.col("ts") >= as_of(EVENTS_AS_OF) - F.expr("interval 7 day")).alias("recent"))


@civic("agg08_distinct_filtered", "SELECT title, count(DISTINCT id) AS meetings, count(DISTINCT id) FILTER (WHERE id IN (SELECT meeting_id FROM items WHERE summary IS NULL)) AS partly, round(avg(size), 2) AS mean_size FROM meetings GROUP BY 1")
def _(c: Catalog):
    partly = c.items().where("summary is null").select(F.col("meeting_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    return c.meetings().join(partly, "id", "left").groupBy("title").agg(F.count_distinct("id").alias("meetings"), F.count_distinct(F.when(F.col("hit"), F.col("id"))).alias("partly"), F.round(F.avg("size"), 2).alias("mean_size"))


@civic("agg09_has_summary", "SELECT meeting_id, bool_or(summary IS NOT NULL) AS has FROM items GROUP BY 1")
def _(c: Catalog):
    return c.items().groupBy("meeting_id").agg(F.bool_or(F.col("summary").isNotNull()).alias("has"))


@civic("agg10_matters_seen", "SELECT m.id, count(i.item_id) AS n, max(g.date) AS last_seen FROM matters m LEFT JOIN items i ON i.matter_id = m.id LEFT JOIN meetings g ON g.id = i.meeting_id GROUP BY 1 HAVING count(i.item_id) >= 25")
def _(c: Catalog):
    n = c.items().where("matter_id is not null").select(F.col("matter_id").alias("m"), "item_id", F.col("meeting_id").alias("id")).join(c.meetings().select("id", "date"), "id", "left")
    seen = n.groupBy(F.col("m").alias("id")).agg(F.count("item_id").alias("n"), F.max("date").alias("last_seen")).where("n >= 25")
    return seen.join(c.matters().select("id"), "id", "left_semi")


@civic("agg11_low_rated", "SELECT entity, round(avg(rating), 4) AS mean, count(*) AS n FROM ratings GROUP BY 1 HAVING avg(rating) <= 3.05 AND count(*) >= 3")
def _(c: Catalog):
    return c.ratings().groupBy("entity").agg(F.round(F.avg("rating"), 4).alias("mean"), F.count("*").alias("n"), F.avg("rating").alias("a")).where("a <= 3.05 and n >= 3").drop("a")


@civic("agg12_rating_histogram", "SELECT entity, count(*) FILTER (rating = 1) AS n_1, count(*) FILTER (rating = 2) AS n_2, count(*) FILTER (rating = 3) AS n_3, count(*) FILTER (rating = 4) AS n_4, count(*) FILTER (rating = 5) AS n_5, count(*) AS total FROM ratings GROUP BY 1")
def _(c: Catalog):
    return R.histogram(c.ratings(), ["entity"], "rating", range(1, 6))


@civic("agg13_vote_tally", "SELECT matter_id, count(*) FILTER (vote = 'yes') AS yes, count(*) FILTER (vote = 'nay') AS no, count(*) FILTER (vote = 'abstain') AS abstain, 0::BIGINT AS absent, 0::BIGINT AS present FROM votes GROUP BY 1")
def _(c: Catalog):
    return R.vote_tally(c.votes(), ["matter_id"])


@civic("agg14_vote_outcome", "SELECT meeting_id, matter_id, CASE WHEN y = 0 AND n = 0 THEN 'no_vote' WHEN y > n THEN 'passed' WHEN n > y THEN 'failed' ELSE 'tabled' END AS outcome FROM (SELECT meeting_id, matter_id, count(*) FILTER (vote = 'yes') AS y, count(*) FILTER (vote = 'nay') AS n FROM votes GROUP BY 1, 2)")
def _(c: Catalog):
    return R.vote_tally(c.votes(), ["meeting_id", "matter_id"]).select("meeting_id", "matter_id", R.vote_outcome(F.col("yes"), F.col("no")).alias("outcome"))


@civic("agg15_visitor_patterns", "SELECT path, count(*) AS n FROM (SELECT visitor, array_to_string(list(event ORDER BY ts, event_id)[1:5], ' -> ') AS path FROM ev GROUP BY 1) GROUP BY 1 ORDER BY n DESC, path LIMIT 20")
def _(c: Catalog):
    first = R.best_per_key(c.events().select("visitor", "ts", "event_id", "event"), ["visitor"], [F.col("ts"), F.col("event_id")], 5)
    ordered = first.groupBy("visitor").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event"))).alias("e"))  # five at most
    path = F.array_join(F.transform("e", lambda x: x["event"]), " -> ")
    return ordered.groupBy(path.alias("path")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(20)


@civic("agg16_journeys", "SELECT visitor, count(*) AS n, string_agg(event, ',' ORDER BY ts, event_id) AS journey FROM ev GROUP BY 1 ORDER BY n DESC, visitor LIMIT 10")
def _(c: Catalog):
    top = c.events().groupBy("visitor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "visitor").limit(10)
    e = c.events().join(F.broadcast(top), "visitor").groupBy("visitor", "n").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event"))).alias("e"))
    return e.select("visitor", "n", F.array_join(F.transform("e", lambda x: x["event"]), ",").alias("journey")).orderBy(F.desc("n"), "visitor").limit(10)


@civic("agg17_weekly_trend", f"""WITH w AS (SELECT unnest(generate_series(date_trunc('week', TIMESTAMP '{AS_OF}') - INTERVAL 7 WEEK, date_trunc('week', TIMESTAMP '{AS_OF}'), INTERVAL 1 WEEK)) AS week)
SELECT w.week, coalesce(m.n, 0) AS meetings, coalesce(v.n, 0) AS votes FROM w LEFT JOIN (SELECT date_trunc('week', date) AS week, count(*) AS n FROM meetings GROUP BY 1) m ON m.week = w.week LEFT JOIN (SELECT date_trunc('week', vote_date) AS week, count(*) AS n FROM votes GROUP BY 1) v ON v.week = w.week""")
def _(c: Catalog):
    this = F.date_trunc("week", as_of()).cast("timestamp_ntz")
    start = this - F.expr("interval 49 day")
    weeks = c.spark.range(8).select((start + F.make_dt_interval(days=(F.col("id") * 7).cast("int"))).alias("week"))
    count = lambda df, col, out: df.where(F.col(col) >= start).groupBy(F.date_trunc("week", col).cast("timestamp_ntz").alias("week")).agg(F.count("*").alias(out))
    return weeks.join(count(c.meetings(), "date", "meetings"), "week", "left").join(count(c.votes(), "vote_date", "votes"), "week", "left").na.fill(0, ["meetings", "votes"])


@civic("agg18_population_covered", "SELECT sum(population)::BIGINT AS total, sum(population) FILTER (city_key IN (SELECT city_key FROM meetings WHERE summary IS NOT NULL))::BIGINT AS summarized, sum(population) FILTER (city_key IN (SELECT city_key FROM meetings GROUP BY 1 HAVING count(*) >= 600))::BIGINT AS busy FROM jurisdictions")
def _(c: Catalog):
    m = c.meetings().groupBy("city_key").agg((F.count("summary") > 0).alias("s"), (F.count("*") >= 600).alias("b"))
    p = F.col("population")
    return c.jurisdictions().join(m, "city_key", "left").agg(F.sum(p).alias("total"), F.sum(F.when(F.col("s"), p)).alias("summarized"), F.sum(F.when(F.col("b"), p)).alias("busy"))


@civic("agg19_coverage_by_city", "WITH m AS (SELECT city_key, count(*) AS meetings FROM meetings GROUP BY 1), i AS (SELECT city_key, count(*) AS items, count(items.summary) AS summarized FROM items JOIN meetings g ON g.id = meeting_id GROUP BY 1) SELECT banana, population, coalesce(meetings, 0) AS meetings, coalesce(items, 0) AS items, coalesce(summarized, 0) AS summarized FROM jurisdictions LEFT JOIN m USING (city_key) LEFT JOIN i USING (city_key) WHERE coalesce(meetings, 0) > 0")
def _(c: Catalog):
    g = c.meetings().select(F.col("id").alias("meeting_id"), "city_key")
    i = c.items().select("meeting_id", "summary").join(g, "meeting_id").groupBy("city_key").agg(F.count("*").alias("items"), F.count("summary").alias("summarized"))
    m = g.groupBy("city_key").agg(F.count("*").alias("meetings"))
    return c.jurisdictions().join(m, "city_key").join(i, "city_key", "left").select("banana", "population", "meetings", F.coalesce("items", zero()).alias("items"), F.coalesce("summarized", zero()).alias("summarized")).orderBy(F.desc("population"))


@civic("agg20_vendor_breakdown", "SELECT vendor, count(DISTINCT city_key) AS cities, count(m.id) AS meetings FROM jurisdictions LEFT JOIN meetings m USING (city_key) GROUP BY 1")
def _(c: Catalog):
    m = c.meetings().groupBy("city_key").agg(F.count("*").alias("n"))
    return c.jurisdictions().join(m, "city_key", "left").groupBy("vendor").agg(F.count_distinct("city_key").alias("cities"), F.sum(F.coalesce("n", zero())).alias("meetings"))


@civic("agg21_status_pivot", "SELECT count(*) FILTER (status = 'cancelled') AS cancelled, count(*) FILTER (status = 'postponed') AS postponed, count(*) FILTER (status IS NULL) AS held FROM meetings")
def _(c: Catalog):
    s = F.col("status")
    return c.meetings().agg(F.count_if(s == "cancelled").alias("cancelled"), F.count_if(s == "postponed").alias("postponed"), F.count_if(s.isNull()).alias("held"))


@civic("agg22_recent_activity", f"SELECT city_key, count(*) AS n FROM meetings WHERE date >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND date <= TIMESTAMP '{AS_OF}' GROUP BY 1 ORDER BY n DESC, city_key LIMIT 10")
def _(c: Catalog):
    return c.meetings().where(F.col("date").between(as_of() - F.expr("interval 7 day"), as_of())).groupBy("city_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city_key").limit(10)


@civic("agg23_duplicate_matters", "SELECT file, title, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM matters GROUP BY 1, 2 HAVING count(*) > 1")
def _(c: Catalog):
    return c.matters().groupBy("file", "title").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids")).where("n > 1")


@civic("agg24_trending", f"SELECT k, count(*) AS n, count(DISTINCT visitor) AS visitors FROM ev WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{EVENTS_AS_OF}' GROUP BY 1 ORDER BY n DESC, k LIMIT 100")
def _(c: Catalog):
    now = as_of(EVENTS_AS_OF)
    return c.events().where(F.col("ts").between(now - F.expr("interval 7 day"), now)).groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("visitor").alias("visitors")).orderBy(F.desc("n"), "k").limit(100)


@civic("agg25_topics_of_page", "SELECT event, count(*) AS n FROM (SELECT event FROM ev ORDER BY ts DESC, event_id LIMIT 200) GROUP BY 1")
def _(c: Catalog):
    return c.events().orderBy(F.desc("ts"), "event_id").limit(200).groupBy("event").agg(F.count("*").alias("n"))


@civic("agg26_topic_rollup", "SELECT visitor, string_agg(event, ',' ORDER BY n DESC, o) AS topics FROM (SELECT visitor, event, count(*) AS n, min(event_id) AS o FROM ev GROUP BY 1, 2) GROUP BY 1")
def _(c: Catalog):
    t = c.events().groupBy("visitor", "event").agg(F.count("*").alias("n"), F.min("event_id").alias("o"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "o", "event")))
    return t.groupBy("visitor").agg(F.array_join(F.transform(ordered, lambda x: x["event"]), ",").alias("topics"))


@civic("agg27_queue_stats", "SELECT event AS status, count(*) AS n, round(avg(CASE WHEN event = 'purchase' THEN value END), 2) AS seconds FROM ev GROUP BY 1")
def _(c: Catalog):
    return c.events().groupBy(F.col("event").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("event") == "purchase", F.col("value"))), 2).alias("seconds"))


@civic("agg28_meeting_frequency", f"SELECT city_key, count(*) AS n FROM meetings WHERE date >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1")
def _(c: Catalog):
    return c.meetings().where(F.col("date") >= as_of() - F.expr("interval 30 day")).groupBy("city_key").agg(F.count("*").alias("n"))


@civic("agg29_deliberation_stats", "SELECT count(DISTINCT comment_id) AS comments, count(*) AS votes, count(DISTINCT user_id) AS participants FROM opinions WHERE comment_id < 6")
def _(c: Catalog):
    return c.opinions().where("comment_id < 6").agg(F.count_distinct("comment_id").alias("comments"), F.count("*").alias("votes"), F.count_distinct("user_id").alias("participants"))


def latest_votes(c: Catalog):
    """One vote for each user and comment: the newest."""
    return c.opinions().groupBy("user_id", "comment_id").agg(F.max_by("vote", F.struct("ts", "event_id")).alias("vote"))


@civic("agg30_vote_matrix", "SELECT user_id, comment_id, arg_max(vote, (ts, event_id)) AS vote FROM opinions GROUP BY 1, 2")
def _(c: Catalog):
    return latest_votes(c)


@civic("agg31_imputed_votes", """WITH v AS (SELECT user_id, comment_id, arg_max(vote, (ts, event_id)) AS vote FROM opinions GROUP BY 1, 2), m AS (SELECT comment_id, avg(vote) AS mean FROM v GROUP BY 1)
SELECT u.user_id, m.comment_id, round(coalesce(v.vote, m.mean), 6) AS vote FROM (SELECT DISTINCT user_id FROM v) u CROSS JOIN m LEFT JOIN v ON v.user_id = u.user_id AND v.comment_id = m.comment_id""")
def _(c: Catalog):
    """The table is one deliberation."""
    cells = opinions.imputed(latest_votes(c).withColumn("deliberation", F.lit(0)))
    return cells.select("user_id", "comment_id", F.round("vote", 6).alias("vote"))


@civic("agg32_consensus", """WITH v AS (SELECT user_id, comment_id, arg_max(vote, (ts, event_id)) AS vote FROM opinions GROUP BY 1, 2), s AS (SELECT user_id % 3 AS cluster, count(DISTINCT user_id) AS size FROM v GROUP BY 1),
a AS (SELECT comment_id, s.cluster, (count(*) FILTER (user_id % 3 = s.cluster AND vote = 1) + 1) / (any_value(s.size) + 2) AS p FROM v, s GROUP BY 1, 2) SELECT comment_id, round(avg(p), 6) AS consensus FROM a GROUP BY 1""")
def _(c: Catalog):
    v = latest_votes(c).withColumn("cluster", F.col("user_id") % 3)
    size = v.groupBy("cluster").agg(F.count_distinct("user_id").alias("size"))
    grid = v.select("comment_id").distinct().withColumn("cluster", F.explode(F.array(*(F.lit(k).cast("long") for k in range(3))))).join(size, "cluster")
    agree = v.groupBy("comment_id", "cluster").agg(F.count_if(F.col("vote") == 1).alias("agree"))
    p = (F.coalesce("agree", zero()) + 1) / (F.col("size") + 2)
    return grid.join(agree, ["comment_id", "cluster"], "left").groupBy("comment_id").agg(F.round(F.avg(p), 6).alias("consensus"))


@civic("agg33_cluster_centers", "SELECT label, round(avg(embedding[1]), 6) AS x, round(avg(embedding[2]), 6) AS y, count(*) AS n FROM embeddings GROUP BY 1")
def _(c: Catalog):
    e = F.col("embedding")
    return c.table("embeddings").groupBy("label").agg(F.round(F.avg(e[0].cast("double")), 6).alias("x"), F.round(F.avg(e[1].cast("double")), 6).alias("y"), F.count("*").alias("n"))


@civic("agg34_sponsor_frequency", "SELECT sponsor_id, count(*) AS n FROM (SELECT DISTINCT sponsor_id, matter_id, meeting_id FROM items) GROUP BY 1")
def _(c: Catalog):
    return c.items().select("sponsor_id", "matter_id", "meeting_id").distinct().groupBy("sponsor_id").agg(F.count("*").alias("n"))


@civic("agg35_day_summary", f"SELECT city_key, string_agg(n || ' ' || day, ', ' ORDER BY first) AS days FROM (SELECT city_key, dayname(date) AS day, count(*) AS n, min(date) AS first FROM meetings WHERE date >= TIMESTAMP '{AS_OF}' AND date < TIMESTAMP '{AS_OF}' + INTERVAL 7 DAY GROUP BY 1, 2) GROUP BY 1")
def _(c: Catalog):
    week = c.meetings().where((F.col("date") >= as_of()) & (F.col("date") < as_of() + F.expr("interval 7 day")))
    days = week.groupBy("city_key", F.date_format("date", "EEEE").alias("day")).agg(F.count("*").alias("n"), F.min("date").alias("first"))
    ordered = F.sort_array(F.collect_list(F.struct("first", F.concat_ws(" ", F.col("n").cast("string"), "day").alias("t"))))
    return days.groupBy("city_key").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ", ").alias("days"))


@civic("agg36_digest_groups", "SELECT visitor, string_agg(DISTINCT event, ',' ORDER BY event) AS keywords, count(*) AS n FROM ev WHERE event IN ('click', 'signup') GROUP BY 1")
def _(c: Catalog):
    e = c.events().where(F.col("event").isin("click", "signup"))
    return e.groupBy("visitor").agg(F.array_join(F.sort_array(F.collect_set("event")), ",").alias("keywords"), F.count("*").alias("n"))


@civic("agg37_keywords_per_item", "SELECT k, string_agg(event, ',' ORDER BY o) AS keywords FROM (SELECT k, event, min(event_id) AS o FROM ev GROUP BY 1, 2) GROUP BY 1")
def _(c: Catalog):
    e = c.events().groupBy("k", "event").agg(F.min("event_id").alias("first")).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("first", "event"))).alias("e"))
    return e.select("k", F.array_join(F.transform("e", lambda x: x["event"]), ",").alias("keywords"))


@civic("agg38_dashboard_stats", f"SELECT count(*) AS alerts, sum(n)::BIGINT AS keywords, (SELECT count(DISTINCT k % 20) FROM ev WHERE event = 'signup') AS cities, (SELECT count(*) FROM ev WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 1 DAY AND ts < TIMESTAMP '{EVENTS_AS_OF}') AS matches FROM (SELECT visitor, count(DISTINCT k) AS n FROM ev WHERE event = 'signup' GROUP BY 1)")
def _(c: Catalog):
    e, now = c.events(), as_of(EVENTS_AS_OF)
    alerts = e.where("event = 'signup'").groupBy("visitor").agg(F.collect_set("k").alias("ks"))
    a = alerts.agg(F.count("*").alias("alerts"), F.sum(F.size("ks")).alias("keywords"), F.lit(1).alias("__one"))
    b = e.agg(F.count_distinct(F.when(F.col("event") == "signup", F.col("k") % 20)).alias("cities"), F.count_if((F.col("ts") >= now - F.expr("interval 1 day")) & (F.col("ts") < now)).alias("matches"), F.lit(1).alias("__one"))
    return a.join(b, "__one").drop("__one")


@civic("agg39_committee_sizes", "SELECT committee, count(*) AS members, count(*) FILTER (left_at IS NULL) AS open FROM memberships GROUP BY 1")
def _(c: Catalog):
    return c.memberships().groupBy("committee").agg(F.count("*").alias("members"), F.count_if(F.col("left_at").isNull()).alias("open"))


@civic("agg40_member_record", "SELECT member_id, count(*) FILTER (vote = 'yes') AS yes, count(*) FILTER (vote = 'nay') AS no, count(*) FILTER (vote = 'abstain') AS abstain FROM (SELECT member_id, vote, row_number() OVER (PARTITION BY member_id ORDER BY vote_date DESC NULLS LAST, meeting_id, matter_id, sequence) AS r FROM votes) WHERE r <= 50 GROUP BY 1")
def _(c: Catalog):
    last = R.best_per_key(c.votes(), ["member_id"], [F.desc_nulls_last("vote_date"), F.asc("meeting_id"), F.asc("matter_id"), F.asc("sequence")], 50)
    return R.vote_tally(last, ["member_id"]).select("member_id", "yes", "no", "abstain")


@civic("agg41_meeting_votes", "SELECT meeting_id, string_agg(matter_id || ':' || y || '-' || n, ' ' ORDER BY matter_id) AS tallies FROM (SELECT meeting_id, matter_id, count(*) FILTER (vote = 'yes') AS y, count(*) FILTER (vote = 'nay') AS n FROM votes GROUP BY 1, 2) GROUP BY 1")
def _(c: Catalog):
    t = R.vote_tally(c.votes(), ["meeting_id", "matter_id"])
    text = F.concat(F.col("matter_id").cast("string"), F.lit(":"), F.col("yes").cast("string"), F.lit("-"), F.col("no").cast("string"))
    return t.groupBy("meeting_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("matter_id", text.alias("t")))), lambda x: x["t"]), " ").alias("tallies"))


@civic("agg42_outcome_backfill", "SELECT i.item_id, i.meeting_id, i.matter_id, t.y AS yes, t.n AS no FROM items i JOIN (SELECT meeting_id, matter_id, count(*) FILTER (vote = 'yes') AS y, count(*) FILTER (vote = 'nay') AS n FROM votes GROUP BY 1, 2) t ON t.meeting_id = i.meeting_id AND t.matter_id = i.matter_id WHERE i.summary IS NULL")
def _(c: Catalog):
    t = R.vote_tally(c.votes(), ["meeting_id", "matter_id"]).select("meeting_id", "matter_id", "yes", "no")
    return c.items().where("summary is null").select("item_id", "meeting_id", "matter_id").join(t, ["meeting_id", "matter_id"])


@civic("agg43_state_stats", "SELECT state, count(*) AS meetings, sum(CASE WHEN m.summary IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS summarized, count(DISTINCT city_key) AS cities FROM meetings m JOIN jurisdictions USING (city_key) GROUP BY 1")
def _(c: Catalog):
    j = F.broadcast(c.jurisdictions().select("city_key", "state"))
    return c.meetings().join(j, "city_key").groupBy("state").agg(F.count("*").alias("meetings"), F.count("summary").alias("summarized"), F.count_distinct("city_key").alias("cities"))


@civic("agg44_queue_by_city", "SELECT state, coalesce(status, 'open') AS status, count(*) AS n FROM meetings JOIN jurisdictions USING (city_key) GROUP BY ROLLUP (state, coalesce(status, 'open'))")
def _(c: Catalog):
    j = F.broadcast(c.jurisdictions().select("city_key", "state"))
    return c.meetings().join(j, "city_key").withColumn("status", F.coalesce("status", F.lit("open"))).rollup("state", "status").agg(F.count("*").alias("n"))


@civic("agg45_geometry_coverage", "SELECT state, count(*) AS total, count(*) FILTER (has_geom) AS with_geom FROM jurisdictions GROUP BY 1 HAVING count(*) FILTER (has_geom) > 0")
def _(c: Catalog):
    return c.jurisdictions().groupBy("state").agg(F.count("*").alias("total"), F.count_if("has_geom").alias("with_geom")).where("with_geom > 0")
