"""Joins: chains, semi and anti joins, lateral aggregates, as-of lookups and keyword matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moothall.catalog import Catalog
from moothall.operators import relational as R
from moothall.plans.registry import civic


@civic("jon01_items_with_meetings", "SELECT i.item_id, m.title, m.date FROM items i JOIN meetings m ON i.meeting_id = m.id WHERE m.city_key = 3")
def _(c: Catalog):
    i = c.items().select("item_id", F.col("meeting_id").alias("id"))
    return i.join(c.meetings().where("city_key = 3"), "id").select("item_id", "title", "date")


@civic("jon02_matter_timeline", "SELECT i.item_id, m.date, j.banana, v.vote FROM items i JOIN meetings m ON i.meeting_id = m.id JOIN jurisdictions j USING (city_key) LEFT JOIN (SELECT meeting_id, matter_id, min(vote) AS vote FROM votes WHERE vote <> 'abstain' GROUP BY 1, 2) v ON v.meeting_id = i.meeting_id AND v.matter_id = i.matter_id WHERE i.matter_id = 21")
def _(c: Catalog):
    i = c.items().where("matter_id = 21").select("item_id", "meeting_id", "matter_id")
    m = c.meetings().select(F.col("id").alias("meeting_id"), "city_key", "date")
    v = c.votes().where("matter_id = 21 and vote <> 'abstain'").groupBy("meeting_id", "matter_id").agg(F.min("vote").alias("vote"))
    return i.join(m, "meeting_id").join(F.broadcast(c.jurisdictions()), "city_key").join(v, ["meeting_id", "matter_id"], "left").select("item_id", "date", "banana", "vote")


@civic("jon03_constant_in_on", "SELECT m.id, count(v.member_id) AS n FROM meetings m LEFT JOIN votes v ON v.meeting_id = m.id AND v.matter_id = 5 GROUP BY 1")
def _(c: Catalog):
    v = c.votes().where("matter_id = 5").select(F.col("meeting_id").alias("id"), "member_id")
    return c.meetings().select("id").join(v, "id", "left").groupBy("id").agg(F.count("member_id").alias("n"))


@civic("jon04_summarized_meetings", "SELECT DISTINCT m.id FROM meetings m LEFT JOIN items i ON i.meeting_id = m.id AND i.summary IS NOT NULL WHERE m.summary IS NOT NULL OR i.item_id IS NOT NULL")
def _(c: Catalog):
    i = c.items().where("summary is not null").select(F.col("meeting_id").alias("id"), "item_id")
    return c.meetings().select("id", "summary").join(i, "id", "left").where("summary is not null or item_id is not null").select("id").distinct()


@civic("jon05_lateral_inner", "SELECT m.id, a.n, a.top FROM meetings m, LATERAL (SELECT count(*) AS n, max(sequence) AS top FROM items i WHERE i.meeting_id = m.id) a WHERE a.n = 0 OR a.top > 6")
def _(c: Catalog):
    a = c.items().groupBy(F.col("meeting_id").alias("id")).agg(F.count("*").alias("n"), F.max("sequence").alias("top"))
    return c.meetings().select("id").join(a, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "top").where("n = 0 or top > 6")


@civic("jon06_lateral_left", "SELECT m.id, a.n FROM meetings m LEFT JOIN LATERAL (SELECT count(*) AS n FROM items i WHERE i.meeting_id = m.id) a ON m.status = 'cancelled'")
def _(c: Catalog):
    a = c.items().groupBy(F.col("meeting_id").alias("id")).agg(F.count("*").alias("n"))
    return c.meetings().select("id", "status").join(a, "id", "left").select("id", F.when(F.col("status") == "cancelled", F.coalesce("n", F.lit(0).cast("long"))).alias("n"))


@civic("jon07_matters_with_items", "SELECT id FROM matters m WHERE EXISTS (SELECT 1 FROM items i WHERE i.matter_id = m.id)")
def _(c: Catalog):
    return c.matters().select("id").join(c.items().select(F.col("matter_id").alias("id")), "id", "left_semi")


@civic("jon08_exists_or_exists", "SELECT count(*) AS n FROM items i WHERE i.summary IS NOT NULL OR i.meeting_id IN (SELECT meeting_id FROM items WHERE summary IS NOT NULL)")
def _(c: Catalog):
    some = c.items().groupBy("meeting_id").agg(F.count("*").alias("n"), F.bool_or(F.col("summary").isNotNull()).alias("any"))
    return some.agg(F.sum(F.when(F.col("any"), F.col("n")).otherwise(0)).alias("n"))


@civic("jon09_not_in_or_null", "SELECT item_id FROM items WHERE matter_id IS NULL OR matter_id NOT IN (SELECT id FROM matters WHERE kind = 'PROMO')")
def _(c: Catalog):
    promo = c.matters().where("kind = 'PROMO'").select(F.col("id").alias("matter_id"))
    return c.items().join(promo, "matter_id", "left_anti").select("item_id")


@civic("jon10_keep_linked", "SELECT count(*) AS n FROM votes v WHERE EXISTS (SELECT 1 FROM items i WHERE i.meeting_id = v.meeting_id AND i.matter_id = v.matter_id)")
def _(c: Catalog):
    return c.votes().join(c.items().select("meeting_id", "matter_id"), ["meeting_id", "matter_id"], "left_semi").agg(F.count("*").alias("n"))


@civic("jon11_orphan_matters", "SELECT m.id FROM matters m LEFT JOIN items i ON i.matter_id = m.id AND i.sequence = 7 WHERE i.item_id IS NULL")
def _(c: Catalog):
    return c.matters().select("id").join(c.items().where("sequence = 7").select(F.col("matter_id").alias("id")), "id", "left_anti")


@civic("jon12_cities_without_meetings", "SELECT j.banana FROM jurisdictions j LEFT JOIN meetings m ON m.city_key = j.city_key AND m.status IS NULL AND m.size > 499000 GROUP BY 1 HAVING count(m.id) = 0")
def _(c: Catalog):
    return c.jurisdictions().join(c.meetings().where("status is null and size > 499000"), "city_key", "left_anti").select("banana")


@civic("jon13_matter_counts", "SELECT m.id, greatest(1, (SELECT count(*) FROM items i WHERE i.matter_id = m.id)) AS n FROM matters m")
def _(c: Catalog):
    n = c.items().groupBy(F.col("matter_id").alias("id")).agg(F.count("*").alias("n"))
    return c.matters().select("id").join(n, "id", "left").select("id", F.greatest(F.lit(1).cast("long"), F.coalesce("n", F.lit(0).cast("long"))).alias("n"))


@civic("jon14_latest_tally", "SELECT matter_id, count(*) FILTER (vote = 'yes') AS yes, count(*) FILTER (vote = 'nay') AS no FROM votes v WHERE meeting_id = (SELECT meeting_id FROM votes w WHERE w.matter_id = v.matter_id ORDER BY vote_date DESC NULLS LAST, meeting_id DESC LIMIT 1) GROUP BY 1")
def _(c: Catalog):
    v = c.votes()
    last = R.best_per_key(v.select("matter_id", "meeting_id", "vote_date"), ["matter_id"], [F.desc_nulls_last("vote_date"), F.desc("meeting_id")]).select("matter_id", "meeting_id")
    return R.vote_tally(v.join(last, ["matter_id", "meeting_id"]), ["matter_id"]).select("matter_id", "yes", "no")


@civic("jon15_counts_by_city", "SELECT j.banana, (SELECT count(*) FROM meetings m WHERE m.city_key = j.city_key) AS meetings, (SELECT count(DISTINCT i.matter_id) FROM items i JOIN meetings m ON m.id = i.meeting_id WHERE m.city_key = j.city_key) AS matters, (SELECT count(*) FROM items i JOIN meetings m ON m.id = i.meeting_id WHERE m.city_key = j.city_key AND i.summary IS NOT NULL) AS summarized FROM jurisdictions j")
def _(c: Catalog):
    m = c.meetings().select(F.col("id").alias("meeting_id"), "city_key")
    per_city = m.groupBy("city_key").agg(F.count("*").alias("meetings"))
    per_item = c.items().join(m, "meeting_id").groupBy("city_key").agg(F.count_distinct("matter_id").alias("matters"), F.count("summary").alias("summarized"))
    zero = F.lit(0).cast("long")
    return c.jurisdictions().join(per_city, "city_key", "left").join(per_item, "city_key", "left").select("banana", *(F.coalesce(x, zero).alias(x) for x in ("meetings", "matters", "summarized")))


@civic("jon16_demanded_cities", "SELECT DISTINCT unnest(cities) AS city FROM (SELECT visitor, list(k % 20) AS cities FROM ev WHERE event = 'signup' GROUP BY 1)")
def _(c: Catalog):
    alerts = c.events().where("event = 'signup'").groupBy("visitor").agg(F.collect_set(F.col("k") % 20).alias("cities"))
    return alerts.select(F.explode("cities").alias("city")).distinct()


@civic("jon17_json_explode", """SELECT kind, count(*) AS n FROM (SELECT unnest(CASE n_attachments WHEN 0 THEN [] WHEN 1 THEN ['pdf'] WHEN 2 THEN ['pdf', 'doc'] ELSE ['pdf', 'doc', 'sheet'] END) AS kind FROM items) GROUP BY 1""")
def _(c: Catalog):
    made = F.transform(F.slice(F.array(*map(F.lit, ("pdf", "doc", "sheet"))), F.lit(1), F.col("n_attachments")), lambda x: F.struct(x.alias("type")))
    stored = c.items().select(F.to_json(made).alias("attachments"))
    return stored.select(F.explode(F.from_json("attachments", "array<struct<type:string>>")).alias("a")).groupBy(F.col("a.type").alias("kind")).agg(F.count("*").alias("n"))


@civic("jon18_prior_summary", "SELECT item_id, (SELECT p.summary FROM items p WHERE p.matter_id = i.matter_id AND p.summary IS NOT NULL AND (p.date, p.item_id) < (i.date, i.item_id) ORDER BY p.date DESC, p.item_id DESC LIMIT 1) AS prior FROM items i WHERE matter_id IS NOT NULL AND summary IS NULL")
def _(c: Catalog):
    i = c.items().where("matter_id is not null")
    return i.withColumn("prior", R.prior_row(i, "matter_id", "date", "summary", "item_id")).where("summary is null").select("item_id", "prior")


@civic("jon19_keyword_alerts", """WITH kw(o, word) AS (VALUES (0, 'trash'), (1, 'license'), (2, 'than'))
SELECT id, city, word FROM (SELECT t.id, t.city, k.word, row_number() OVER (PARTITION BY t.id ORDER BY k.o) AS r FROM texts t JOIN kw k ON contains(t.text, k.word) WHERE t.city IN ('src1', 'src2', 'src3')) WHERE r = 1""")
def _(c: Catalog):
    words = ["trash", "license", "than"]
    first = F.coalesce(*(F.when(F.col("text").contains(w), F.lit(w)) for w in words))
    return R.any_of(c.texts(), "city", ["src1", "src2", "src3"]).select("id", "city", first.alias("word")).where("word is not null")


@civic("jon20_matter_matches", "SELECT m.id, count(i.item_id) AS seen, max(i.date) AS last_seen FROM matters m JOIN items i ON i.matter_id = m.id WHERE contains(m.title, 'widget') GROUP BY 1")
def _(c: Catalog):
    m = c.matters().where(F.col("title").contains("widget")).select(F.col("id").alias("matter_id"))
    return c.items().join(m, "matter_id").groupBy(F.col("matter_id").alias("id")).agg(F.count("item_id").alias("seen"), F.max("date").alias("last_seen"))


@civic("jon21_both_tracks", "SELECT 'text' AS kind, id FROM texts WHERE contains(text, 'trash') UNION ALL SELECT 'matter', id FROM matters WHERE contains(title, 'widget')")
def _(c: Catalog):
    a = c.texts().where(F.col("text").contains("trash")).select(F.lit("text").alias("kind"), "id")
    return a.unionByName(c.matters().where(F.col("title").contains("widget")).select(F.lit("matter").alias("kind"), "id"))


@civic("jon23_name_variations", "SELECT DISTINCT c_mktsegment AS name, (SELECT min(o) FROM (VALUES (0, 'BUILDING'), (1, 'MACHINERY'), (2, 'FURNITURE')) v(o, n) WHERE n = c_mktsegment OR n = c_mktsegment || 'S') AS hit FROM customer")
def _(c: Catalog):
    names = c.table("customer").select(F.col("c_mktsegment").alias("name")).distinct()
    tried = names.select("name", F.posexplode(F.array("name", F.concat("name", F.lit("S")))).alias("nth", "variant"))
    known = c.spark.createDataFrame([(0, "BUILDING"), (1, "MACHINERY"), (2, "FURNITURE")], "hit int, variant string")
    return tried.join(F.broadcast(known), "variant", "left").groupBy("name").agg(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("nth"))).alias("hit"))


def word_overlap(matters: DataFrame, most: int = 500) -> DataFrame:
    """(a, b, score) of all pairs a < b of one file's matters (id, title, file): the share of the shorter title's words that both have.

    Matters of a file with the same words are one list, or several of at most
    `most`; a pair of lists has one score, and pairs are written out where the
    lists meet.
    """
    m = matters.select("file", "id", F.array_sort(F.array_distinct(F.split("title", " "))).alias("w"))
    nth = F.row_number().over(Window.partitionBy("file", "w").orderBy("id")) - 1
    lists = m.withColumn("part", F.floor(nth / most)).groupBy("file", "w", "part").agg(F.collect_list("id").alias("ids"))
    a, b = lists.select("file", F.col("w").alias("wa"), F.col("ids").alias("ids_a")), lists.select("file", F.col("w").alias("wb"), F.col("ids").alias("ids_b"))
    score = F.size(F.array_intersect("wa", "wb")) / F.least(F.size("wa"), F.size("wb"))
    met = a.join(b, "file").where(F.array_min("ids_a") < F.array_max("ids_b")).select("ids_a", "ids_b", score.alias("score"))
    return met.select("ids_b", "score", F.explode("ids_a").alias("a")).select("a", "score", F.explode("ids_b").alias("b")).where("a < b").select("a", "b", "score")


@civic("jon24_word_overlap", "SELECT a.id AS a, b.id AS b, len(list_intersect(string_split(a.title, ' '), string_split(b.title, ' '))) / least(len(list_distinct(string_split(a.title, ' '))), len(list_distinct(string_split(b.title, ' ')))) AS score FROM matters a JOIN matters b ON a.file = b.file AND a.id < b.id")
def _(c: Catalog):
    return word_overlap(c.matters())


@civic("jon25_county_members", "SELECT banana, kind FROM jurisdictions WHERE banana = 'nation0AF' OR county_banana = 'nation0AF'")
def _(c: Catalog):
    return c.jurisdictions().where("banana = 'nation0AF' or county_banana = 'nation0AF'").select("banana", "kind")


@civic("jon26_zip_lookup", "SELECT c_custkey AS zip, banana FROM customer JOIN jurisdictions ON c_nationkey = city_key")
def _(c: Catalog):
    z = c.table("customer").select(F.col("c_custkey").alias("zip"), F.col("c_nationkey").alias("city_key"))
    return z.join(F.broadcast(c.jurisdictions()), "city_key").select("zip", "banana")


@civic("jon27_target_expansion", """WITH t(o, x) AS (VALUES (0, 'AM'), (1, 'nation0AF'), (2, 'nation1AM'), (3, 'unknownXX'))
SELECT banana, min(o) AS nth FROM (SELECT o, banana FROM t JOIN jurisdictions ON length(x) = 2 AND state = x UNION ALL SELECT o, banana FROM t JOIN jurisdictions ON length(x) > 2 AND (banana = x OR county_banana = x) UNION ALL SELECT o, x FROM t WHERE length(x) > 2) GROUP BY 1""")
def _(c: Catalog):
    t = c.spark.createDataFrame([(0, "AM"), (1, "nation0AF"), (2, "nation1AM"), (3, "unknownXX")], "nth int, x string")
    j = c.jurisdictions()
    by_state = t.where("x rlike '^[A-Z]{2}$'").join(j, F.col("x") == F.col("state")).select("nth", "banana")
    named = t.where("not x rlike '^[A-Z]{2}$'")
    county = named.join(j, F.col("x") == F.col("county_banana")).select("nth", "banana")
    return by_state.unionByName(county).unionByName(named.select("nth", F.col("x").alias("banana"))).groupBy("banana").agg(F.min("nth").alias("nth"))


@civic("jon28_states_of_name", "SELECT state, count(*) AS n FROM jurisdictions WHERE upper(name) LIKE 'NATION_1%' GROUP BY 1")
def _(c: Catalog):
    return c.jurisdictions().where(F.upper("name").like("NATION_1%")).groupBy("state").agg(F.count("*").alias("n"))


@civic("jon29_id_remap", "SELECT i.item_id, coalesce(r.new, i.matter_id) AS matter_id FROM items i LEFT JOIN (SELECT id, min(id) OVER (PARTITION BY file, title) AS new FROM matters) r ON r.id = i.matter_id")
def _(c: Catalog):
    remap = c.matters().select(F.col("id").alias("matter_id"), F.min("id").over(Window.partitionBy("file", "title")).alias("new"))
    return c.items().join(remap, "matter_id", "left").select("item_id", F.coalesce("new", "matter_id").alias("matter_id"))


@civic("jon30_orphan_backfill", "SELECT matter_id, count(*) AS n, min(date) AS first_seen FROM items WHERE matter_id IS NOT NULL AND matter_id NOT IN (SELECT id FROM matters WHERE kind <> 'LARGE') GROUP BY 1")
def _(c: Catalog):
    known = c.matters().where("kind <> 'LARGE'").select(F.col("id").alias("matter_id"))
    return c.items().where("matter_id is not null").join(known, "matter_id", "left_anti").groupBy("matter_id").agg(F.count("*").alias("n"), F.min("date").alias("first_seen"))


@civic("src28_link_owner", "SELECT e.event_id, (SELECT o.event_id FROM ev o WHERE o.visitor = e.visitor AND o.event = 'signup' AND o.ts <= e.ts ORDER BY o.ts DESC, o.event_id DESC LIMIT 1) AS owner FROM ev e WHERE e.event = 'click'")
def _(c: Catalog):
    e = c.events()
    w = Window.partitionBy("visitor").orderBy("ts", F.expr("event <> 'signup'"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("event") == "signup", F.col("event_id")), ignorenulls=True).over(w)
    return e.where("event in ('click', 'signup')").withColumn("owner", owner).where("event = 'click'").select("event_id", "owner")


@civic("src24_gap_clusters", "SELECT visitor, cluster, count(*) AS n FROM (SELECT visitor, sum(j) OVER (PARTITION BY visitor ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT visitor, event_id, epoch_us(ts) / 1e6 AS t, CASE WHEN epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY visitor ORDER BY ts) > 36000 THEN 1 ELSE 0 END AS j FROM ev)) GROUP BY 1, 2")
def _(c: Catalog):
    e = c.events().withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return R.gap_clusters(e, ["visitor"], "t", 36000).groupBy("visitor", "cluster").agg(F.count("*").alias("n"))


