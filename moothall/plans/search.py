"""Full-text search, fuzzy names, opinion clusters and page parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from moothall.catalog import Catalog
from moothall.operators import opinions, search
from moothall.plans.registry import civic
from moothall.session import shared_folder
from moothall.sources import pages


@civic("fts02_match_all", r"SELECT id FROM texts WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])trash([^\p{L}\p{N}]|$)') AND regexp_matches(lower(text), '(^|[^\p{L}\p{N}])idiot([^\p{L}\p{N}]|$)')")
def _(c: Catalog):
    return search.match_all(c.texts().where(search.may_hold(F.col("text"), "the TRASH, idiot")).withColumn("t", search.tokens(F.col("text"))), "t", "the TRASH, idiot").select("id")


@civic("fts03_ranked", r"SELECT id FROM texts WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])moron([^\p{L}\p{N}]|$)')")
def _(c: Catalog):
    return search.match_all(c.texts().where(search.may_hold(F.col("text"), "moron")).withColumn("t", search.tokens(F.col("text"))), "t", "moron").orderBy(F.desc("rank"), "id").select("id")


@civic("fts04_headlines")
def _(c: Catalog):
    return c.texts().where(F.lower("text").contains("license")).select("id", search.headline(F.col("text"), ["license"]).alias("headline"))


@civic("fts05_matter_search", "SELECT id FROM matters m WHERE (title ILIKE '%widget%' OR file ILIKE '%brand#7-%') AND EXISTS (SELECT 1 FROM items i WHERE i.matter_id = m.id)")
def _(c: Catalog):
    by_file, by_text = F.col("file").ilike("%brand#7-%"), search.may_hold(F.concat_ws(" ", "title", "summary"), "widget")
    m = c.matters().where(by_file | by_text).withColumn("t", search.tokens(F.col("title"), F.col("summary")))
    return m.where(F.array_contains("t", search.stem("widget")) | by_file).select("id").join(c.items().select(F.col("matter_id").alias("id")), "id", "left_semi")


@civic("fts06_item_search", "SELECT i.item_id, m.title, g.date FROM items i JOIN matters m ON m.id = i.matter_id JOIN meetings g ON g.id = i.meeting_id WHERE g.city_key = 2 AND contains(m.title, 'widget')")
def _(c: Catalog):
    m = search.match_all(c.matters().where(search.may_hold(F.col("title"), "widgets")).withColumn("t", search.tokens(F.col("title"))), "t", "widgets").select(F.col("id").alias("matter_id"), "title")
    g = c.meetings().where("city_key = 2").select(F.col("id").alias("meeting_id"), F.col("date").alias("day"))
    return c.items().join(m, "matter_id").join(g, "meeting_id").select("item_id", "title", F.col("day").alias("date"))


@civic("fts07_topic_search", "SELECT m.id, string_agg(i.item_id::VARCHAR, ',' ORDER BY i.item_id) AS items FROM meetings m JOIN items i ON i.meeting_id = m.id WHERE i.summary = 'Summary A' AND m.city_key = 6 GROUP BY 1")
def _(c: Catalog):
    m = c.meetings().where("city_key = 6").select(F.col("id").alias("meeting_id"))
    hits = c.items().where("summary = 'Summary A'").join(m, "meeting_id").groupBy(F.col("meeting_id").alias("id")).agg(F.sort_array(F.collect_list("item_id")).alias("i"))
    return hits.select("id", F.array_join(F.transform("i", lambda x: x.cast("string")), ",").alias("items"))


@civic("jon22_fuzzy_names", "SELECT name FROM jurisdictions WHERE levenshtein(lower(name), 'natoin_12') <= 2")
def _(c: Catalog):
    return c.jurisdictions().where(F.levenshtein(F.lower("name"), F.lit("natoin_12")) <= 2).select("name")


@civic("clu03_group_counts", "SELECT city, greatest(2, least(2 + n // 12, 5, n)) AS k FROM (SELECT k % 20 AS city, count(DISTINCT visitor) AS n FROM ev GROUP BY 1)")
def _(c: Catalog):
    n = c.events().groupBy((F.col("k") % 20).alias("city")).agg(F.count_distinct("visitor").alias("n"))
    return n.select("city", F.greatest(F.lit(2).cast("long"), F.least(2 + F.floor(F.col("n") / 12), F.lit(5).cast("long"), "n")).alias("k"))


def deliberations(c: Catalog):
    return c.opinions().withColumn("deliberation", F.col("user_id") % 4).groupBy("deliberation", "user_id", "comment_id").agg(F.max_by("vote", F.struct("ts", "event_id")).alias("vote"))


@civic("clu01_participants", "SELECT deliberation, count(DISTINCT user_id) AS users, count(DISTINCT comment_id) AS comments FROM (SELECT *, date_trunc('hour', ts)::TIMESTAMP AS deliberation FROM opinions) GROUP BY 1 HAVING count(DISTINCT user_id) >= 3 AND count(DISTINCT comment_id) >= 2")
def _(c: Catalog):
    return opinions.participants(c.opinions().withColumn("deliberation", F.date_trunc("hour", "ts").cast("timestamp_ntz")))


@civic("clu02_positions")
def _(c: Catalog):
    return opinions.positions(deliberations(c), shared_folder(c.spark, "positions"))


@civic("clu04_opinion_clusters")
def _(c: Catalog):
    return opinions.cluster_opinions(deliberations(c), shared_folder(c.spark, "clusters"))


@civic("clu05_cluster_results")
def _(c: Catalog):
    v = deliberations(c)
    return opinions.cluster_results(v, opinions.cluster_opinions(v, shared_folder(c.spark, "clusters")))


@civic("src13_page_links", r"SELECT page_id, len(regexp_extract_all(html, '<a\s[^>]*href=')) AS links FROM pages")
def _(c: Catalog):
    return pages.parse_pages(c.table("pages")).groupBy("page_id").agg(F.count_if(F.col("kind") == "link").alias("links"))


@civic("src10_page_headings")
def _(c: Catalog):
    return pages.parse_pages(c.table("pages")).where("kind = 'heading'").select("page_id", "nth", "text")
