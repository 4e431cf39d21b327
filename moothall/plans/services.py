"""Queries of the service's tools, landed vendor files, stored search tokens and the search router."""

from __future__ import annotations

from pyspark.sql import functions as F

from moothall import api
from moothall.catalog import Catalog
from moothall.functions import agenda, ids, texts
from moothall.operators import search
from moothall.plans.registry import civic
from moothall.session import shared_folder
from moothall.sources import landed


@civic("api02_item_search", "SELECT i.item_id, m.title, g.date FROM items i JOIN matters m ON m.id = i.matter_id JOIN meetings g ON g.id = i.meeting_id WHERE g.city_key = 3 AND contains(m.title, 'widget') ORDER BY g.date DESC NULLS LAST, i.item_id LIMIT 20")
def _(c: Catalog):
    return api.search_items(c, "widgets", 3, 20)


@civic("api03_matter_search", "SELECT id, title FROM matters m WHERE contains(title, 'widget') AND EXISTS (SELECT 1 FROM items i JOIN meetings g ON g.id = i.meeting_id WHERE i.matter_id = m.id AND g.city_key = 3) ORDER BY id LIMIT 100")
def _(c: Catalog):
    return api.search_matters(c, "widget", 3, 500)


@civic("api04_cities", "SELECT banana, name, vendor FROM jurisdictions WHERE state = 'EU'")
def _(c: Catalog):
    return api.cities(c, "EU").select("banana", "name", "vendor")


@civic("api05_meeting", "SELECT m.id, m.date, string_agg(i.item_id::VARCHAR, ',' ORDER BY i.sequence) AS items FROM meetings m LEFT JOIN items i ON i.meeting_id = m.id WHERE m.id = (SELECT min(o_orderkey) + 2 FROM orders) GROUP BY 1, 2")
def _(c: Catalog):
    at = c.table("orders").agg(F.min("o_orderkey")).first()[0] + 2
    return api.meeting(c, at).select("id", "date", F.array_join(F.transform("items", lambda x: x["item_id"].cast("string")), ",").alias("items"))


@civic("api07_city_meetings", "SELECT id, date FROM meetings WHERE city_key = 4 ORDER BY date DESC NULLS LAST, id LIMIT 20")
def _(c: Catalog):
    return api.city_meetings(c, 4, 20)


def _landed(c: Catalog) -> landed.Landed:
    """The meetings as vendors would land them, one JSON object a line; those without a date break the contract."""
    m = c.meetings().join(F.broadcast(c.jurisdictions().select("city_key", "vendor")), "city_key")
    line = F.to_json(F.struct("vendor", F.col("id").cast("string").alias("vendor_id"), "title", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("start")))
    at = f"{shared_folder(c.spark, "service")}/landed"
    m.select(line.alias("value")).write.text(at)
    return landed.read_landed(c.spark, at)


@civic("src07_rejected_rows", "SELECT id::VARCHAR AS vendor_id, 'start' AS problems FROM meetings WHERE date IS NULL")
def _(c: Catalog):
    return _landed(c).rejected.select("vendor_id", F.array_join("problems", ",").alias("problems"))


@civic("src09_landed_meetings", "SELECT id::VARCHAR AS vendor_id, title, date AS start FROM meetings WHERE date IS NOT NULL")
def _(c: Catalog):
    return _landed(c).meetings.select("vendor_id", "title", "start")


@civic("src06_vendor_status", "SELECT vendor, count(*) AS rows, count(date) AS meetings, count(date) > 0 AS success FROM meetings JOIN jurisdictions USING (city_key) GROUP BY 1")
def _(c: Catalog):
    return _landed(c).status.select("vendor", "rows", "meetings", "success")


@civic("fts01_stored_tokens", r"SELECT id FROM texts WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])moron([^\p{L}\p{N}]|$)')")
def _(c: Catalog):
    """Searches read a table of tokens that is written once."""
    at = f"{shared_folder(c.spark, "service")}/tokens"
    c.texts().select("id", search.tokens(F.col("text")).alias("t")).write.parquet(at)
    return search.match_all(c.spark.read.parquet(at), "t", "moron").select("id")


@civic("fts08_routed_searches", "SELECT q, CASE WHEN regexp_full_match(q, '[0-9]{5}') THEN 'zipcode' WHEN upper(q) = 'MI' THEN 'state' WHEN ends_with(q, ', MI') THEN CASE WHEN starts_with(q, 'no') THEN 'unknown' ELSE 'city' END ELSE 'ambiguous' END AS kind, CASE WHEN ends_with(q, ', MI') AND NOT starts_with(q, 'no') THEN banana END AS banana FROM (SELECT banana, unnest([name || ', ' || state, lower(name), 'no' || name || ', ' || state, lpad((city_key * 7 % 100000)::VARCHAR, 5, '0'), state]) AS q FROM jurisdictions)")
def _(c: Catalog):
    j = c.jurisdictions()
    asked = F.array(F.concat_ws(", ", "name", "state"), F.lower("name"), F.concat(F.lit("no"), F.concat_ws(", ", "name", "state")), F.lpad((F.col("city_key") * 7 % 100000).cast("string"), 5, "0"), F.col("state"))
    return api.route_searches(j.select(F.explode(asked).alias("q")), j).select("q", "kind", "banana")


@civic("fun08_city_of_ids", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'town' || s_nationkey || 'CA' END AS city FROM supplier")
def _(c: Catalog):
    s = F.concat(F.lit("town"), F.col("s_nationkey").cast("string"), F.lit("CA_"), ids.digest(F.col("s_name"), 16))
    return c.table("supplier").select("s_suppkey", ids.city_of(F.when(F.col("s_suppkey") % 2 == 0, s).otherwise(F.concat(s, F.lit("_x")))).alias("city"))


_CITIES = [*dict.fromkeys(agenda.CITIES.values())]


@civic("fun22_city_names", f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ({_CITIES})[c_custkey % {len(_CITIES)} + 1] ELSE upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) END AS name FROM customer")
def _(c: Catalog):
    special = F.element_at(F.array(*map(F.lit, _CITIES)), (F.col("c_custkey") % len(_CITIES) + 1).cast("int"))
    written = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("  "), F.upper(special), F.lit(" "))).otherwise(F.col("c_mktsegment"))
    return c.table("customer").select("c_custkey", agenda.city_name(written).alias("name"))


@civic("fun25_attachments", "SELECT id, title AS name, 'http://x/' || id AS url, CASE WHEN id % 4 = 1 THEN 'h' || id END AS history_id FROM matters")
def _(c: Catalog):
    vendor = F.element_at(F.array(*map(F.lit, ("legistar", "primegov", "granicus", "legistar"))), (F.col("id") % 4 + 1).cast("int"))
    url, number = F.concat(F.lit("http://x/"), F.col("id").cast("string")), F.col("id") % 4
    raw = F.to_json(F.when(number == 0, F.create_map(F.lit("MatterAttachmentName"), "title", F.lit("MatterAttachmentHyperlink"), url)).when(number == 2, F.create_map(F.lit("title"), "title", F.lit("href"), url)).otherwise(F.create_map(F.lit("name"), "title", F.lit("url"), url, F.lit("history_id"), F.concat(F.lit("h"), F.col("id").cast("string")))))
    return c.matters().select("id", texts.normalise_attachment(vendor, raw).alias("a")).select("id", "a.*")


@civic("fun27_single_topics", "SELECT id, CASE WHEN w = 'ring' THEN 'jewels' WHEN w = 'red' THEN 'colour' ELSE w END AS topic FROM (SELECT id, lower(split_part(title, ' ', 1)) AS w FROM matters)")
def _(c: Catalog):
    return c.matters().select("id", agenda.normalise_topic(F.upper(F.split_part("title", F.lit(" "), F.lit(1))), [("ring", "jewels"), ("red", "colour")]).alias("topic"))
