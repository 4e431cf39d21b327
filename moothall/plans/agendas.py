"""Agenda functions and the service's documents over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from moothall import api
from moothall.catalog import Catalog
from moothall.functions import agenda, ids, texts
from moothall.operators import relational as R
from moothall.plans.registry import civic
from moothall.sources import agendas


@civic("flt11_skip_reasons", "SELECT id, CASE id % 6 WHEN 0 THEN 'procedural' WHEN 1 THEN 'ceremonial' WHEN 2 THEN 'administrative' END AS reason FROM matters")
def _(c: Catalog):
    k, name = F.col("id") % 6, F.col("title")
    title = F.when(k == 0, F.concat(F.lit("Approval of the "), name, F.lit(" Minutes"))).when(k == 1, F.concat(F.lit("Proclamation for "), name)).when(k == 2, F.concat(F.lit("LIQUOR license, "), name)).when(k == 3, "Proclamation of a local emergency").otherwise(name)
    return c.matters().select("id", agenda.skip_reason(title, F.col("kind")).alias("reason"))


@civic("flt18_both_urls", "SELECT page_id, contains(h, 'example.com') AND contains(h, 'm.') AS stored FROM (SELECT page_id, regexp_extract(url, '://([^/:?#]+)', 1) AS h FROM pages)")
def _(c: Catalog):
    host = F.parse_url("url", F.lit("HOST"))
    return c.table("pages").select("page_id", (host.contains("example.com") & host.contains("m.")).alias("stored"))


@civic("prj01_redaction", "SELECT event_id, CASE WHEN visitor % 2 = 0 THEN 'phone' ELSE 'email,phone,zoom' END AS kept FROM ev")
def _(c: Catalog):
    m = F.create_map(*map(F.lit, ("email", "a@b", "phone", "1", "zoom", "z")))
    kept = F.when(F.col("visitor") % 2 == 0, F.map_filter(m, lambda k, v: k == "phone")).otherwise(m)
    return c.events().select("event_id", F.array_join(F.sort_array(F.map_keys(kept)), ",").alias("kept"))


@civic("fun09_ids_match", "SELECT id, file = committee || '-12' AS same FROM matters")
def _(c: Catalog):
    none = F.lit(None).cast("string")
    mine = ids.matter_id(F.lit("cityCA"), F.col("file"), none, none)
    return c.matters().select("id", (mine == ids.matter_id(F.lit("cityCA"), F.concat("committee", F.lit("-12")), none, none)).alias("same"))


@civic("fun17_fallback_ids", "SELECT id, substr(sha256('slug_' || coalesce(strftime(date, '%Y%m%dT%H%M'), 'nodate') || '_' || lower(title)), 1, 12) AS vendor_id FROM meetings")
def _(c: Catalog):
    day = F.coalesce(F.date_format("date", "yyyyMMdd'T'HHmm"), F.lit("nodate"))
    return c.meetings().select("id", ids.digest(F.concat(F.lit("slug_"), day, F.lit("_"), F.lower(ids.collapse(F.col("title")))), 12).alias("vendor_id"))


@civic("fun21_city_and_state", "SELECT id, CASE WHEN id % 4 = 3 THEN 'nowhere at all' ELSE 'Palo Alto' END AS city, CASE id % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'NY' WHEN 2 THEN 'TX' ELSE '' END AS state FROM matters")
def _(c: Catalog):
    k = F.col("id") % 4
    s = agenda.city_and_state(F.when(k == 0, "palo alto, California").when(k == 1, " palo alto new york").when(k == 2, "Palo Alto tx").otherwise("nowhere at all"))
    return c.matters().select("id", s["city"].alias("city"), s["state"].alias("state"))


@civic("fun23_state_queries", "SELECT DISTINCT r_name, CASE WHEN r_name = 'AFRICA' THEN 'NM' END AS state FROM region")
def _(c: Catalog):
    return c.table("region").select("r_name", agenda.state_of(F.when(F.col("r_name") == "AFRICA", "New Mexico").otherwise(F.col("r_name"))).alias("state"))


@civic("fun26_topics", "SELECT id, CASE WHEN contains(title, 'ring') AND contains(title, 'red') THEN 'colour,jewels' WHEN contains(title, 'ring') THEN 'jewels' WHEN contains(title, 'red') THEN 'colour' ELSE '' END AS topics FROM matters")
def _(c: Catalog):
    synonyms = c.spark.createDataFrame([(0, "ring", "jewels"), (1, "red", "colour"), (2, "rings", "jewels")], "nth int, synonym string, canonical string")
    words = c.matters().select("id", F.explode(F.split("title", " ")).alias("topic"))
    return agenda.normalise_topics(words, synonyms).select("id", F.array_join("topics", ",").alias("topics"))


@civic("fun29_participation", "SELECT id, 'c' || id || '@city.gov' AS email, '+14155550' || lpad((id % 1000)::VARCHAR, 3, '0') AS phone, 'https://zoom.us/j/' || id AS virtual_url, '123 456 7890' AS meeting_id FROM matters")
def _(c: Catalog):
    n = F.col("id").cast("string")
    text = F.concat(F.lit("Mail noreply@x.org or c"), n, F.lit("@city.gov, phone (415) 555-0"), F.lpad((F.col("id") % 1000).cast("string"), 3, "0"), F.lit(". Zoom: https://zoom.us/j/"), n, F.lit(". Meeting ID: 123 456 7890"))
    p = agenda.participation(text)
    return c.matters().select("id", *(p[f].alias(f) for f in ("email", "phone", "virtual_url", "meeting_id")))


@civic("fun30_email_purpose", "SELECT id, CASE id % 3 WHEN 0 THEN 'written comments' WHEN 1 THEN 'city clerk' ELSE 'general contact' END AS purpose FROM matters")
def _(c: Catalog):
    k = F.col("id") % 3
    text = F.concat(F.when(k == 0, "Submit comment to ").when(k == 1, "The Clerk is at ").otherwise("Write to "), F.lit("A@b.gov."))
    return c.matters().select("id", agenda.email_purpose(text, F.lit("a@b.gov")).alias("purpose"))


@civic("fun31_matter_files", "SELECT id, CASE id % 3 WHEN 0 THEN '25-0' || id % 10 WHEN 1 THEN 'BL2025' END AS file FROM matters")
def _(c: Catalog):
    k = F.col("id") % 3
    title = F.when(k == 0, F.concat(F.lit("About 25-0"), (F.col("id") % 10).cast("string"))).otherwise(F.col("title"))
    return c.matters().select("id", agenda.matter_file(title, F.when(k == 1, "See Bill No. BL2025 now")).alias("file"))


@civic("fun32_item_numbers", "SELECT id, CASE id % 3 WHEN 0 THEN '3.1' WHEN 1 THEN 'B' END AS number, title AS rest FROM matters")
def _(c: Catalog):
    k = F.col("id") % 3
    s = agenda.item_number(F.concat(F.when(k == 0, "3.1) ").when(k == 1, "B. ").otherwise(""), "title"))
    return c.matters().select("id", s["number"].alias("number"), s["rest"].alias("rest"))


@civic("fun34_model_answers", "SELECT id, CASE WHEN id % 3 <> 2 THEN title END AS summary, CASE id % 3 WHEN 0 THEN 'parks' WHEN 1 THEN 'other' END AS topics FROM matters")
def _(c: Catalog):
    k = F.col("id") % 3
    made = F.when(k == 0, F.to_json(F.struct(F.col("title").alias("summary_markdown"), F.array(F.lit("parks"), F.lit("x")).alias("topics")))).when(k == 1, F.to_json(F.struct(F.col("title").alias("summary_markdown"), F.array(F.lit("y")).alias("topics")))).otherwise('{"summary_markdown": "no topics"}')
    s = agenda.parse_response(made, ["housing", "parks"])
    return c.matters().select("id", s["summary"].alias("summary"), F.array_join(s["topics"], ",").alias("topics"))


@civic("fun35_cut_answers", "SELECT id, title || ' and' AS summary, 0::INT AS n FROM matters")
def _(c: Catalog):
    s = agenda.salvage_response(F.concat(F.lit('{"summary_markdown": "'), "title", F.lit(" and")))
    return c.matters().select("id", s["summary"].alias("summary"), F.size(s["topics"]).alias("n"))


@civic("fun36_token_costs", "SELECT id, round(CASE WHEN id % 2 = 0 THEN length(text) / 1e6 * 0.0375 + 100 / 1e6 * 0.15 ELSE length(text) / 1e6 * 0.075 + 100 / 1e6 * 0.3 END, 9) AS cost FROM texts")
def _(c: Catalog):
    model = F.when(F.col("id") % 2 == 0, "Flash-LITE").otherwise("flash")
    return c.texts().select("id", F.round(agenda.token_cost(model, F.length("text"), F.lit(100)), 9).alias("cost"))


@civic("fun37_model_choice", "SELECT id, CASE WHEN length(text) < 2000 THEN 'flash-lite' ELSE 'flash' END AS model FROM texts")
def _(c: Catalog):
    return c.texts().select("id", agenda.model_choice(texts.page_estimate(F.col("text")), F.length("text"), 2000, 50).alias("model"))


@civic("fun45_name_variations", "SELECT c_mktsegment AS name, c_mktsegment || '|' || c_mktsegment || ' TOWNSHIP|' || c_mktsegment || ' CHARTER TOWNSHIP|' || c_mktsegment || ' CITY|' || c_mktsegment || ' TOWN' AS all FROM (SELECT DISTINCT c_mktsegment FROM customer)".replace("AS all", 'AS "all"'))
def _(c: Catalog):
    return c.table("customer").select(F.col("c_mktsegment").alias("name")).distinct().select("name", F.array_join(agenda.name_variations(F.lower("name"), F.lit("mi")), "|").alias("all"))


@civic("src23_parse_paths", "SELECT meeting_id, CASE WHEN k > 0 AND p > 10 THEN CASE WHEN n >= 3 AND d >= 2 THEN 'url_then_toc' ELSE 'url' END WHEN r >= 3 AND p > 10 THEN 'pageref' WHEN n >= 3 AND d >= 2 THEN 'toc' WHEN k > 0 THEN 'url' ELSE 'empty' END AS path FROM (SELECT meeting_id, count(*) AS n, count(DISTINCT sequence) AS d, count(*) FILTER (n_attachments = 3) AS k, count(*) FILTER (n_attachments = 1) AS r, sum(sequence) AS p FROM items GROUP BY 1)")
def _(c: Catalog):
    n = c.items().groupBy("meeting_id").agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("d"), F.count_if(F.col("n_attachments") == 3).alias("k"), F.count_if(F.col("n_attachments") == 1).alias("r"), F.sum("sequence").alias("p"))
    return n.select("meeting_id", agenda.parse_path(*map(F.col, "ndkrp")).alias("path"))


@civic("src25_line_heights", "SELECT visitor, coalesce(list_sort(list_filter(list(value ORDER BY event_id)[1:50], lambda x: x > 2))[len(list_filter(list(value ORDER BY event_id)[1:50], lambda x: x > 2)) // 2 + 1], 14.0) AS height FROM ev GROUP BY 1")
def _(c: Catalog):
    e = R.best_per_key(c.events(), ["visitor"], [F.asc("event_id"), F.asc("value")], 50)
    e = e.groupBy("visitor").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("v"))
    return e.select("visitor", agenda.upper_median(F.col("v")).alias("height"))


@civic("src30_file_formats", "SELECT id, CASE id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'rtf' ELSE 'unknown' END AS format FROM matters")
def _(c: Catalog):
    k = F.col("id") % 4
    data = F.concat(F.when(k == 0, F.unhex(F.lit("255044462D"))).when(k == 1, F.unhex(F.lit("504B0304"))).when(k == 2, F.unhex(F.lit("7B5C727466"))).otherwise(F.unhex(F.lit("00"))), F.col("title").cast("binary"))
    return c.matters().select("id", agenda.file_format(data).alias("format"))


@civic("snk11_map_merge", "SELECT id, CASE WHEN id % 2 = 0 THEN 'new' ELSE 'old' END AS hash, title FROM matters")
def _(c: Catalog):
    old = F.create_map(F.lit("hash"), F.lit("old"), F.lit("title"), F.col("title"))
    new = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("hash"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    return c.matters().select("id", merged["hash"].alias("hash"), merged["title"].alias("title"))


@civic("snk12_geojson", """SELECT banana, '{"type":"Feature","properties":{"name":"' || name || '","population":' || population || '}}' AS feature FROM jurisdictions WHERE has_geom""")
def _(c: Catalog):
    return c.jurisdictions().where("has_geom").select("banana", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("name", "population").alias("properties"))).alias("feature"))


@civic("api01_guarded_sql", "SELECT state, count(*) AS n FROM jurisdictions GROUP BY 1")
def _(c: Catalog):
    return api.run_sql(c, "SELECT state, count(*) AS n FROM jurisdictions GROUP BY state -- by state")


@civic("api06_matter_timeline", "SELECT item_id, date FROM items WHERE matter_id = 33 ORDER BY date, item_id LIMIT 100")
def _(c: Catalog):
    return c.items().where("matter_id = 33").orderBy("date", "item_id").limit(api.MOST_ROWS).select("item_id", "date")


@civic("api09_meeting_documents", "SELECT m.id, CASE WHEN bool_or(i.summary IS NOT NULL) THEN count(i.item_id) END AS n FROM meetings m LEFT JOIN items i ON i.meeting_id = m.id WHERE m.city_key = 8 GROUP BY 1")
def _(c: Catalog):
    return api.meeting_documents(c, 8).select("id", F.when(F.col("items").isNotNull(), F.size("items").cast("long")).alias("n"))


@civic("api10_listing", "SELECT m.id, coalesce(h.has, false) AS has_items FROM meetings m LEFT JOIN (SELECT meeting_id, bool_or(summary IS NOT NULL) AS has FROM items GROUP BY 1) h ON h.meeting_id = m.id WHERE city_key = 5 ORDER BY m.date DESC NULLS LAST, m.id LIMIT 100")
def _(c: Catalog):
    return api.listing(c, 5).select("id", "has_items")


@civic("api11_matters_page", "SELECT matter_id, n FROM (SELECT matter_id, count(*) AS n FROM items WHERE matter_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, matter_id LIMIT 10 OFFSET 10)")
def _(c: Catalog):
    return api.matter_page(c, 10, 10).select("matter_id", F.size("timeline").cast("long").alias("n"))


@civic("api12_state_meetings", "SELECT m.id, m.date FROM meetings m JOIN jurisdictions USING (city_key) WHERE state = 'EU' AND m.date >= TIMESTAMP '2001-06-01' - INTERVAL 6 HOUR ORDER BY m.date, m.id LIMIT 100")
def _(c: Catalog):
    j = F.broadcast(c.jurisdictions().where("state = 'EU'").select("city_key"))  # cities of a state
    since = F.lit("2001-06-01").cast("timestamp_ntz") - F.expr("interval 6 hour")
    return c.meetings().where(F.col("date") >= since).join(j, "city_key").orderBy("date", "id").limit(100).select("id", "date")


@civic("api13_activity_feed", "SELECT a.event_id, b.event AS next FROM ev a JOIN ev b ON b.event_id = a.event_id + 1 WHERE a.event = 'view' AND b.event = 'click'")
def _(c: Catalog):
    lines = c.events().select("event_id", F.concat_ws(" ", F.lit("GET"), "event").alias("line"))
    after = lines.select((F.col("event_id") - 1).alias("event_id"), F.col("line").alias("after"))
    pairs = lines.where(F.col("line").endswith("view")).join(after, "event_id")
    return pairs.select("event_id", F.regexp_extract("after", "GET (click)$", 1).alias("next")).where("next <> ''")


@civic("src18_layout_items", r"SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<li><a href=\"[^\"]*\">[^<]+</a></li>')) FROM pages) GROUP BY 1".replace('\\"', '"'))
def _(c: Catalog):
    nav = agendas.Layout(r"nav/ul/li$", r"nav/ul/li", attachment="$^")
    return agendas.agenda_items(agendas.page_nodes(c.table("pages")), nav).groupBy("page_id").agg(F.count("*").alias("n"))


@civic("src27_line_items")
def _(c: Catalog):
    lines = c.texts().select(F.col("id").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    numbered = lines.withColumn("text", F.when(F.col("line") % 3 == 0, F.concat(F.lit("1. "), "text")).otherwise(F.col("text")))
    return agendas.lines_to_items(numbered).select("doc_id", "sequence", "number", "title")


@civic("fun28_display_names", "SELECT event, upper(substr(event, 1, 1)) || substr(event, 2) || ' Events' AS name FROM (SELECT DISTINCT event FROM ev)")
def _(c: Catalog):
    return c.events().select("event").distinct().select("event", texts.display_name(F.concat("event", F.lit("_events"))).alias("name"))


@civic("fun33_title_similarity")
def _(c: Catalog):
    m = c.matters()
    after = m.select((F.col("id") - 1).alias("id"), F.col("title").alias("other"))
    return m.join(after, "id").select("id", F.round(texts.similarity(F.col("title"), F.col("other")), 6).alias("score"))


@civic("fun40_summary_sections", "SELECT id, title || ' facts' AS part FROM matters")
def _(c: Catalog):
    made = F.concat(F.lit("## Summary\nintro\n## Key Facts\n"), "title", F.lit(" facts\n## More\nrest"))
    return c.matters().select("id", texts.section(made, "Key Facts").alias("part"))


@civic("fun41_short_titles", "SELECT id, CASE WHEN length(title) <= 8 THEN title ELSE split_part(title, ' ', 1) || '...' END AS t FROM matters")
def _(c: Catalog):
    return c.matters().select("id", texts.truncate(F.col("title"), 8).alias("t"))


@civic("fun43_flyer_texts", "SELECT id, '<strong>' || title || '</strong> facts' AS t FROM matters")
def _(c: Catalog):
    made = F.concat(F.lit("## Intro\nskip\n## Facts\n**"), "title", F.lit("**\n facts\n## End\nx"))
    return c.matters().select("id", texts.flyer_text(made, ["Facts"]).alias("t"))


@civic("fun44_place_slugs", "SELECT city_key, 'canadanation' || city_key AS slug FROM jurisdictions")
def _(c: Catalog):
    return c.jurisdictions().select("city_key", texts.place_slug(F.concat(F.lit("Cañáda "), "name")).alias("slug"))


_LOW = "|".join(f"(?:{p})" for patterns in texts.LOW_VALUE.values() for p in patterns)
#: A name for each pattern, and names beside them that no pattern takes.
_NAMES = (
    "Public Comment 3", "public correspondence", "Comment Letter A", "Comment Ltrs", "Written Comments", "Public Hearing Comment", "Citizen comment", "Correspondence received", "Public input", "Public testimony", "Letters received", "Petitions and", "Pub Corr", "Pulbic Corr",
    "Comm Pkt", "Cmte Pkt", "Committee Packet", "Board Pkt", "Co-Sponsor Request Chen", "cosponsorship ltr", "Sponsor request", "Communications  from Public_03", "Community Impact Statement", "Speaker Card(s)", "Parcel Table", "Parcel list", "Parcel map", "Tax parcel", "Property list",
    "Property table", "Assessor's Parcel Table", "Assessor roll", "APN list", "Parcel number", "Omnia Partners contract", "Sourcewell contract", "NASPO ValuePoint", "U.S. Communities", "US communities", "HGAC Buy", "Master agreement", "Terms and conditions", "General conditions", "Insurance certificate",
    "Certificate of insurance", "W-9", "W9", "Bid tabulation", "CEQA Det", "CEQA Determination", "Referral CEQA", "Referral FYI", "Myr Memo", "Mayor's memo", "Comm Rpt Rqst", "Committee Report Request", "Referral to PC", "Referral to PCs", "Hearing notice", "Notice of hearing",
    "Notice of Public Hearing", "FEIR vol 2", "DEIR", "SEIR", "EIR", "their", "Environmental Impact Report", "CEQA findings", "Initial study", "Negative declaration", "Notice of preparation", "Staff report", "Ordinance", "Leg Ver 3", "W 9", "Assessor", "PC Transmittal",
)


@civic("flt14_low_value_attachments", f"SELECT id, name, regexp_matches(lower(name), '{_LOW}') AS low FROM (SELECT id, title || ' ' || ({[n.replace(chr(39), chr(96)) for n in _NAMES]})[id % {len(_NAMES)} + 1] AS name FROM matters)".replace("`", "''"))
def _(c: Catalog):
    name = F.concat("title", F.lit(" "), F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("id") % len(_NAMES) + 1).cast("int")))
    return c.matters().select("id", name.alias("name"), texts.low_value_attachment(name).alias("low"))


@civic("fun12_substantive_hash", "SELECT id, CASE WHEN id % 2 = 0 THEN '' ELSE sha256('u|' || title) END AS hash FROM matters")
def _(c: Catalog):
    a = F.struct(F.lit("u").alias("url"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("Speaker card "), "title")).otherwise(F.col("title")).alias("name"))
    return c.matters().select("id", ids.attachments_hash(F.filter(F.array(a), lambda x: ~texts.low_value_attachment(x["name"]))).alias("hash"))


@civic("str05_stale_leases", "SELECT id, CASE WHEN status = 'postponed' AND date < TIMESTAMP '2001-06-01' - INTERVAL 10 MINUTE THEN 'pending' ELSE coalesce(status, 'done') END AS state FROM meetings")
def _(c: Catalog):
    stale = (F.col("status") == "postponed") & (F.col("date") < F.lit("2001-06-01").cast("timestamp_ntz") - F.expr("interval 10 minute"))
    return c.meetings().select("id", F.when(stale, "pending").otherwise(F.coalesce("status", F.lit("done"))).alias("state"))


@civic("str07_reprocess", "SELECT id, CASE WHEN id % 3 = 0 THEN 'skip' WHEN summary IS NULL THEN 'go' WHEN id % 2 = 0 THEN 'skip' ELSE 'go' END AS decision FROM matters")
def _(c: Catalog):
    old, new = F.lit("h0"), F.concat(F.lit("h"), (F.col("id") % 2).cast("string"))
    return c.matters().select("id", F.when(F.col("id") % 3 == 0, "skip").when(F.col("summary").isNull(), "go").when(old == new, "skip").otherwise("go").alias("decision"))


@civic("src26_toc_shapes", """WITH t AS (SELECT l_orderkey AS doc, l_linenumber AS nth, l_suppkey % 4 + 1 AS level, l_linenumber = 5 AS skipped, l_partkey % 6 - 1 AS page FROM lineitem),
p AS (SELECT doc, page, count(*) AS n, min(nth) AS first FROM t WHERE level = 1 AND NOT skipped GROUP BY 1, 2),
r AS (SELECT doc, page, sum(n) OVER (PARTITION BY doc ORDER BY n DESC, first, page) - n AS before, sum(n) OVER (PARTITION BY doc) * 0.7::DOUBLE AS most FROM p),
o AS (SELECT doc, max(page) FILTER (before < most) AS last, count(*) AS pages FROM r GROUP BY 1),
c AS (SELECT doc, count(*) FILTER (level = 1 AND NOT skipped) AS n1, count(*) FILTER (level = 3) AS n3, count(*) FILTER (level = 4) AS n4, list(page) FILTER (level = 2) AS second FROM t GROUP BY 1)
SELECT c.doc, CASE WHEN n1 = 0 THEN 'flat' WHEN n1 <= 3 AND n3 >= 2 AND len(list_filter(second, lambda x: x <= 0)) > 0 THEN 'document_bundle' WHEN n1 <= 2 AND n3 >= 3 AND n4 >= 1 THEN 'deep_hierarchical'
WHEN len(list_filter(second, lambda x: x > last + 1)) > 0 AND pages <= greatest(5, n1 * 0.3) THEN 'hierarchical' ELSE 'flat' END AS shape FROM c LEFT JOIN o ON o.doc = c.doc""")
def _(c: Catalog):
    n = F.col("l_linenumber")
    toc = c.table("lineitem").select(F.col("l_orderkey").alias("doc"), n.alias("nth"), (F.col("l_suppkey") % 4 + 1).alias("level"), F.when(n == 5, " Top ").otherwise("Item").alias("title"), (F.col("l_partkey") % 6 - 1).alias("page"))
    return agendas.toc_shapes(toc)
