"""The scalar libraries applied to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from moothall.catalog import Catalog
from moothall.functions import ids, texts
from moothall.plans.registry import civic

LABEL = "CASE p_partkey % 4 WHEN 0 THEN 'FIRST READING:  An ordinance about the ' || p_name || ' of ' || p_brand WHEN 1 THEN 'An  ordinance about the ' || p_name || ' of ' || p_brand WHEN 2 THEN 'Public Comment' ELSE 'Reintroduced second read: ' || p_name END"


def titles(c: Catalog):
    """Parts as agenda titles with reading marks, odd spacing and generic ones among them."""
    return c.table("part").select("p_partkey", "p_brand", "p_type", "p_size", F.expr(LABEL).alias("title"))


@civic("fun01_matter_ids", f"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'cityCA_' || substr(sha256('cityCA:file:' || p_brand), 1, 16) WHEN p_partkey % 5 = 1 THEN 'cityCA_' || substr(sha256('cityCA:id:' || p_partkey), 1, 16)
 WHEN n IS NOT NULL THEN 'cityCA_' || substr(sha256('cityCA:title:' || n), 1, 16) END AS matter_id FROM (SELECT *, CASE WHEN length(t) >= 30 AND length(k) >= 30 THEN k END AS n FROM (SELECT *, lower(trim(regexp_replace(regexp_replace(t, '^(FIRST READING|REINTRODUCED SECOND READ):\\s*', '', 'i'), '\\s+', ' ', 'g'))) AS k FROM (SELECT p_partkey, p_brand, trim(regexp_replace({LABEL}, '\\s+', ' ', 'g')) AS t FROM part)))""")
def _(c: Catalog):
    k = F.col("p_partkey") % 5
    file, vendor = F.when(k == 0, F.col("p_brand")).otherwise(""), F.when(k == 1, F.col("p_partkey").cast("string"))
    return titles(c).select("p_partkey", ids.matter_id(F.lit("cityCA"), file, vendor, F.col("title")).alias("matter_id"))


@civic("fun02_title_keys", f"SELECT p_partkey, CASE WHEN length(t) >= 30 AND length(k) >= 30 THEN k END AS key FROM (SELECT p_partkey, t, lower(trim(regexp_replace(regexp_replace(t, '^(FIRST READING|REINTRODUCED SECOND READ):\\s*', '', 'i'), '\\s+', ' ', 'g'))) AS k FROM (SELECT p_partkey, trim(regexp_replace({LABEL}, '\\s+', ' ', 'g')) AS t FROM part))")
def _(c: Catalog):
    return titles(c).select("p_partkey", ids.matter_title(F.col("title")).alias("key"))


@civic("fun03_without_reading", f"SELECT p_partkey, regexp_replace({LABEL}, '^(FIRST READING|REINTRODUCED SECOND READ):\\s*', '', 'i') AS title FROM part")
def _(c: Catalog):
    return titles(c).select("p_partkey", ids.without_reading(F.col("title")).alias("title"))


@civic("fun04_meeting_ids", "SELECT id, 'cityCA_' || substr(md5('cityCA:' || id || ':' || strftime(date, '%Y%m%dT%H%M%S') || ':' || title), 1, 8) AS meeting_id FROM meetings")
def _(c: Catalog):
    return c.meetings().select("id", ids.meeting_id(F.lit("cityCA"), F.col("id").cast("string"), F.col("date"), F.col("title")).alias("meeting_id"))


@civic("fun05_item_ids", "SELECT item_id, meeting_id || '_' || coalesce(lower(agenda_number), 'seq' || lpad(sequence::VARCHAR, 3, '0') || '_' || substr(sha256(meeting_id || ':' || coalesce(summary, '')), 1, 8)) AS id FROM items")
def _(c: Catalog):
    m = F.col("meeting_id").cast("string")
    return c.items().select("item_id", ids.item_id(m, F.col("agenda_number"), F.col("sequence"), F.coalesce("summary", F.lit(""))).alias("id"))


@civic("fun06_person_ids", "SELECT s_suppkey, 'cityCA_cm_' || substr(sha256('cityCA:' || lower(s_name)), 1, 16) AS member_id FROM supplier")
def _(c: Catalog):
    return c.table("supplier").select("s_suppkey", ids.person_id(F.lit("cityCA"), F.concat(F.lit("  "), F.col("s_name"), F.lit(" "))).alias("member_id"))


@civic("fun07_valid_ids", "SELECT id, regexp_matches(x, '^[a-z0-9]+[A-Z]{2}_[0-9a-fA-F]{16}$') AS valid, CASE WHEN regexp_matches(x, '^[a-z0-9]+[A-Z]{2}_[0-9a-fA-F]{16}$') THEN split_part(x, '_', 1) END AS city FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'cityCA_' || substr(sha256(title), 1, 16) ELSE 'city_' || title END AS x FROM matters)")
def _(c: Catalog):
    x = F.when(F.col("id") % 3 == 0, F.concat(F.lit("cityCA_"), ids.digest(F.col("title"), 16))).otherwise(F.concat(F.lit("city_"), F.col("title")))
    return c.matters().select("id", ids.is_matter_id(x).alias("valid"), ids.city_of(x).alias("city"))


@civic("fun10_name_keys", "SELECT c_custkey, lower(trim(regexp_replace(c_name || '  ' || c_mktsegment, '\\s+', ' ', 'g'))) AS key FROM customer")
def _(c: Catalog):
    return c.table("customer").select("c_custkey", F.lower(ids.collapse(F.concat("c_name", F.lit("  "), "c_mktsegment", F.lit(" ")))).alias("key"))


@civic("fun11_attachment_hash", "SELECT meeting_id, sha256(string_agg(u || '|' || n, chr(10) ORDER BY u || '|' || n)) AS hash FROM (SELECT meeting_id, 'u' || sequence AS u, coalesce(matter_id, 0)::VARCHAR AS n FROM items) GROUP BY 1")
def _(c: Catalog):
    a = F.struct(F.concat(F.lit("u"), F.col("sequence").cast("string")).alias("url"), F.coalesce("matter_id", F.lit(0).cast("long")).cast("string").alias("name"))
    return c.items().groupBy("meeting_id").agg(F.collect_list(a).alias("a")).select("meeting_id", ids.attachments_hash(F.col("a")).alias("hash"))


@civic("fun13_date_and_time", "SELECT id, coalesce(date + CASE id % 3 WHEN 0 THEN INTERVAL 1110 MINUTE WHEN 1 THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END, NULL) AS at FROM meetings")
def _(c: Catalog):
    clock = F.when(F.col("id") % 3 == 0, "6:30 PM PST").when(F.col("id") % 3 == 1, "9 AM").otherwise("noonish")
    return c.meetings().select("id", texts.parse_time(F.col("date"), clock).alias("at"))


@civic("fun14_date_forms", "SELECT id, date AS at FROM meetings")
def _(c: Catalog):
    d = F.col("date").cast("timestamp")
    form = F.when(F.col("id") % 3 == 0, F.date_format(d, "M/d/yyyy")).when(F.col("id") % 3 == 1, F.date_format(d, "MMMM d, yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
    return c.meetings().select("id", texts.parse_date(form).alias("at"))


@civic("fun15_status_words", "SELECT id, CASE WHEN id % 4 = 0 THEN 'revised' WHEN id % 4 = 1 THEN 'deferred' WHEN title LIKE '%HIGH%' THEN NULL END AS status FROM meetings")
def _(c: Catalog):
    more = F.when(F.col("id") % 4 == 0, "Cancelled, then amendment").when(F.col("id") % 4 == 1, "deferred")
    return c.meetings().select("id", texts.meeting_status(F.col("title"), more).alias("status"))


@civic("fun16_html_text", r"SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<br\s*/?>', ' ', 'gi'), '<[^>]+>', '', 'g'), '&amp;', '&'), '&#038;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&#8211;', '–'), '&#8212;', '—'), '&#8217;', '’'), '\s+', ' ', 'g'))) AS digest FROM pages")
def _(c: Catalog):
    return c.table("pages").select("page_id", F.md5(texts.strip_html(F.col("html")).cast("binary")).alias("digest"))


@civic("fun18_markdown_text", "SELECT id, 'About ' || title || ' of ' || committee || ' here' AS t FROM matters")
def _(c: Catalog):
    made = F.concat(F.lit("## About\n**"), F.col("title"), F.lit("** of  ["), F.col("committee"), F.lit("](http://x.y) `here`"))
    return c.matters().select("id", texts.strip_markdown(made).alias("t"))


@civic("fun19_snippets", "SELECT id, least(length(text), 1) AS has FROM texts WHERE contains(lower(text), 'trash')")
def _(c: Catalog):
    t = c.texts().where(F.lower("text").contains("trash"))
    cut = texts.snippet(F.col("text"), "trash", 120)
    return t.select("id", F.when(F.lower(cut).contains("trash") & (F.length(cut) <= 170), 1).otherwise(0).cast("long").alias("has"))


@civic("fun20_highlight", "SELECT id, replace(title, 'red', '<mark>red</mark>') AS t FROM matters")
def _(c: Catalog):
    return c.matters().select("id", texts.highlight(F.col("title"), "RED").alias("t"))


@civic("fun24_attachment_types", "SELECT id, CASE id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'doc' WHEN 2 THEN 'spreadsheet' WHEN 3 THEN 'presentation' ELSE 'unknown' END AS kind FROM matters")
def _(c: Catalog):
    ext = F.element_at(F.array(*map(F.lit, (".PDF", ".docx", ".xls", ".pptx", ".zip"))), (F.col("id") % 5 + 1).cast("int"))
    return c.matters().select("id", texts.attachment_type(F.concat(F.lit("http://x/"), F.col("title"), ext), F.col("kind")).alias("kind"))


@civic("fun38_page_estimate", "SELECT id, greatest(1, length(text) // 2000) AS pages FROM texts")
def _(c: Catalog):
    return c.texts().select("id", texts.page_estimate(F.col("text")).alias("pages"))


@civic("fun39_text_quality", "SELECT id, CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN length(text) < 100 THEN 'too_short' WHEN ends_with(text, '...') OR len(regexp_extract_all(text, '\\.\\.\\.')) > 2 THEN 'truncated' WHEN contains(text, '**') OR contains(text, '##') THEN 'good' ELSE 'suspicious' END AS quality FROM texts")
def _(c: Catalog):
    return c.texts().select("id", texts.quality(F.col("text")).alias("quality"))


@civic("fun42_slugs", "SELECT id, regexp_replace(regexp_replace(lower(file || ' ' || title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM matters")
def _(c: Catalog):
    return c.matters().select("id", texts.slug(F.concat_ws(" ", "file", "title")).alias("slug"))


@civic("fun46_committee_titles", "SELECT id, contains(title, 'ring') OR contains(title, 'board') AS hit FROM matters")
def _(c: Catalog):
    named = F.replace(F.col("title"), F.lit("ring"), F.lit("Task Force"))
    return c.matters().select("id", texts.contains_any(named, texts.BODIES).alias("hit"))


@civic("fun47_readable", "SELECT id, coalesce(length(text) >= 100 AND length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text) >= 0.3, false) AS ok FROM texts")
def _(c: Catalog):
    return c.texts().select("id", texts.is_readable(F.col("text")).alias("ok"))


@civic("fun48_null_bytes", "SELECT id, length(title) AS n FROM matters")
def _(c: Catalog):
    return c.matters().select("id", F.length(F.replace(F.concat("title", F.lit("\x00")), F.lit("\x00"), F.lit(""))).cast("long").alias("n"))


@civic("fun49_canonical_votes", "SELECT vote, count(*) AS n FROM (SELECT CASE vote WHEN 'nay' THEN 'no' ELSE vote END AS vote FROM votes) GROUP BY 1")
def _(c: Catalog):
    known = {"yes": "yes", "aye": "yes", "yea": "yes", "no": "no", "nay": "no", "abstain": "abstain", "absent": "absent", "excused": "absent", "present": "present", "recused": "recused", "not_voting": "not_voting"}
    lookup = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    vote = F.coalesce(F.try_element_at(lookup, F.trim(F.lower("vote"))), F.lit("not_voting"))
    return c.votes().groupBy(vote.alias("vote")).agg(F.count("*").alias("n"))


@civic("fun50_committee_from_title", "SELECT id, CASE WHEN split_part(title, '-', 2) IN ('LOW') THEN NULL ELSE split_part(title, '-', 2) END AS name FROM meetings")
def _(c: Catalog):
    name = F.split_part("title", F.lit("-"), F.lit(2))
    return c.meetings().select("id", F.when(~name.isin("LOW"), name).alias("name"))


@civic("fun51_payload_codec", "SELECT event, count(*) AS n, sum(k)::BIGINT AS total FROM ev GROUP BY 1")
def _(c: Catalog):
    e = c.table("events").select(F.col("event_type").alias("event"), F.from_json("props", "k long").alias("p"))
    return e.groupBy("event").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


@civic("flt12_test_meetings", "SELECT id FROM matters WHERE id % 3 = 0")
def _(c: Catalog):
    title = F.concat(F.col("title"), F.when(F.col("id") % 3 == 0, " Training session").otherwise(" testimony"))
    return c.matters().where(texts.is_test_meeting(title)).select("id")


@civic("flt13_skipped_kinds", "SELECT id FROM matters WHERE contains(lower(kind), 'eco') OR contains(lower(kind), 'min')")
def _(c: Catalog):
    return c.matters().where(texts.contains_any(F.col("kind"), ("Eco", "Min"))).select("id")


@civic("flt15_comment_compilations", "SELECT id FROM texts WHERE length(text) > 5000 AND len(regexp_extract_all(lower(text), 'the,')) > 3")
def _(c: Catalog):
    return c.texts().where((F.length("text") > 5000) & (F.regexp_count(F.lower("text"), F.lit("the,")) > 3)).select("id")


@civic("flt17_url_domains", "SELECT page_id, CASE WHEN url IS NULL THEN 'store' WHEN contains(regexp_extract(url, '://([^/:?#]+)', 1), 'example.com') THEN 'store' ELSE 'reject' END AS verdict FROM pages")
def _(c: Catalog):
    host = F.parse_url("url", F.lit("HOST"))
    return c.table("pages").select("page_id", F.when(F.col("url").isNull(), "store").when(host.isNull(), "warn").when(host.contains("example.com"), "store").otherwise("reject").alias("verdict"))


@civic("flt19_contract_violations", "SELECT meeting_id, sequence, CASE WHEN sequence > 6 THEN 'sequence' ELSE '' END || CASE WHEN agenda_number IS NULL THEN 'number' ELSE '' END AS problems FROM items WHERE sequence > 6 OR agenda_number IS NULL")
def _(c: Catalog):
    problems = F.filter(F.array(F.when(F.col("sequence") > 6, "sequence"), F.when(F.expr("try_cast(agenda_number as int)").isNull(), "number")), lambda x: x.isNotNull())
    return c.items().withColumn("p", problems).where("size(p) > 0").select("meeting_id", "sequence", F.array_join("p", "").alias("problems"))


@civic("src31_recognised_text", "SELECT a.id, length(b.text) > 0 AND ((length(trim(a.text)) = 0 AND length(trim(b.text)) >= 100 AND r > 0.15) OR (length(trim(b.text)) >= 2 * length(trim(a.text)) AND r > 0.4) OR (length(trim(b.text)) > length(trim(a.text)) AND r > 0.7)) AS better FROM texts a JOIN (SELECT id - 1 AS id, text, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text) AS r FROM texts) b ON a.id = b.id")
def _(c: Catalog):
    b = c.texts().select((F.col("id") - 1).alias("id"), F.col("text").alias("other"))
    return c.texts().join(b, "id").select("id", texts.recognised_is_better(F.col("text"), F.col("other")).alias("better"))



