"""Operator 7, URL filters: a temporal list join, in DataFrame functions only.

Dated list entries become validity intervals. Every capture looks up its host,
each parent domain and each path prefix among the intervals by equality of
(kind, pattern, month), and keeps those that hold at its fetch time.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Lists of which an entry lets a capture pass whatever other lists say.
ALLOW = ("trusted",)


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port or trailing dot; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?:[:/?#]|$)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """Every (kind, pattern) by which an entry can name the URL: host, domain and its parents, host with each path prefix."""
    host = host_of(url)
    labels, parts = F.split(host, r"\."), F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    key = lambda kind, p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern"))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: key("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: key("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))))
    return F.when(host.isNotNull(), F.concat(F.array(key("host", host)), domains, F.coalesce(prefixes, F.slice(domains, 1, 0))))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals (list, kind, pattern, valid_from, valid_to) of dated entries (list, kind, pattern, action, at): from an add up to the next entry of the same key, for ever (null) if none follows. At one moment a removal counts after an addition. Hosts are lowered, paths keep their case."""
    w = Window.partitionBy("list", "kind", "pattern").orderBy("at", "action")
    head = F.substring_index("pattern", "/", 1)
    pattern = F.when(F.col("kind") == "prefix", F.concat(F.lower(head), F.col("pattern").substr(F.length(head) + 1, F.length("pattern")))).otherwise(F.lower("pattern"))
    dated = entries.select("list", "kind", pattern.alias("pattern"), "action", "at").where("list is not null and pattern is not null and at is not null and action in ('add', 'remove')").distinct()
    return dated.withColumn("valid_to", F.lead("at").over(w)).where("action = 'add' and (valid_to is null or valid_to > at)").select("list", "kind", "pattern", F.col("at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, allow: Collection[str] = ALLOW) -> DataFrame:
    """Rows (page_id, url, fetched_at, lists, n_lists, decision), one for each capture (page_id, url, fetched_at).

    lists has the names, sorted, of all lists with an entry for the URL that
    holds at the fetch time (start included, end not). decision is allow where
    one of them is in `allow`, else block where there is any, else keep. Null
    and malformed URLs and null times match nothing: keep. Null ids and
    repeated rows stay. A host with very many captures is split by adaptive
    skew handling; an entry's history is cut in months, so that a pattern that
    is listed often meets only the captures of its months.
    """
    captures = captures.select("page_id", "url", "fetched_at")
    month = lambda c: F.trunc(c, "MM")
    until = captures.agg(F.max("fetched_at")).first()[0]
    intervals = validity(entries).where(F.col("valid_from") <= F.lit(until))
    last = F.least(F.coalesce("valid_to", F.lit(until)), F.lit(until))
    intervals = intervals.withColumn("month", F.explode(F.sequence(month(F.col("valid_from")), month(last), F.expr("interval 1 month"))))
    looked_up = captures.where("fetched_at is not null").distinct().select("page_id", "url", "fetched_at", month(F.col("fetched_at")).alias("month"), F.explode(keys_of(F.col("url"))).alias("k")).select("page_id", "url", "fetched_at", "month", "k.kind", "k.pattern")
    hits = looked_up.join(intervals, ["kind", "pattern", "month"]).where("fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)")
    named = hits.groupBy("page_id", "url", "fetched_at").agg(F.sort_array(F.collect_set("list")).alias("found"))
    c, n = captures.alias("c"), named.alias("n")
    same = F.col("c.page_id").eqNullSafe(F.col("n.page_id")) & F.col("c.url").eqNullSafe(F.col("n.url")) & F.col("c.fetched_at").eqNullSafe(F.col("n.fetched_at"))
    found = F.coalesce(F.col("found"), F.array().cast("array<string>"))
    let = F.arrays_overlap(found, F.array(*map(F.lit, allow))) if allow else F.lit(False)
    return c.join(n, same, "left").select("c.page_id", "c.url", "c.fetched_at", F.array_join(found, ",").alias("lists"), F.size(found).cast("long").alias("n_lists"), F.when(let, "allow").when(F.size(found) > 0, "block").otherwise("keep").alias("decision"))


def _number(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 6), 16, 10).cast("long")


def derived_captures(pages: DataFrame) -> DataFrame:
    """The pages as captures, each fetched in some hour of 2024 that its id gives."""
    return pages.select("page_id", "url", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("page_id") * 7919 % 8760).cast("int"))).alias("fetched_at"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for hosts, parent domains and first path segments that occur in the pages, as their digests give them."""
    host = host_of(F.col("url"))
    names = pages.select(host.alias("h"), F.regexp_extract(path_of(F.col("url")), "^/([^/]+)", 1).alias("p")).where("h is not null").distinct()
    domain = F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1)
    keys = names.select(F.explode(F.array(F.struct(F.lit("host").alias("kind"), F.col("h").alias("pattern")), F.struct(F.lit("domain").alias("kind"), domain.alias("pattern")), F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", "h", "p").alias("pattern")))).alias("k")).select("k.*").where("pattern <> '' and pattern not like '%/'").distinct()
    listed = keys.withColumn("list", F.explode(F.array(*map(F.lit, ("malware", "spam", "trusted")))))
    n = lambda what: _number(F.col("list"), F.col("kind"), F.col("pattern"), F.lit(what))
    listed = listed.where(n("in") % F.when(F.col("kind") == "domain", 2).otherwise(5) == 0)
    day = lambda d: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=d.cast("int"))
    a, b, c = n("a") % 200, n("b") % 90 + 1, n("c") % 120 + 1
    dated = F.array(*(F.struct(F.lit(x).alias("action"), day(d).alias("at")) for x, d in (("add", a), ("remove", a + b), ("add", a + b + c))))
    return listed.withColumn("d", F.explode(dated)).select("list", "kind", "pattern", "d.action", "d.at")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(derived_captures(pages), derived_entries(pages))


OP7_SQL = r"""
WITH c AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_hours((page_id * 7919 % 8760)::INT) AS fetched_at,
  nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?:[:/?#]|$)', 1)), '') AS h,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
k AS (SELECT DISTINCT unnest(['host', 'domain', 'prefix']) AS kind, unnest([h, regexp_extract(h, '([^.]+\.[^.]+)$', 1), h || '/' || regexp_extract(path, '^/([^/]+)', 1)]) AS pattern FROM c WHERE h IS NOT NULL),
l AS (SELECT list, kind, pattern FROM k, (VALUES ('malware'), ('spam'), ('trusted')) v(list) WHERE pattern <> '' AND pattern NOT LIKE '%/'),
n AS (SELECT *, ('0x' || substr(md5(concat_ws('|', list, kind, pattern, 'in')), 1, 6))::BIGINT AS i, ('0x' || substr(md5(concat_ws('|', list, kind, pattern, 'a')), 1, 6))::BIGINT % 200 AS a, ('0x' || substr(md5(concat_ws('|', list, kind, pattern, 'b')), 1, 6))::BIGINT % 90 + 1 AS b, ('0x' || substr(md5(concat_ws('|', list, kind, pattern, 'c')), 1, 6))::BIGINT % 120 + 1 AS c FROM l),
v AS (SELECT list, kind, pattern, TIMESTAMP '2024-01-01' + to_days(a::INT) AS s, TIMESTAMP '2024-01-01' + to_days((a + b)::INT) AS e, TIMESTAMP '2024-01-01' + to_days((a + b + c)::INT) AS s2 FROM n WHERE i % (CASE WHEN kind = 'domain' THEN 2 ELSE 5 END) = 0),
m AS (SELECT DISTINCT c.page_id, c.url, v.list FROM c JOIN v ON ((kind = 'host' AND pattern = h) OR (kind = 'domain' AND (pattern = h OR ends_with(h, '.' || pattern))) OR (kind = 'prefix' AND (pattern = h || path OR starts_with(h || path, pattern || '/')))) AND ((fetched_at >= s AND fetched_at < e) OR fetched_at >= s2)),
g AS (SELECT page_id, url, string_agg(list, ',' ORDER BY list) AS lists, count(*) AS n, bool_or(list = 'trusted') AS ok FROM m GROUP BY 1, 2)
SELECT c.page_id, c.url, c.fetched_at, coalesce(lists, '') AS lists, coalesce(n, 0) AS n_lists, CASE WHEN ok THEN 'allow' WHEN n > 0 THEN 'block' ELSE 'keep' END AS decision FROM c LEFT JOIN g USING (page_id, url)
"""
