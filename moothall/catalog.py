"""The civic entities as projections of the tables, in Spark and, for the oracles, in DuckDB.

The operators take DataFrames with the entities' columns, wherever those come
from; these projections bind them to the tables that tests and benchmarks have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of the queries about meetings and votes, and of those about events.
AS_OF = "2001-06-01"
EVENTS_AS_OF = "2024-01-25"


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp_ntz")


class Catalog:
    """Tables of one folder, and the entities made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def jurisdictions(self) -> DataFrame:
        """banana, name, state, vendor, kind, county_banana, population, has_geom."""
        n, r = self.table("nation"), self.table("region")
        both = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
        state, key = F.substring("r_name", 1, 2), F.col("n_nationkey")
        return both.select(
            F.concat(F.lower(F.regexp_replace("n_name", "[^A-Za-z0-9]", "")), state).alias("banana"), F.col("n_name").alias("name"), state.alias("state"), key.alias("city_key"),
            F.element_at(F.array(*map(F.lit, ("legistar", "granicus", "primegov"))), (key % 3 + 1).cast("int")).alias("vendor"), F.when(key % 5 == 0, "county").otherwise("city").alias("kind"),
            F.when(key % 5 != 0, F.concat(F.lit("nation"), (key - key % 5).cast("string"), state)).alias("county_banana"), (key * 1000 + 500).cast("long").alias("population"), (key % 4 != 3).alias("has_geom"),
        )

    def meetings(self) -> DataFrame:
        """id, city_key, title, date, status, summary, committee; a third has no summary, every eleventh no date."""
        o, c = self.table("orders"), self.table("customer").select("c_custkey", "c_nationkey")
        key = F.col("o_orderkey")
        return o.join(c, o.o_custkey == c.c_custkey).select(
            key.alias("id"), F.col("c_nationkey").alias("city_key"), F.col("o_orderpriority").alias("title"), F.when(key % 11 != 0, F.col("o_orderdate")).alias("date"),
            F.when(F.col("o_orderstatus") == "F", "cancelled").when(F.col("o_orderstatus") == "P", "postponed").alias("status"), F.when(key % 3 != 0, F.concat(F.lit("Summary of "), F.col("o_orderpriority"))).alias("summary"),
            F.col("o_custkey").alias("committee_key"), F.col("o_totalprice").alias("size"),
        )

    def items(self) -> DataFrame:
        """item_id, meeting_id, sequence, matter_id, date, summary, agenda_number, n_attachments."""
        key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        return self.table("lineitem").select(
            key.alias("item_id"), F.col("l_orderkey").alias("meeting_id"), F.col("l_linenumber").alias("sequence"), F.when(F.col("l_quantity") > 2, F.col("l_partkey")).alias("matter_id"), F.col("l_suppkey").alias("sponsor_id"),
            F.col("l_shipdate").alias("date"), F.when(F.col("l_returnflag") != "N", F.concat(F.lit("Summary "), F.col("l_returnflag"))).alias("summary"), F.when(F.col("l_linestatus") == "O", F.col("l_linenumber").cast("string")).alias("agenda_number"),
            (F.col("l_quantity") % 4).cast("int").alias("n_attachments"),
        )

    def matters(self) -> DataFrame:
        """id, title, kind, file, committee, summary."""
        return self.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("kind"), F.concat_ws("-", "p_brand", "p_size").alias("file"), F.col("p_brand").alias("committee"), F.when(F.col("p_size") > 10, F.concat(F.lit("About "), F.col("p_name"))).alias("summary"))

    def votes(self) -> DataFrame:
        """member_id, matter_id, meeting_id, vote, vote_date, sequence; every seventh without a date."""
        vote = F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "N", "nay").otherwise("abstain")
        return self.table("lineitem").select(F.col("l_suppkey").alias("member_id"), F.col("l_partkey").alias("matter_id"), F.col("l_orderkey").alias("meeting_id"), vote.alias("vote"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_shipdate")).alias("vote_date"), F.col("l_linenumber").alias("sequence"))

    def memberships(self) -> DataFrame:
        """committee, member_id, joined_at, left_at: from the first to the last vote of a member in a committee; the late ones are open."""
        i, p = self.table("lineitem"), self.table("part").select("p_partkey", "p_brand")
        left = F.max("l_shipdate")
        return i.join(p, i.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("committee"), F.col("l_suppkey").alias("member_id")).agg(F.min("l_shipdate").alias("joined_at"), F.when(left < F.lit("2001-03-01").cast("timestamp_ntz"), left).alias("left_at"))

    def events(self) -> DataFrame:
        """event_id, visitor, event, ts, k, value."""
        return self.table("events").select("event_id", F.col("user_id").alias("visitor"), F.col("event_type").alias("event"), "ts", F.get_json_object("props", "$.k").cast("long").alias("k"), "value")

    def ratings(self) -> DataFrame:
        """entity, user_id, rating 1 to 5."""
        return self.events().select((F.col("k") % 20).alias("entity"), F.col("visitor").alias("user_id"), (F.floor("value") % 5 + 1).cast("int").alias("rating"), "ts")

    def opinions(self) -> DataFrame:
        """comment_id, user_id, vote -1, 0 or 1, ts: the event log of a deliberation."""
        return self.events().select((F.col("k") % 8).alias("comment_id"), F.col("visitor").alias("user_id"), F.when(F.col("event").isin("click", "purchase"), 1).when(F.col("event") == "error", -1).otherwise(0).alias("vote"), "ts", "event_id")

    def texts(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("city"))


#: The same as DuckDB common table expressions, for oracles.
CTE = {
    "jurisdictions": "SELECT lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) || substr(r_name, 1, 2) AS banana, n_name AS name, substr(r_name, 1, 2) AS state, n_nationkey AS city_key, ['legistar', 'granicus', 'primegov'][n_nationkey % 3 + 1] AS vendor, CASE WHEN n_nationkey % 5 = 0 THEN 'county' ELSE 'city' END AS kind, CASE WHEN n_nationkey % 5 <> 0 THEN 'nation' || (n_nationkey - n_nationkey % 5) || substr(r_name, 1, 2) END AS county_banana, (n_nationkey * 1000 + 500)::BIGINT AS population, n_nationkey % 4 <> 3 AS has_geom FROM nation JOIN region ON n_regionkey = r_regionkey",
    "meetings": "SELECT o_orderkey AS id, c_nationkey AS city_key, o_orderpriority AS title, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS date, CASE o_orderstatus WHEN 'F' THEN 'cancelled' WHEN 'P' THEN 'postponed' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN 'Summary of ' || o_orderpriority END AS summary, o_custkey AS committee_key, o_totalprice AS size FROM orders JOIN customer ON o_custkey = c_custkey",
    "items": "SELECT l_orderkey * 10 + l_linenumber AS item_id, l_orderkey AS meeting_id, l_linenumber AS sequence, CASE WHEN l_quantity > 2 THEN l_partkey END AS matter_id, l_suppkey AS sponsor_id, l_shipdate AS date, CASE WHEN l_returnflag <> 'N' THEN 'Summary ' || l_returnflag END AS summary, CASE WHEN l_linestatus = 'O' THEN l_linenumber::VARCHAR END AS agenda_number, (l_quantity % 4)::INT AS n_attachments FROM lineitem",
    "matters": "SELECT p_partkey AS id, p_name AS title, p_type AS kind, p_brand || '-' || p_size AS file, p_brand AS committee, CASE WHEN p_size > 10 THEN 'About ' || p_name END AS summary FROM part",
    "votes": "SELECT l_suppkey AS member_id, l_partkey AS matter_id, l_orderkey AS meeting_id, CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'nay' ELSE 'abstain' END AS vote, CASE WHEN l_orderkey % 7 <> 0 THEN l_shipdate END AS vote_date, l_linenumber AS sequence FROM lineitem",
    "memberships": "SELECT p_brand AS committee, l_suppkey AS member_id, min(l_shipdate) AS joined_at, CASE WHEN max(l_shipdate) < TIMESTAMP '2001-03-01' THEN max(l_shipdate) END AS left_at FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "ev": "SELECT event_id, user_id AS visitor, event_type AS event, ts, json_extract_string(props, '$.k')::BIGINT AS k, value FROM events",
    "ratings": "SELECT json_extract_string(props, '$.k')::BIGINT % 20 AS entity, user_id, (floor(value)::BIGINT % 5 + 1)::INT AS rating, ts FROM events",
    "opinions": "SELECT json_extract_string(props, '$.k')::BIGINT % 8 AS comment_id, user_id, CASE WHEN event_type IN ('click', 'purchase') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS vote, ts, event_id FROM events",
    "texts": "SELECT doc_id AS id, text, lang, source AS city FROM documents",
}


def oracle(sql: str) -> str:
    """The DuckDB text with the entities that it names put before it."""
    import re

    used = [f"{k} AS ({v})" for k, v in CTE.items() if re.search(rf"\b{k}\b", sql)]
    if not used:
        return sql
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {own[1] or '' if own else ''}" + ", ".join(used) + (", " + sql[own.end() :] if own else " " + sql)


Bound = Callable[[Catalog], DataFrame]
