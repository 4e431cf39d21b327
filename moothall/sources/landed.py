"""Landed vendor responses: JSON files to checked meetings, rejected rows and a status for each vendor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a meeting as vendors deliver it; `_corrupt` takes what is no JSON object of this shape.
SCHEMA = """vendor string, vendor_id string, title string, start string, location string, agenda_url string, packet_url string, meeting_status string, vendor_body_id string,
items array<struct<vendor_item_id:string,title:string,sequence:string,matter_id:string,matter_file:string,matter_type:string,agenda_number:string,sponsors:array<string>,attachments:array<struct<name:string,url:string,type:string>>>>, _corrupt string"""
#: Vendors whose landed files are read; others are rejected by name.
VENDORS = (
    "granicus", "iqm2", "legistar", "novusagenda", "onbase", "primegov", "civicclerk", "civicplus", "civicengage", "civicweb", "escribe", "municode", "proudcity", "wp_events", "berkeley", "chicago", "menlopark", "ross", "visioninternet", "agendaonline", "destiny", "boardbook",
)


@dataclass
class Landed:
    """Meetings that keep the contract, rows that don't with their problems, and counts by vendor."""

    meetings: DataFrame
    rejected: DataFrame
    status: DataFrame


def _empty(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def problems(df: DataFrame) -> Column:
    """The names of the rules that a row breaks."""
    bad_item = F.exists("items", lambda i: _empty(i["title"]) | i["sequence"].try_cast("int").isNull())
    bad_link = F.exists("items", lambda i: F.exists(i["attachments"], lambda a: _empty(a["url"])))
    rules = {
        "json": F.col("_corrupt").isNotNull(), "vendor": ~F.coalesce(F.col("vendor"), F.lit("")).isin(*VENDORS), "vendor_id": _empty(F.col("vendor_id")), "title": _empty(F.col("title")),
        "start": F.try_to_timestamp("start").isNull(), "item": F.coalesce(bad_item, F.lit(False)), "attachment": F.coalesce(bad_link, F.lit(False)),
    }
    return F.filter(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())), lambda x: x.isNotNull())


def read_landed(spark: SparkSession, path: str) -> Landed:
    """Read JSON lines; nothing is dropped silently: a row is a meeting or is rejected with its problems.

    A vendor whose rows are all rejected has failed, one without rows is
    absent from the status, so that an empty calendar and a failed fetch can
    be told apart by who landed a file.
    """
    rows = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    checked = rows.withColumn("problems", problems(rows))
    good = checked.where(F.size("problems") == 0).drop("_corrupt", "problems").withColumn("start", F.col("start").try_cast("timestamp_ntz"))
    status = checked.groupBy("vendor").agg(F.count("*").alias("rows"), F.count_if(F.size("problems") == 0).alias("meetings")).withColumn("success", F.col("meetings") > 0)
    return Landed(good, checked.where(F.size("problems") > 0), status)


def in_window(meetings: DataFrame, as_of: Column, back: int = 14, forward: int = 14) -> DataFrame:
    """Meetings from midnight so many days back up to midnight so many days ahead, both included."""
    day = F.date_trunc("day", as_of).cast("timestamp_ntz")
    return meetings.where(F.col("start").between(day - F.make_dt_interval(days=F.lit(back)), day + F.make_dt_interval(days=F.lit(forward))))
