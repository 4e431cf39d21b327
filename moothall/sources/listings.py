"""Listings of meetings: one table row a meeting, with its title, date and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moothall.functions.texts import parse_date
from moothall.sources.structure import around, by_page, each, first, last, let, of_class, own_parts, text_of


def listing_date(text: Column) -> Column:
    """The moment that a listing shows: a hidden epoch second before it, a weekday, and dashes or "at" before the clock are skipped; the epoch second counts only where nothing else can be read."""

    def read(raw: Column) -> Column:
        stamp = F.nullif(F.regexp_extract(raw, r"^\d{10}", 0), F.lit("")).cast("long")
        plain = F.regexp_replace(raw, r"^\d{10}\s*", "")
        plain = F.regexp_replace(plain, r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\b,?\s*", "")
        plain = F.regexp_replace(F.regexp_replace(plain, r"\s*/\s*", "/"), r"(?i)\s+(?:-|–|at)\s+", " ")
        more = lambda p: (F.try_to_timestamp(p, F.lit(f)).cast("timestamp_ntz") for f in ("MMM d, yyyy h:mm a", "M/d/yy h:mm a", "M/d/yy"))
        # A bare number isn't a date, though a cast would read four digits as a year; nor is what has no digit.
        return F.coalesce(let(plain, lambda p: F.when(p.rlike(r"\D") & p.rlike(r"\d"), F.coalesce(parse_date(p), *more(p)))), F.timestamp_seconds(stamp).cast("timestamp_ntz"))

    return let(F.trim(F.regexp_replace(text, r"[\x{a0}\s]+", " ")), read)


def listed_meetings(tree: DataFrame) -> DataFrame:
    """(page_id, open, event_id, title, start, agenda_url, packet_url), one for each meeting that a page lists, by a page's nested sets.

    A meeting's row has two cells or more of the listing's classes, the title
    first and the date second, or the other way round; a row without a title
    of its own has its panel's. It needs the link of an agenda viewer (of an
    anchor, else of a choice) or of a PDF, and a number in the former or a
    UUID in the latter, whose first twelve digits count. Of rows of a page
    with one number the first stays. A date that can't be read is null.
    """
    pages, n = by_page(tree), F.col("nodes")
    classed = lambda x: (x["tag"] == "tr") & (of_class(x, "odd") | of_class(x, "even") | of_class(x, "listingRow"))
    listing = lambda x: (x["tag"] == "table") & of_class(x, "listingTable")
    pages = pages.withColumn("plain", ~F.exists(n, classed))
    row = lambda x: F.when(F.col("plain"), (x["tag"] == "tr") & around(n, x, listing).isNotNull()).otherwise(classed(x))
    cell = lambda y: (y["tag"] == "td") & (of_class(y, "listItem") | of_class(y, "listedItem"))
    link = lambda y: y["tag"].isin("a", "option") & y["url"].isNotNull()
    content = lambda y: (y["tag"] == "div") & of_class(y, "CollapsiblePanelContent")
    pages = pages.withColumn("rows", F.filter(n, row)).withColumn("at", F.col("rows")["at"]).withColumn("tabs", F.filter(n, lambda y: (y["tag"] == "div") & of_class(y, "CollapsiblePanelTab")))
    within_row = lambda x, which: own_parts(n, x, lambda z: (z["tag"] == "tr") & F.array_contains("at", z["at"]), which)
    panel = lambda x: let(around(n, x, content), lambda c: let(last(F.filter("tabs", lambda t: (t["up"] == c["up"]) & (t["at"] < c["at"]))), lambda t: text_of(n, t)))

    def read(x: Column) -> Column:
        def of(v: Column) -> Column:
            viewer = lambda y: y["url"].contains("AgendaViewer")
            url = lambda which: first(F.filter(v["links"], which))["url"]
            agenda = F.coalesce(url(lambda y: viewer(y) & (y["tag"] == "a")), url(lambda y: viewer(y) & (y["tag"] == "option")))
            packet = url(lambda y: (y["tag"] == "a") & F.lower(y["url"]).contains(".pdf"))
            kept = (F.size(v["cells"]) >= 2) & (~F.col("plain") | F.exists(v["cells"], lambda y: of_class(y, "listedItem")))
            return F.when(kept, F.struct(x["at"].alias("at"), x["open"].alias("open"), *(text_of(n, F.get(v["cells"], F.lit(k))).alias(f"t{k}") for k in range(2)), agenda.alias("agenda_url"), packet.alias("packet_url")))

        return let(F.struct(within_row(x, cell).alias("cells"), within_row(x, link).alias("links")), of)

    def numbered(m: Column) -> Column:
        number = F.nullif(F.regexp_extract(F.coalesce(m["agenda_url"], m["packet_url"]), r"(?:event_id|clip_id)=(\d+)", 1), F.lit(""))
        by_file = F.nullif(F.left(F.replace(F.regexp_extract(m["packet_url"], "[a-f0-9-]{36}", 0), F.lit("-"), F.lit("")), F.lit(12)), F.lit(""))
        return F.struct(F.coalesce(number, by_file).alias("event_id"), m.alias("m"))

    found = F.filter(F.transform(F.filter(F.transform("rows", read), lambda m: m.isNotNull()), numbered), lambda e: e["event_id"].isNotNull())
    once = let(found, lambda every: let(every["event_id"], lambda ids: F.filter(every, lambda e, i: F.array_position(ids, e["event_id"]) == i + 1)))
    m = each(pages, F.transform(once, lambda e: F.struct(e["event_id"].alias("event_id"), *(e["m"][c].alias(c) for c in ("open", "t0", "t1", "agenda_url", "packet_url")), panel(F.get(n, e["m"]["at"] - 1)).alias("panel"))))
    # Each cell is read once, the title's only where the other isn't a date.
    dates = lambda plain: let(F.when(plain.isNull(), listing_date(F.col("t0"))), lambda swapped: F.struct(plain.alias("plain"), swapped.alias("swapped")))
    m = m.withColumn("d", let(listing_date(F.col("t1")), dates))
    own = F.when(F.col("d.swapped").isNotNull(), F.when(F.lower("t1") != "agenda", F.col("t1"))).otherwise(F.col("t0"))
    return m.select("page_id", "open", "event_id", F.coalesce(own, "panel").alias("title"), F.coalesce("d.plain", "d.swapped").alias("start"), "agenda_url", "packet_url")
