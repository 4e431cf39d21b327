"""Agenda pages to items: the parser only lists what stands on a page, layouts are rules over those rows.

A page becomes rows in document order: one for each element that opens, and
one for each run of text, with the path of open elements as 'tag.class#id'
steps. A layout says by patterns on paths and links where an item begins and
what its parts are; items are then runs between beginnings, found by a running
count, and their parts grouped aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moothall.sources.pages import MOST_ROWS, arrow_schema, as_batch

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_KEPT = ("id", "data-itemid", "data-mig", "name", "onclick")


class _Nodes(HTMLParser):
    """Collects (kind, path, text, url, key) rows."""

    def __init__(self, base: str) -> None:
        super().__init__()
        self.base, self.rows, self.open, self.links = base, [], [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        step = tag + "".join(f".{c}" for c in (a.get("class") or "").split()) + (f"#{a['id']}" if a.get("id") else "")
        url = urljoin(self.base, a["href"]) if a.get("href") else None
        key = next((a[k] for k in ("data-itemid", "onclick", "name", "id") if a.get(k)), None)
        if tag not in _VOID:
            self.open.append((tag, step, url))
        self.rows.append(("open", self.path() + (f"/{step}" if tag in _VOID else ""), None, url, key))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open):
            while self.open and self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and not any(t in ("script", "style") for t, _, _ in self.open):
            self.rows.append(("text", self.path(), text, next((u for _, _, u in reversed(self.open) if u), None), None))

    def path(self) -> str:
        return "/".join(s for _, s, _ in self.open)


def nodes_of(html: str | None, base: str | None) -> list[tuple]:
    p = _Nodes(base or "")
    p.feed(html or "")
    p.close()
    return p.rows


def page_nodes(pages: DataFrame) -> DataFrame:
    """Rows (page_id, nth, kind, path, text, url, key) of pages (page_id, url, html); null and empty pages have none."""

    fields = "page_id long, nth int, kind string, path string, text string, url string, key string"
    schema = arrow_schema(fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for i, url, html in zip(*part.columns, strict=True):
                out += ((i.as_py(), n, *row) for n, row in enumerate(nodes_of(html.as_py(), url.as_py())))
                if len(out) >= MOST_ROWS:
                    yield as_batch(out, schema)
                    out = []
            yield as_batch(out, schema)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, fields)


@dataclass(frozen=True)
class Layout:
    """Patterns on the path of the element or text: an item's beginning (and its link or key), its title, number and section, and the links that are attachments."""

    item: str
    title: str
    item_url: str = ""
    key: str = ""
    number: str = "$^"
    section: str = "$^"
    attachment: str = r"(?i)\.pdf|attachment|document|view\.ashx|metaviewer"


#: Where each kind of page has its items.
LAYOUTS = {
    "municode": Layout(r"\.agenda-items[^/]*/li[^/]*$", r"\.agenda-items[^/]*/li(?!.*agenda_item_attachments)", number=r"li[^/]*/.*\.number", section=r"h2\.section-header", attachment="."),
    "novus": Layout(r"/?a[^/]*$", r"/?a[^/]*$", item_url=r"(?i)CoverSheet\.aspx\?ItemID=(\d+)", attachment=r"(?i)\.pdf$|DisplayAgendaPDF"),
    "legistar_grid": Layout(r"tr\.rg(?:Alt)?Row[^/]*$", r"tr\.rg(?:Alt)?Row.*td", key="row", attachment=r"(?i)LegislationDetail\.aspx"),
    "granicus_accessible": Layout(r"\.accessible-item(?:[.#][^/]*)?$", r"\.accessible-item-text", key=r"loadAgendaItem\((\d+)\)", attachment=r"(?i)metaviewer|\.pdf"),
    "granicus_listing": Layout(r"tr\.(?:odd|even|listingRow)[^/]*$", r"td\.listedItem|td\.listItem", section=r"\.CollapsiblePanelTab", attachment=r"(?i)AgendaViewer|\.pdf"),
    "primegov": Layout(r"div\.(?:meeting-item)(?:[.#][^/]*)?$", r"\.agenda-item", number=r"\.number-cell", section=r"\.section-title"),
    "primegov_plain": Layout(r"div\.agenda-item(?:[.#][^/]*)?$", r"div\.agenda-item", section=r"\.section-title"),
    "civicplus": Layout(r"div\.item(?:[.#][^/]*)?$", r"div\.item", number=r"\.number", section=r"\.level1"),
}


def agenda_items(nodes: DataFrame, layout: Layout) -> DataFrame:
    """Rows (page_id, sequence, vendor_item_id, number, section, title, attachments) of page_nodes' rows; items without a title are left out."""
    order = Window.partitionBy("page_id").orderBy("nth")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    begins = (F.col("kind") == "open") & F.col("path").rlike(layout.item)
    if layout.item_url:
        begins &= F.coalesce(F.col("url"), F.lit("")).rlike(layout.item_url)
    is_text = F.col("kind") == "text"
    on = lambda p: is_text & F.col("path").rlike(p)
    marked = nodes.withColumn("item", F.sum(begins.cast("int")).over(so_far)).withColumn("section", F.last(F.when(on(layout.section), F.col("text")), ignorenulls=True).over(so_far))
    inside = marked.where("item > 0")
    if layout.item_url:
        vendor = F.first(F.nullif(F.regexp_extract(F.coalesce("url", F.lit("")), layout.item_url, 1), F.lit("")), ignorenulls=True)
    else:
        pattern = layout.key if "(" in layout.key else "^(.+)$"
        vendor = F.min_by(F.nullif(F.regexp_extract("key", pattern, 1), F.lit("")), F.when(F.col("key").rlike(pattern), F.col("nth")))
    linked = is_text & F.coalesce(F.col("url"), F.lit("")).rlike(layout.attachment)
    words = on(layout.title) & ~on(layout.number) & ~on(layout.section) & (~linked if not layout.item_url and layout.attachment != r"(?i)LegislationDetail\.aspx" else F.lit(True))

    def listed(when: Column, value: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("nth", value.alias("v"))))), lambda x: x["v"])

    first = F.first("section", ignorenulls=True)
    out = inside.groupBy("page_id", "item").agg(
        vendor.alias("vendor_item_id"), F.array_join(listed(on(layout.number), F.col("text")), " ").alias("number"), first.alias("section"),
        F.array_join(listed(words, F.col("text")), " ").alias("title"), F.array_distinct(listed(linked, F.struct(F.col("text").alias("name"), "url"))).alias("attachments"),
    )
    return out.where("title <> ''").select("page_id", F.col("item").alias("sequence"), "vendor_item_id", F.nullif("number", F.lit("")).alias("number"), "section", "title", "attachments")


def lines_to_items(lines: DataFrame, number: str = r"^\s*(\d{1,3}\.|[A-Z]\.|\d{1,3}\.[a-z]|\(\d{1,3}\)|\d{4}-\d{1,4})\s+(.*)$", section: str = r"^[A-Z][A-Z &/-]{4,}$", most_title: int = 3) -> DataFrame:
    """Rows (doc_id, sequence, number, section, title, body) of text lines (doc_id, line, text).

    A line that begins with a number begins an item; up to most_title lines in
    capitals right after it go on its title; the rest up to the next item or
    section is its body.
    """
    w = Window.partitionBy("doc_id").orderBy("line")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    is_item = F.col("text").rlike(number)
    is_section = ~is_item & F.trim("text").rlike(section)
    upper = F.col("text").rlike("[A-Z]") & ~F.col("text").rlike("[a-z]") & ~is_item & ~F.trim("text").rlike(r":$")
    first = F.regexp_extract("text", number, 2)
    marked = lines.withColumn("sequence", F.sum(is_item.cast("int")).over(so_far)).withColumn("start", F.last(F.when(is_item, F.col("line")), ignorenulls=True).over(so_far)).withColumn("section_text", F.last(F.when(is_section & ~upper.isNull() & F.col("text").rlike(section), F.trim("text")), ignorenulls=True).over(so_far))
    run = Window.partitionBy("doc_id", "sequence").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.where("sequence > 0").withColumn("plain", F.sum((~upper & ~is_item).cast("int")).over(run))
    in_title = is_item | ((F.col("plain") == 0) & (F.col("line") <= F.col("start") + most_title) & (first != F.col("text")) & ~is_section)
    ended = F.sum(is_section.cast("int")).over(run)
    marked = marked.withColumn("in_title", in_title).withColumn("ended", ended)
    joined = lambda when, value, by: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("line", value.alias("v"))))), lambda x: x["v"]), by)
    return marked.groupBy("doc_id", "sequence").agg(
        F.min_by(F.regexp_extract("text", number, 1), F.when(is_item, F.col("line"))).alias("number"), F.min_by("section_text", "line").alias("section"),
        F.rtrim(F.regexp_replace(joined(F.col("in_title"), F.when(is_item, F.trim(first)).otherwise(F.trim("text")), " "), ":+$", "")).alias("title"), joined(~F.col("in_title") & (F.col("ended") == 0), F.col("text"), "\n").alias("body"),
    )


def toc_shapes(toc: DataFrame, by: str = "doc") -> DataFrame:
    """(doc, shape) of the outline entries (doc, nth, level, title, page): flat, hierarchical, deep_hierarchical or document_bundle.

    The agenda's own pages are the commonest pages of the first level that
    together hold 7/10 of its entries (ties: the page named first, then the smaller); links to
    the page's top and bottom are no entries of it. Entries without a level or
    page are left out, a null title is like any other.
    """
    e = toc.where(F.col("level").isNotNull() & F.col("page").isNotNull())
    title = F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"^\s+|\s+$", "")
    top = (F.col("level") == 1) & ~title.isin("top", "bottom")
    counts = e.groupBy(by).agg(
        F.count_if(top).alias("n1"), F.count_if((F.col("level") == 2) & (F.col("page") <= 0)).alias("virtual"), F.count_if(F.col("level") == 3).alias("n3"), F.count_if(F.col("level") == 4).alias("n4"), F.max(F.when(F.col("level") == 2, F.col("page"))).alias("deepest"),
    )
    pages = e.where(top).groupBy(by, "page").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    w = Window.partitionBy(by)
    before = F.coalesce(F.sum("n").over(w.orderBy(F.desc("n"), "first", "page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pages.withColumn("before", before).withColumn("total", F.sum("n").over(w))
    own = ranked.groupBy(by).agg(F.max(F.when(F.col("before") < F.col("total") * 0.7, F.col("page"))).alias("last"), F.count("*").alias("distinct"))
    shape = (
        F.when(F.col("n1") == 0, "flat").when((F.col("n1") <= 3) & (F.col("virtual") > 0) & (F.col("n3") >= 2), "document_bundle").when((F.col("n1") <= 2) & (F.col("n3") >= 3) & (F.col("n4") >= 1), "deep_hierarchical")
        .when((F.col("deepest") > F.col("last") + 1) & (F.col("distinct") <= F.greatest(F.lit(5.0), F.col("n1") * 0.3)), "hierarchical").otherwise("flat")
    )
    return counts.join(own, by, "left").select(by, shape.alias("shape"))
