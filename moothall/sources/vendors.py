"""Agenda pages of four vendors as lists of nested nodes: what stands in an item, which list it is in, which heading is above it."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moothall.sources.columns import Nodes, first_of, layout, lists, places, spread
from moothall.sources.structure import around, by_page, each, first, let, of_class, own_parts, rows_in, text_of, within

#: Marks of items, titles that say nothing, and entries that are no items.
_LOADS = r"loadAgendaItem\((\d+)"
_NUMBER = r"^(?:\d+\.?[A-Za-z]?\.?|[a-z]\.)$"
_NO_ITEMS = ("call to order", "roll call", "adjournment")
_GENERIC = r"(?i)^(?:Consent|Resolution|Agreement|Purchase|Public Hearing|Presentation|Item)\s+[A-Z0-9]+$"
_PROCEDURAL = ("call to order", "invocation", "pledge of allegiance", "roll call", "adjournment", "adjourn", "recess", "reconvene")


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _once(items: Column) -> Column:
    """The first of a page's items with the same vendor_item_id."""
    return let(items, lambda every: F.filter(every, lambda x, i: F.array_position(every["vendor_item_id"], x["vendor_item_id"]) == i + 1))


def agendaonline_items(tree: DataFrame) -> DataFrame:
    """(page_id, sequence, vendor_item_id, number, title, recommendation) of pages in one of three forms.

    Entries of class accessible-item whose link loads an item; else rows of
    tables with collapsed borders, where the cell after the first that looks
    like a number names the item by an anchor or a loading link; else all
    loading links. A page's form is the first of these that finds an item, an
    item named twice counts once, items without a title are left out.
    """
    pages, n = by_page(tree), F.col("nodes")
    loads = lambda x: F.regexp_extract(x, _LOADS, 1)
    loader = lambda x: (x["tag"] == "a") & x["key"].rlike(_LOADS)
    box = lambda x: (x["tag"] == "div") & of_class(x, "accessible-item")
    numbered = r"^(\d+\.?[A-Z]?\.?)\s+(.+)$"
    none = F.lit(None).cast("string")

    def item(at: Column, key: Column, number: Column, title: Column, wish: Column = none) -> Column:
        return F.struct(at.alias("at"), key.alias("vendor_item_id"), number.alias("number"), title.alias("title"), wish.alias("recommendation"))

    def entry(a: Column) -> Column:
        inner = first(own_parts(n, a, loader, lambda y: (y["tag"] == "span") & of_class(y, "accessible-item-text")))
        two = F.struct(text_of(n, a).alias("text"), let(inner, lambda y: text_of(n, y)).alias("inner"))

        def read(t: Column) -> Column:
            split = t["text"].rlike(numbered)
            title = F.when(t["text"].isNull(), none).when(_filled(t["inner"]), t["inner"]).when(split, F.regexp_extract(t["text"], numbered, 2)).otherwise(t["text"])
            number = F.when(_filled(t["inner"]), F.trim(F.replace(t["text"], t["inner"], F.lit("")))).when(split, F.regexp_extract(t["text"], numbered, 1)).otherwise("")
            return item(a["at"], loads(a["key"]), number, title)

        return let(two, read)

    entries = F.filter(F.transform(F.filter(n, box), lambda x: first(own_parts(n, x, box, loader))), lambda a: a.isNotNull())
    listed = F.filter(_once(F.transform(F.array_sort(entries), entry)), lambda x: _filled(x["title"]))

    tables = F.filter(n, lambda x: (x["tag"] == "table") & F.lower(x["style"]).contains("border-collapse"))
    td = lambda x: (x["tag"] == "td") & F.array_contains(F.col("tables"), x["tab"])
    bold = lambda x: x["tag"].isin("b", "strong") | ((x["tag"] == "span") & F.lower(x["style"]).rlike(r"font-weight:\s*bold"))
    marked = lambda c: F.coalesce(let(first(own_parts(n, c, td, bold)), lambda y: text_of(n, y)), text_of(n, c))
    beside = lambda row: F.filter(F.transform(row, lambda c, i: let(marked(c), lambda t: F.when(t.rlike(_NUMBER), F.struct(t.alias("number"), F.get(row, i + 1).alias("cell"))))), lambda x: x.isNotNull())
    rows = F.flatten(F.transform(F.filter(n, lambda x: (x["tag"] == "table") & F.array_contains(F.col("tables"), x["open"])), lambda t: let(F.filter(within(n, t), lambda c: (c["tag"] == "td") & (c["tab"] == t["open"])), rows_in)))
    found = F.array_sort(F.transform(F.filter(F.transform(rows, lambda row: first(beside(row))), lambda x: x["cell"].isNotNull()), lambda x: F.struct(x["cell"]["at"].alias("at"), x["number"].alias("number"), x["cell"].alias("cell"))))
    body = lambda x: (x["tag"] == "td") & F.array_contains(F.col("bodies"), x["at"])
    part = lambda c, which: first(own_parts(n, c, body, which))

    def row_item(x: Column) -> Column:
        c = x["cell"]
        anchor = F.regexp_replace(part(c, lambda y: (y["tag"] == "a") & y["key"].isNotNull() & ~y["key"].rlike(_LOADS))["key"], "^[SI]", "")
        loading = loads(part(c, lambda y: (y["tag"] == "a") & y["url"].rlike(_LOADS))["url"])
        title = let(part(c, lambda y: (y["tag"] == "a") & y["url"].isNotNull()), lambda a: F.when(a.isNotNull(), text_of(n, a)).otherwise(text_of(n, c)))
        asked = part(c, lambda y: y["text"].rlike("(?i)Recommendation:"))
        wish = let(let(asked, lambda y: around(n, y, lambda z: z["tag"].isin("p", "td"))), lambda z: F.nullif(F.trim(F.regexp_extract(text_of(n, z), "(?s)Recommendation:(.*)$", 1)), F.lit("")))
        return item(x["at"], F.coalesce(F.nullif(anchor, F.lit("")), loading), x["number"], title, wish)

    by_row = _once(F.filter(F.transform(F.col("found"), row_item), lambda x: _filled(x["title"]) & x["vendor_item_id"].isNotNull()))
    plain = _once(F.transform(F.filter(n, lambda x: (x["tag"] == "a") & x["url"].rlike(_LOADS)), lambda a: item(a["at"], loads(a["url"]), F.lit(""), text_of(n, a))))
    plain = F.filter(plain, lambda x: _filled(x["title"]) & ~F.lower(x["title"]).isin(*_NO_ITEMS))
    pages = pages.withColumn("tables", tables["open"]).withColumn("found", found).withColumn("bodies", F.col("found")["at"]).withColumn("listed", listed).withColumn("rows", by_row)
    best = F.when(F.size("listed") > 0, F.col("listed")).when(F.size("rows") > 0, F.col("rows")).otherwise(plain)
    return each(pages, F.transform(best, lambda x, i: F.struct((i + 1).cast("long").alias("sequence"), x["vendor_item_id"].alias("vendor_item_id"), F.nullif(x["number"], F.lit("")).alias("number"), x["title"].alias("title"), x["recommendation"].alias("recommendation"))))


def municode_items(tree: DataFrame) -> DataFrame:
    """(page_id, sequence, number, section, title, attachments) of pages of agenda sections, each with one list of items.

    An item is an entry of a section's first list of class agenda-items, its
    number the num element in it, else its place on the page, counting empty
    entries, which are no items. Lists of class agenda_item_attachments
    between entries belong to the last item before them; links without a name
    are left out.
    """

    def read(n: Nodes) -> tuple[np.ndarray, dict[str, pa.Array]]:
        up, sections = n.up, n.where(lambda m: m.tag == "section" and m.has("agenda-section"))
        own = lambda elements, of, parts: np.append(parts, -1)[first_of(n.owner(parts, elements), of)]
        held = own(sections, sections, n.where(lambda m: m.tag in ("ul", "ol") and m.has("agenda-items")))
        head = n.text(own(sections, sections, n.where(lambda m: m.tag == "h2" and m.has("section-header"))))
        order = np.argsort(held, kind="stable")
        order = order[held[order] >= 0]
        listed = held[order]
        entries, papers = n.tagged("li"), n.where(lambda m: m.tag == "ul" and m.has("agenda_item_attachments"))
        entries, papers = (x[np.isin(up[x], listed)] for x in (entries, papers))
        title = pc.utf8_trim(pc.replace_substring_regex(n.text(entries), r"^\d+\.\s*", "", max_replacements=1), " ")
        full = np.flatnonzero(pc.fill_null(pc.not_equal(title, ""), False).to_numpy(zero_copy_only=False))
        items = entries[full]
        # Papers belong to the item of their list that began last before them.
        far = len(n) + 1
        by_list = np.argsort(up[items] * far + items)
        key = (up[items] * far + items)[by_list]
        k = np.searchsorted(key, up[papers] * far + papers) - 1
        of = np.append(by_list, -1)[k]
        of = np.where((k >= 0) & (up[items[of]] == up[papers]), of, -1) if len(items) else of
        offsets, at = spread(*n.inside(papers, n.links))
        owner = np.repeat(of, np.diff(offsets))
        links = n.named(n.links[at])
        named = np.flatnonzero((owner >= 0) & pc.struct_field(links, "name").is_valid().to_numpy(zero_copy_only=False))
        named = named[np.argsort(owner[named], kind="stable")]
        links = links.take(pa.array(named))
        return n.page[items], {
            "sequence": pa.array(n.nth(entries)[full]), "number": n.text(own(entries, items, n.tagged("num"))), "section": head.take(pa.array(order[np.searchsorted(listed, up[items])])), "title": title.take(pa.array(full)),
            "attachments": lists(np.searchsorted(owner[named], np.arange(len(items) + 1)), links),
        }

    items = layout(tree, read, "sequence long, number string, section string, title string, attachments array<struct<name:string,url:string>>")
    return items.withColumn("number", F.coalesce(F.regexp_replace("number", r"\.+$", ""), F.col("sequence").cast("string")))


def novus_items(tree: DataFrame) -> DataFrame:
    """(page_id, sequence, vendor_item_id, title) of pages whose items are links to cover sheets; a link without text has that of the table cell around it, if any, as title."""
    pages, n = by_page(tree), F.col("nodes")
    cover = r"(?i)CoverSheet\.aspx\?ItemID="
    title = lambda a: F.coalesce(text_of(n, a), let(around(n, a, lambda z: z["tag"] == "td"), lambda z: text_of(n, z)))
    links = F.filter(n, lambda x: (x["tag"] == "a") & x["url"].rlike(cover))
    return each(pages, F.transform(links, lambda a, i: F.struct((i + 1).cast("long").alias("sequence"), F.regexp_extract(a["url"], cover + r"(\d+)", 1).alias("vendor_item_id"), title(a).alias("title")))).where("vendor_item_id <> ''")


def civicplus_items(tree: DataFrame) -> DataFrame:
    """(page_id, sequence, number, section, title, body, attachments) of pages of levelled items.

    Items are the div.item right below div#divItems, or all where a page has
    no such div. Of level 1 are sections, of level 2 sub-sections where they
    have neither description nor documents; on pages with level 1 alone all
    but procedural entries are items. A title that only says what kind of
    item it is gives way to the description's first paragraph.
    """

    def read(n: Nodes) -> tuple[np.ndarray, dict[str, pa.Array]]:
        up = n.up
        holders = n.where(lambda m: m.tag == "div" and m.id == "divItems")
        holder = np.append(holders, -1)[first_of(n.page[holders], np.arange(n.pages))]
        items = n.where(lambda m: m.tag == "div" and m.has("item"))
        items = items[(holder[n.page[items]] < 0) | (up[items] == holder[n.page[items]])]
        classed = lambda name: n.where(lambda m: m.has(name))
        own = lambda parts: np.append(parts, -1)[first_of(n.owner(parts, items), items)]
        under = lambda parts, name: parts[n.owner(parts, classed(name)) >= 0]
        descs = own(classed("desc"))
        some = np.sort(descs[descs >= 0])
        paragraphs = n.tagged("p")
        files = under(n.where(lambda m: m.tag == "a" and m.url is not None and m.has("file")), "documents")
        of = n.owner(files, items)
        files = files[of >= 0][np.argsort(of[of >= 0], kind="stable")]
        of = np.sort(of[of >= 0])
        offsets, at = spread(np.searchsorted(of, items), np.searchsorted(of, items, "right"))
        level = n.by_mark(lambda m: next((int(x) for x in re.findall(r"(?:^|\s)level([0-9]+)(?!\S)", m.cls or "")), 1), items, pa.int32()).to_numpy(zero_copy_only=False)
        title, body, page = pc.fill_null(n.text(own(classed("title"))), ""), n.text(descs), n.page[items]
        flat = np.bincount(page[level != 1], minlength=n.pages)[page] == 0
        heads = ~flat & ((level == 1) | ((level == 2) & body.is_null().to_numpy(zero_copy_only=False) & (np.diff(offsets) == 0)))
        procedural = flat & pc.is_in(pc.utf8_lower(pc.replace_substring_regex(title, ":+$", "")), pa.array(_PROCEDURAL)).to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(~heads & ~procedural)

        def before(of: int) -> np.ndarray:
            """The last heading of a level before each item on its page, else -1."""
            found = np.append(-1, np.flatnonzero(heads & (level == of)))
            found = found[np.searchsorted(found[1:], kept)]
            return np.where((found >= 0) & (page[found] == page[kept]), found, -1) if len(page) else kept

        upper, lower = before(1), before(2)
        take = lambda values: values.take(pa.array(kept))
        return page[kept], {
            "sequence": pa.array(n.nth(items[kept])), "number": take(n.text(own(under(n.tagged("span"), "bullet")))), "upper": title.take(places(upper)), "lower": title.take(places(np.where(lower > upper, lower, -1))),
            "title": take(title), "body": take(body), "paragraph": take(n.text(own(paragraphs[n.owner(paragraphs, some) >= 0]))), "attachments": take(lists(offsets, n.named(files[at], "Attachment"))),
        }

    items = layout(tree, read, "sequence long, number string, upper string, lower string, title string, body string, paragraph string, attachments array<struct<name:string,url:string>>")
    number = F.regexp_replace(F.coalesce("number", F.lit("")), r"\.+$", "")
    better = F.when(F.col("title").rlike(_GENERIC) & F.col("body").isNotNull(), F.coalesce("paragraph", "body")).otherwise(F.col("title"))
    return items.select(
        "page_id", "sequence", number.alias("number"), F.nullif(F.concat_ws(" > ", "upper", "lower"), F.lit("")).alias("section"), F.coalesce(F.nullif(better, F.lit("")), F.concat(F.lit("Item "), number)).alias("title"), "body", "attachments",
    )
