"""Agenda pages with structure: pages of each layout that Spark writes from the items, parsed back; the oracles read the items themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moothall.catalog import Catalog
from moothall.plans.registry import civic
from moothall.session import shared_folder
from moothall.sources import grammars, listings, structure, vendors, viewers

_ITEMS = "(SELECT i.meeting_id AS page_id, i.sequence AS s, coalesce(m.title, 'Item ' || i.sequence) AS title, i.summary, i.n_attachments AS k, m.file, m.kind FROM items i LEFT JOIN matters m ON m.id = i.matter_id)"
_ORDER = "s, title, summary NULLS FIRST, k, file NULLS FIRST, kind NULLS FIRST"
_DOCS = "array_to_string(list_transform(range(1, k + 1), lambda j: 'Doc ' || j), ',')"


def _spread(c: Catalog, rows: DataFrame) -> DataFrame:
    """Rows by page_id in at least four tasks a core: a page's rows are small, but what is made of them isn't, so these tasks mustn't be joined by their rows' size."""
    tasks = max(int(c.spark.conf.get("spark.sql.shuffle.partitions")), 4 * c.spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "page_id")


def _pages(c: Catalog, render: Callable[[Column], Column]) -> DataFrame:
    """A page (page_id, url, html) for each meeting; render makes it of the list of its items."""
    m = c.matters().select(F.col("id").alias("matter_id"), "title", "file", "kind")
    i = c.items().select("meeting_id", F.col("sequence").alias("s"), "matter_id", "summary", F.col("n_attachments").alias("k")).join(m, "matter_id", "left")
    row = F.struct("s", F.coalesce("title", F.concat(F.lit("Item "), "s")).alias("title"), "summary", "k", "file", "kind")
    listed = _spread(c, i.withColumnRenamed("meeting_id", "page_id")).groupBy("page_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return listed.select("page_id", F.lit("http://town.example/agenda/").alias("url"), F.concat(F.lit("<!DOCTYPE html><html><body>"), render(F.col("rows")), F.lit("</body></html>")).alias("html"))


def _tree(c: Catalog, pages: DataFrame) -> DataFrame:
    """The pages' nested sets, parsed once: every join below reads the stored rows."""
    at = shared_folder(c.spark, "trees")
    structure.page_tree(pages).write.parquet(at)
    return c.spark.read.parquet(at)


def _each(rows: Column, line: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(rows, line), "")


def _text(*parts: object) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _links(x: Column, href: str) -> Column:
    return F.array_join(F.transform(F.filter(F.sequence(F.lit(0), x["k"]), lambda j: j > 0), lambda j: _text(f'<div><a href="{href}', x["s"].cast("string"), "_", j.cast("string"), '.pdf">Doc ', j.cast("string"), "</a></div>")), "")


def _of(rows: Column, letter: str | None) -> Column:
    return F.filter(rows, lambda x: x["summary"].isNull() if letter is None else x["summary"] == f"Summary {letter}")


def viewer_page(rows: Column) -> Column:
    """Items in tables, documents in the quote after; two sections with items of their own, which wrap them in divs."""
    top = lambda x: _text('<table><tr><td width="40">', x["s"].cast("string"), ".</td><td>[CA] ", x["title"], " ACTION: none</td></tr></table><blockquote>", _links(x, "MetaViewer.php?meta_id="), "</blockquote><p>text after it</p>")
    sub = lambda x: _text('<div><table><tr><td width="40">', F.char(x["s"] + 96), ".</td><td><b>", x["title"], '</b></td></tr><tr><td colspan="2">ACTION: adopted</td></tr></table></div><blockquote>', _links(x, "MetaViewer.php?meta_id="), "</blockquote>")
    section = lambda n, name, letter: _text(f'<div><table><tr><td width="40">{n}.</td><td>{name}</td></tr></table></div><blockquote>', _each(_of(rows, letter), sub), "</blockquote>")
    return _text('<table><tr><td>0.</td><td>CALL TO ORDER.</td></tr></table>', _each(_of(rows, None), top), section(901, "CONSENT AGENDA:", "A"), section(902, "PUBLIC HEARINGS (6 p.m.)", "R"), "<table><tr><td>99.</td><td>ADJOURNMENT</td></tr></table>")


@civic(
    "src16_viewer_items",
    f"SELECT page_id, CASE summary WHEN 'Summary A' THEN '901.' || chr(96 + s) WHEN 'Summary R' THEN '902.' || chr(96 + s) ELSE s::VARCHAR END AS number, CASE summary WHEN 'Summary A' THEN 'CONSENT AGENDA' WHEN 'Summary R' THEN 'PUBLIC HEARINGS' END AS section, title, {_DOCS} AS attachments FROM {_ITEMS}",
)
def _(c: Catalog):
    items = viewers.viewer_items(_pages(c, viewer_page))
    return items.select("page_id", "number", "section", "title", F.array_join("attachments", ",").alias("attachments"))


def grid_page(rows: Column) -> Column:
    """Grid cells with a heading each; a linked title with staff behind it, or plain text, and papers beside it."""
    cell = lambda *inner: _text('<div style="grid-column-start: 1"><div>', *inner, "</div></div>")
    head = lambda letter: cell(f'<h2><span style="float:left">{letter}.\xa0</span><span style="float:left">Section {letter}</span></h2>')
    title = lambda x: F.when(x["k"] > 0, _text('<a href="main', x["s"].cast("string"), '.pdf">', x["title"], "</a>(Clerk ", x["s"].cast("string"), ")")).otherwise(x["title"])
    item = lambda letter: lambda x: cell(f'<h3><span style="float:left">{letter}.', x["s"].cast("string"), '\xa0</span><span style="float:left">', title(x), "</span></h3><div>Motion ", x["s"].cast("string"), " is moved</div>", F.when(x["k"] > 1, '<div><a href="more.pdf">Report</a></div>').otherwise(""))  # noqa: E731, E501
    return _text('<div class="wide container">', *(p for letter in "AR" for p in (head(letter), _each(_of(rows, letter), item(letter)))), '</div><div style="grid-column-start: 1"><div><h3><span style="float">Z.1</span><span style="float">outside</span></h3></div></div>')


@civic(
    "src15_grid_items",
    f"""SELECT page_id, sec || '.' || s AS number, sec AS section, title, CASE WHEN k > 0 THEN 'Clerk ' || s END AS staff, 'Motion ' || s || ' is moved' || CASE WHEN k > 1 THEN chr(10) || 'Report' ELSE '' END AS description,
CASE WHEN k > 0 THEN 'http://town.example/agenda/main' || s || '.pdf' || CASE WHEN k > 1 THEN ',http://town.example/agenda/more.pdf' ELSE '' END ELSE '' END AS attachments FROM (SELECT *, right(summary, 1) AS sec FROM {_ITEMS} WHERE summary IS NOT NULL)""",
)
def _(c: Catalog):
    items = viewers.grid_items(_pages(c, grid_page))
    return items.select("page_id", "number", "section", "title", "staff", "description", F.array_join("attachments", ",").alias("attachments"))


def table_page(rows: Column) -> Column:
    """The columns stand in another order on every other page; a title reaches over two columns; every third row's type over two rows of the sheet below."""
    row = lambda x: _text("<tr><td>", x["s"].cast("string"), '<td><a href="LegislationDetail.aspx?ID=', x["s"].cast("string"), '">', F.coalesce(x["file"], F.lit("none")), "</a><td>", F.coalesce(x["kind"], F.lit("none")), '<td colspan="2">', x["title"], "<table><tr><td>inner</td></tr></table></tr>")
    return _text('<table><tr><th>Agenda #<th>File #<th>Type:<th colspan="2">Title</tr>', _each(rows, row), "</table><table><tr><td>no</td><td>headings</td></tr><tr><td>1</td><td>2</td></tr></table>")


@civic("src10_table_items", f"SELECT page_id, s::VARCHAR AS number, coalesce(file, 'none') AS file, coalesce(kind, 'none') AS kind, title, 'http://town.example/agenda/LegislationDetail.aspx?ID=' || s AS url FROM {_ITEMS}")
def _(c: Catalog):
    return viewers.table_items(_pages(c, table_page)).select("page_id", "number", "file", "kind", "title", "url")


def detail_page(rows: Column) -> Column:
    """A matter's page: the attachments' own element, or only a label in a table."""
    link = lambda x: _text('<a href="View.ashx?M=F&ID=', x["s"].cast("string"), '">', x["title"], "</a>, ")
    own = _text('<a href="View.ashx?ID=0">not one</a><table id="ctl00_ContentPlaceHolder1_tblAttachments"><tr><td>Attachments:</td><td><span id="ctl00_ContentPlaceHolder1_lblAttachments2">', _each(rows, link), "</span></td></tr></table>")
    other = _text('<a href="View.ashx?ID=0">not one</a><table><tr><td>Attachments:</td><td>', _each(rows, link), '<a href="other.html">no document</a></td></tr></table><a href="View.ashx?ID=9">outside</a>')
    return F.when(F.size(rows) % 2 == 0, own).otherwise(other)


@civic("src11_attachments", f"SELECT page_id, title AS name, 'http://town.example/agenda/View.ashx?M=F&ID=' || s AS url FROM {_ITEMS}")
def _(c: Catalog):
    return viewers.detail_attachments(structure.page_nodes(_pages(c, detail_page))).select("page_id", "name", "url")


def accessible_page(rows: Column) -> Column:
    """Positioned spans: numbers and titles of one class, files in brackets, links after a word or to a PDF."""
    span = lambda cls, *inner: _text(f'<span class="{cls}">', *inner, "</span>")
    item = lambda x: _text('<div style="top:1em">', span("s17 x", x["s"].cast("string"), "."), span("s18", "12."), "<span class='s17'>", span("s10", x["title"]), "</span>", span("s18", "Recommendation (26-", F.lpad(x["s"].cast("string"), 4, "0"), ")"), F.when(x["k"] > 0, _text(span("s17", "Attachments:"), _links(x, "d"), span("s17", "no title"))).otherwise('<a href="page.html">see</a>'), "</div>")
    return _text(span("s18", "Agenda of 1999"), _each(rows, item))


@civic("src12_accessible_items", f"SELECT page_id, s::VARCHAR AS number, title, '26-' || lpad(s::VARCHAR, 4, '0') AS file, {_DOCS} AS attachments FROM {_ITEMS}")
def _(c: Catalog):
    items = viewers.accessible_items(_pages(c, accessible_page))
    return items.select("page_id", "number", "title", "file", F.array_join(F.transform("attachments", lambda x: x["name"]), ",").alias("attachments"))


def mixed_page(rows: Column) -> Column:
    """One of five layouts by the number of items; each page also has a stray mark of another layout."""
    s = lambda x: x["s"].cast("string")
    looks = [
        lambda x: _text('<div class="row meeting-item" data-itemid="', s(x), '"><table><tr><td class="number-cell">', s(x), '.</td></tr></table><div class="agenda-item">', x["title"], "</div>trailing</div>"),
        lambda x: _text('<div class="agenda-item" data-itemid="', s(x), '">', x["title"], "</div>after"),
        lambda x: _text('<table data-itemid="', s(x), '"><tr><th>', s(x), ".</th><td>", x["title"], "</td></tr></table>after"),
        lambda x: _text('<table style="BORDER-COLLAPSE: collapse"><tr><td class="num">', s(x), '.</td><td class="text">', x["title"], "</td></tr></table>"),
        lambda x: _text('<p class="MsoNormal"><b>', s(x), '.</b><a name="AI', s(x), '_NAME">', x["title"], "</a> aside</p>"),
    ]
    stray = F.lit('<table style="border-collapse: collapse"><tr><td class="text"></td></tr></table><p class="MsoNormal">no item</p>')
    out = _each(rows, looks[4])
    for k in range(4):
        out = F.when(F.size(rows) % 5 == k, _each(rows, looks[k])).otherwise(out)
    return _text(stray, out)


@civic(
    "src17_chosen_layouts",
    f"""SELECT page_id, ['wrapped', 'plain', 'rows', 'bordered', 'word'][n % 5 + 1] AS layout, n AS votes, row_number() OVER (PARTITION BY page_id ORDER BY s, title, summary NULLS FIRST, k, file NULLS FIRST, kind NULLS FIRST) AS sequence, CASE WHEN n % 5 <= 2 THEN s::VARCHAR END AS vendor_item_id, CASE WHEN n % 5 <> 1 THEN s::VARCHAR END AS number, title
FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM {_ITEMS})""",
)
def _(c: Catalog):
    return viewers.vote_layouts(_pages(c, mixed_page))


@civic(
    "src16_link_containers",
    r"""SELECT page_id, tag, sum(len(regexp_extract_all(block, '<a\s')))::BIGINT AS links FROM (SELECT page_id, tag, unnest(regexp_extract_all(html, '(?s)<' || tag || '[ >].*?</' || tag || '>')) AS block FROM pages, (VALUES ('nav'), ('article'), ('footer'), ('div')) v(tag)) GROUP BY 1, 2 HAVING sum(len(regexp_extract_all(block, '<a\s'))) > 0""",
)
def _(c: Catalog):
    """Links of the landed pages by the innermost navigation, article, footer or div around them."""
    tree = _tree(c, c.table("pages"))
    boxes = tree.where("tag in ('nav', 'article', 'footer', 'div')")
    held = structure.nearest(tree.where("tag = 'a'"), structure.spans(boxes), structure.PAGE, "open", "s_open", "s_close", "size")
    return held.join(structure.spans(boxes, "tag"), ["page_id", "s_open"]).groupBy("page_id", "tag").agg(F.count("*").alias("links"))


def agenda_texts(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """Text agendas (doc_id, text), lettered for even meetings and by records for odd ones, and links (doc_id, line, url) by the line that they stand on."""
    m = c.matters().select(F.col("id").alias("matter_id"), "title")
    i = c.items().select(F.col("meeting_id").alias("page_id"), F.col("sequence").alias("s"), F.col("n_attachments").alias("k"), "matter_id", "item_id").join(m, "matter_id", "left")
    row = F.struct("item_id", "s", "k", F.coalesce("title", F.concat(F.lit("Item "), "s")).alias("title"))
    listed = i.groupBy("page_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    even = F.col("page_id") % 2 == 0
    number = lambda x, n: F.when(even, _text("H", n.cast("string"))).otherwise(_text("O2025-", F.lpad(n.cast("string"), 7, "0")))
    head = F.when(even, F.array(*map(F.lit, ("Cover", "H9. Not an item", "--- PAGE 1", "H. Presentations")))).otherwise(F.array(*map(F.lit, ("City Council", "ORDINANCES", "AMENDED", "none"))))
    lines = lambda x, n: F.array(F.when(even, _text(number(x, n), ".    ", x["title"], "  ")).otherwise(_text(n.cast("string"), ". (", number(x, n), ") ", x["title"])), F.lit(""), _text("  body of ", n.cast("string")))
    last = F.when(even, F.array(*map(F.lit, ("J. Adjournment", "after the items")))).otherwise(F.array(*map(F.lit, ("1. (O2025-0000001) once more", "its text", "ADJOURNMENT", "after the items"))))
    text = F.array_join(F.concat(head, F.flatten(F.transform("rows", lambda x, n: lines(x, n + 1))), last), "\n")
    links = listed.select("page_id", F.posexplode("rows").alias("n", "x")).where("x.k > 0").select(F.col("page_id").alias("doc_id"), (F.lit(4) + F.col("n") * 3 + F.col("x.k") - 1).alias("line"), _text("u", F.col("n").cast("string")).alias("url"))
    return listed.select(F.col("page_id").alias("doc_id"), text.alias("text")), links


@civic(
    "src32_city_agendas",
    """WITH r AS (SELECT i.meeting_id AS doc_id, row_number() OVER (PARTITION BY i.meeting_id ORDER BY i.item_id, i.sequence, i.n_attachments, coalesce(m.title, 'Item ' || i.sequence)) AS n, i.n_attachments AS k, coalesce(m.title, 'Item ' || i.sequence) AS title FROM items i LEFT JOIN matters m ON m.id = i.matter_id)
SELECT doc_id, n AS sequence, CASE WHEN doc_id % 2 = 0 THEN 'H' || n ELSE 'O2025-' || lpad(n::VARCHAR, 7, '0') END AS number, title, 'body of ' || n AS body, CASE WHEN k > 0 THEN 'u' || (n - 1) ELSE '' END AS links FROM r""",
)
def _(c: Catalog):
    texts, links = agenda_texts(c)
    even = texts.where("doc_id % 2 = 0"), links.where("doc_id % 2 = 0")
    odd = texts.where("doc_id % 2 = 1"), links.where("doc_id % 2 = 1")
    out = grammars.text_items(even[0], grammars.LETTERED, even[1]).unionByName(grammars.text_items(odd[0], grammars.RECORDS, odd[1]))
    return out.withColumn("links", F.array_join("links", ","))


def listing_page(rows: Column) -> Column:
    """A committee's meetings, in one of three forms by their number: classed rows whose dates follow a hidden epoch second; plain rows of a listing table, dates first, under a panel's heading; links as choices and dates by slashes. The first meeting stands there twice, and a row without a link once."""
    day = lambda x, form: F.coalesce(F.date_format(x["date"], form), F.lit("to be set"))
    n = lambda x: x["id"].cast("string")
    classed = lambda x: _text('<tr class="odd"><td class="listItem">', x["title"], '</td><td class="listItem"><span style="display:none">1768204800</span>', day(x, "EEEE, MMMM d, yyyy"), F.when(x["date"].isNotNull(), " - 06:30 PM").otherwise(""), '</td><td><a href="//h/AgendaViewer.php?view_id=2&event_id=', n(x), '">Agenda</a></td></tr>')  # noqa: E731, E501
    turned = lambda x: _text('<tr><td class="listedItem">', day(x, "MMM d, yyyy"), '</td><td class="listedItem"><a href="/AgendaViewer.php?clip_id=', n(x), '">Agenda</a></td><td><a href="packet', n(x), '.PDF">Packet</a></td></tr>')
    choice = lambda x: _text('<tr class="listingRow even"><td class="listItem">', x["title"], '</td><td class="listItem">', day(x, "MM / dd / yyyy"), '</td><td><select><option value="">Choose</option><option value="AgendaViewer.php?event_id=', n(x), '">Agenda</option></select></td></tr>')
    table = lambda line: _text('<table class="listingTable"><tr><td class="listItem">no link</td><td class="listItem">May 1, 2024</td></tr>', _each(F.slice(rows, 1, 1), line), _each(rows, line), "</table>")
    panel = _text('<div class="CollapsiblePanel"><div class="CollapsiblePanelTab">Planning <b>Board</b></div><div class="CollapsiblePanelContent">', table(turned), "</div></div>")
    return F.when(F.size(rows) % 3 == 0, table(classed)).when(F.size(rows) % 3 == 1, panel).otherwise(table(choice))


@civic(
    "src13_listed_meetings",
    """SELECT page_id, id::VARCHAR AS event_id, CASE n % 3 WHEN 1 THEN CASE WHEN date IS NULL THEN 'to be set' ELSE 'Planning Board' END ELSE title END AS title, CASE n % 3 WHEN 0 THEN coalesce(date + INTERVAL 1110 MINUTE, TIMESTAMP '2026-01-12 08:00:00') ELSE date::TIMESTAMP END AS start,
CASE n % 3 WHEN 0 THEN 'http://h/AgendaViewer.php?view_id=2&event_id=' || id WHEN 1 THEN 'http://town.example/AgendaViewer.php?clip_id=' || id ELSE 'http://town.example/agenda/AgendaViewer.php?event_id=' || id END AS agenda_url, CASE n % 3 WHEN 1 THEN 'http://town.example/agenda/packet' || id || '.PDF' END AS packet_url
FROM (SELECT committee_key AS page_id, id, title, date, count(*) OVER (PARTITION BY committee_key) AS n FROM meetings)""",
)
def _(c: Catalog):
    row = F.struct("id", "title", F.col("date").cast("timestamp").alias("date"))
    listed = _spread(c, c.meetings().withColumnRenamed("committee_key", "page_id")).groupBy("page_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    pages = listed.select("page_id", F.lit("http://town.example/agenda/").alias("url"), _text("<!DOCTYPE html><html><body>", listing_page(F.col("rows")), "</body></html>").alias("html"))
    return listings.listed_meetings(structure.page_nodes(pages)).drop("open")


def online_page(rows: Column) -> Column:
    """Accessible entries, rows of tables with collapsed borders, or loading links alone, by the first item's number; items of one number load the same."""
    n = lambda x: x["s"].cast("string")
    spoken = lambda x: F.when(x["k"] > 0, _text('<span class="accessible-item-text">', x["title"], "</span>")).otherwise(x["title"])
    entry = lambda x: _text('<div class="row accessible-item"><a href="#" onclick="loadAgendaItem(', n(x), ')">', n(x), ". ", spoken(x), "</a> aside</div>")
    inner = lambda x: F.when(x["k"] > 0, _text("<td> </td><td><b>", n(x), '.</b> of 9</td><td><a name="I', n(x), '"></a><a href="javascript:loadAgendaItem(0,false)">', x["title"], "</a><p>Recommendation: adopt <i>", n(x), "</i></p></td>")).otherwise(_text("<td>", n(x), '.</td><td><a name="S', n(x), '"></a>', x["title"], "</td><td>1.</td>"))  # noqa: E731, E501
    link = lambda x: _text('<p><a href="javascript:loadAgendaItem(', n(x), ',false)">', x["title"], "</a></p>")
    bordered = _text('<table style="BORDER-COLLAPSE:collapse">', _each(rows, lambda x: _text("<tr>", inner(x), "</tr>")), "<tr><td>none</td><td>no number</td></tr></table>")
    form = F.when(rows[0]["s"] % 3 == 0, _each(rows, entry)).when(rows[0]["s"] % 3 == 1, bordered).otherwise(_each(rows, link))
    return _text('<div class="accessible-item">no link</div>', form, '<a href="javascript:loadAgendaItem(999,false)">Adjournment</a>')


@civic(
    "src14_agenda_online",
    f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY s) AS sequence, s::VARCHAR AS vendor_item_id, CASE WHEN form < 2 THEN s || '.' END AS number, title, CASE WHEN form = 1 AND k > 0 THEN 'adopt ' || s END AS recommendation
FROM (SELECT *, min(s) OVER (PARTITION BY page_id) % 3 AS form, row_number() OVER (PARTITION BY page_id, s ORDER BY {_ORDER}) AS r FROM {_ITEMS}) WHERE r = 1""",
)
def _(c: Catalog):
    return vendors.agendaonline_items(structure.page_nodes(_pages(c, online_page)))


def sectioned_page(rows: Column) -> Column:
    """A list without heading and numbers, then two sections with both and an empty entry in the first; documents in lists between the entries."""
    papers = lambda x: F.when(x["k"] > 0, _text('<ul class="x agenda_item_attachments"><li>', _links(x, "d"), '<a href="nameless.pdf"></a></li></ul>')).otherwise("")
    plain = lambda x: _text("<li>", x["s"].cast("string"), ". ", x["title"], "</li>", papers(x))
    numbered = lambda x: _text("<li><num>", x["s"].cast("string"), ".</num> <b>", x["title"], "</b></li>", papers(x))
    part = lambda letter, first: _text(f'<section class="agenda-section"><h2 class="section-header">Section <i>{letter}</i></h2><ul class="agenda-items">{first}', _each(_of(rows, letter), numbered), '</ul><ul class="agenda-items"><li>second list</li></ul></section>')
    return _text('<section class="agenda-section"><ol class="agenda-items">', _each(_of(rows, None), plain), "</ol></section>", part("A", "<li> </li>"), part("R", ""), "<ul class='agenda-items'><li>in no section</li></ul>")


@civic(
    "src19_municode",
    f"""SELECT page_id, sequence, CASE WHEN summary IS NULL THEN sequence ELSE s END::VARCHAR AS number, 'Section ' || right(summary, 1) AS section, title, {_DOCS} AS attachments
FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY summary NULLS FIRST, {_ORDER}) + (summary IS NOT NULL)::BIGINT AS sequence FROM {_ITEMS})""",
)
def _(c: Catalog):
    items = vendors.municode_items(_pages(c, sectioned_page))
    return items.withColumn("attachments", F.array_join(F.transform("attachments", lambda x: x["name"]), ","))


def covers_page(rows: Column) -> Column:
    """Links to cover sheets; one without text stands beside its title."""
    n = lambda x: x["s"].cast("string")
    cell = lambda x: F.when(x["k"] > 0, _text("No. ", n(x), ' <a href="CoverSheet.aspx?ItemID=', n(x), '&amp;MeetingID=1">', x["title"], "</a>")).otherwise(_text(x["title"], ' <a href="coversheet.ASPX?ItemID=', n(x), '"><img alt="item"></a>'))
    return _text('<table class="agenda">', _each(rows, lambda x: _text("<tr><td>", cell(x), '<td><a href="DisplayAgendaPDF.ashx?ID=1">PDF</a></tr>')), '</table><a href="CoverSheet.aspx?ItemID=">no number</a>')


@civic("src20_novus", f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY {_ORDER}) AS sequence, s::VARCHAR AS vendor_item_id, title FROM {_ITEMS}")
def _(c: Catalog):
    return vendors.novus_items(structure.page_nodes(_pages(c, covers_page)))


def levelled_page(rows: Column) -> Column:
    """An even number of items: sections, a sub-section and items by level, those without a section named by their descriptions; an odd one: one level."""
    docs = lambda x: F.when(x["k"] > 0, _text('<div class="documents">', F.replace(_links(x, "d"), F.lit("<a "), F.lit('<a class="file" ')), '<a href="other.pdf">other</a></div>')).otherwise("")
    head = lambda level, title: f'<div class="item level{level}"><div class="bullet"><span>I.</span></div><div class="title">{title}</div><div class="desc"><br></div></div>'
    item = lambda level, said=False: lambda x: _text(f'<div class="item level{level}"><div class="bullet"><b><span>', x["s"].cast("string"), '.</span></b></div><div class="title">', *(("Resolution 7</div>", '<div class="desc"><p>', x["title"], "</p><p>more</p></div>") if said else (x["title"], "</div>")), docs(x), "</div>")
    deep = _text('<div id="divItems">', _each(_of(rows, None), item(2, True)), head(1, "Section A"), _each(_of(rows, "A"), item(3)), head(1, "Section R"), head(2, "Group"), _each(_of(rows, "R"), item(3)), "</div>", head(3, "outside"))
    return F.when(F.size(rows) % 2 == 0, deep).otherwise(_text(head(1, "Roll Call:"), _each(rows, item(1))))


@civic(
    "src21_civicplus",
    f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN deep THEN summary END NULLS FIRST, {_ORDER}) AS sequence, s::VARCHAR AS number, CASE WHEN deep THEN 'Section ' || right(summary, 1) || CASE summary WHEN 'Summary R' THEN ' > Group' ELSE '' END END AS section, title, CASE WHEN deep AND summary IS NULL THEN title || ' more' END AS body, {_DOCS} AS attachments
FROM (SELECT *, count(*) OVER (PARTITION BY page_id) % 2 = 0 AS deep FROM {_ITEMS})""",
)
def _(c: Catalog):
    items = vendors.civicplus_items(_pages(c, levelled_page))
    return items.withColumn("attachments", F.array_join(F.transform("attachments", lambda x: x["name"]), ","))
