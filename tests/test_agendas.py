"""Layouts of agenda pages and the line rules on small inputs."""

import pytest

from moothall.sources.agendas import LAYOUTS, agenda_items, lines_to_items, page_nodes, toc_shapes

PAGES = {
    "municode": ("<section class='agenda-section'><h2 class='section-header'>CONSENT</h2><ul class='agenda-items'><li id='i7'><span class='number'>1.</span> Pay <b>bills</b></li><ul class='agenda_item_attachments'><li><a href='/f.pdf'>Bills</a></li></ul></ul></section>", [("CONSENT", "1.", "Pay bills")]),
    "novus": ("<table><tr><td><a href='CoverSheet.aspx?ItemID=41'>First item</a></td></tr><tr><td><a href='coversheet.aspx?itemid=42'>Second</a><a href='x.html'>no</a></td></tr></table>", [(None, None, "First item"), (None, None, "Second no")]),
    "granicus_accessible": ("<div class='accessible-item'><a onclick='loadAgendaItem(12)' href='#'>A. <span class='accessible-item-text'>Call the roll</span></a></div><div class='accessible-item'><a onclick='loadAgendaItem(13)'><span class='accessible-item-text'>Zoning</span></a></div>", [(None, None, "Call the roll"), (None, None, "Zoning")]),
    "granicus_listing": ("<div class='CollapsiblePanelTab'>Council</div><table><tr class='odd'><td class='listItem'>Regular</td><td class='listItem'>May 1</td><td><a href='AgendaViewer.php?id=3'>Agenda</a></td></tr></table>", [("Council", None, "Regular May 1")]),
    "primegov": ("<div class='meeting-item' data-itemid='9'><td class='number-cell'>4</td><div class='agenda-item'>Fix <i>roads</i></div></div>", [(None, "4", "Fix roads")]),
    "legistar_grid": ("<table class='rgMasterTable'><tr class='rgRow'><td><a href='LegislationDetail.aspx?ID=5'>25-1</a></td><td>Ordinance</td></tr></table>", [(None, None, "25-1 Ordinance")]),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(spark, name):
    html, want = PAGES[name]
    pages = spark.createDataFrame([(1, "http://h/a/", html), (2, "http://h/", None), (3, None, "")], "page_id long, url string, html string")
    got = agenda_items(page_nodes(pages), LAYOUTS[name]).orderBy("page_id", "sequence").collect()
    rows = [(r["section"], r["number"], r["title"]) for r in got if r["title"] != "Bills"]
    assert rows == want
    if name in ("municode", "granicus_listing"):
        assert [a["url"] for r in got for a in r["attachments"]] != []
    if name == "novus":
        assert [r["vendor_item_id"] for r in got] == ["41", None] or [r["vendor_item_id"] for r in got] == ["41", "42"]


def test_lines(spark):
    lines = ["CITY OF X", "CONSENT ITEMS", "1. APPROVE THE", "MINUTES OF MAY:", "Staff says yes.", "2. Pay bills", "in full", "NEW BUSINESS", "not a body", "3. Adjourn"]
    df = spark.createDataFrame([(7, i, t) for i, t in enumerate(lines)], "doc_id long, line int, text string")
    got = [(r["number"], r["section"], r["title"], r["body"]) for r in lines_to_items(df).orderBy("sequence").collect()]
    assert got == [("1.", "CONSENT ITEMS", "APPROVE THE", "MINUTES OF MAY:\nStaff says yes."), ("2.", "CONSENT ITEMS", "Pay bills", "in full"), ("3.", "NEW BUSINESS", "Adjourn", "")]


def test_toc_shapes(spark):
    docs = {
        "bundle": [(1, "Agenda", 1), (2, "a.pdf", 0), (3, "x", 4), (3, "y", 5)], "deep": [(1, "Root", 1), (2, "s", 2), (3, "a", 3), (3, "b", 4), (3, "c", 5), (4, "d", 6)],
        "near": [(1, "a", 1), (1, "b", 2), (2, "c", 3)], "far": [(1, "a", 1), (1, "b", 1), (1, " TOP ", 9), (2, "c", 3)],
        "spread": [(1, "x", p) for p in range(6)] + [(2, "c", 99)], "skipped": [(1, "bottom", 1), (2, "c", 9)], "null": [(1, None, 1), (None, "a", 1), (2, "c", 3), (1, "b", None)],
    }
    rows = [(d, n, *e) for d, es in docs.items() for n, e in enumerate(es)]
    got = dict(toc_shapes(spark.createDataFrame(rows, "doc string, nth int, level int, title string, page int")).collect())
    assert got == {"bundle": "document_bundle", "deep": "deep_hierarchical", "near": "flat", "far": "hierarchical", "spread": "flat", "skipped": "flat", "null": "hierarchical"}
