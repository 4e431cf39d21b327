"""Four vendors' agenda pages on small pages."""

import pytest

from moothall.sources import structure as S
from moothall.sources import vendors as V


def tree(spark, *pages):
    return S.page_tree(spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string"))


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("page_id", "sequence").collect()]


def test_accessible_entries_go_before_tables_and_links(spark):
    entry = "<div class='accessible-item'><a onclick='loadAgendaItem(12)' href='#'>A. <span class='accessible-item-text'>Call the roll</span></a></div>"
    table = "<table style='border-collapse: collapse'><tr><td></td><td><span style='font-weight:bold'>5.A</span></td><td><a name='I77'></a>Whole cell</td></tr><tr><td>a.</td><td><a href='javascript:loadAgendaItem(8,1)'></a>no title</td></tr><tr><td>b.</td><td>no number of the item</td></tr><tr><td>6.</td></tr></table>"
    links = "<a href='javascript:loadAgendaItem(5)'>Roll Call</a><a href='javascript:loadAgendaItem(6)'>Zoning</a><a href='javascript:loadAgendaItem(6)'>again</a>"
    got = rows(V.agendaonline_items(tree(spark, entry + entry + table + links, table + links, links, "<p>nothing", None, "")), "page_id", "sequence", "vendor_item_id", "number", "title")
    assert got == [(0, 1, "12", "A.", "Call the roll"), (1, 1, "77", "5.A", "Whole cell"), (2, 1, "6", None, "Zoning")]


def test_recommendations_are_of_their_cell(spark):
    cell = lambda n, more: f"<tr><td>{n}.</td><td><a name='S{n}'></a><a href='i{n}'>T{n}</a>{more}</td></tr>"
    page = "<table style='border-collapse:collapse'>" + cell(1, "<p>RECOMMENDATION: in capitals</p><p>Recommendation: second</p>") + cell(2, "<p>Recommendation: <b>adopt</b> it</p><p>after</p>") + cell(3, "") + "</table>"
    assert rows(V.agendaonline_items(tree(spark, page)), "vendor_item_id", "title", "recommendation") == [("1", "T1", None), ("2", "T2", "adopt it"), ("3", "T3", None)]


def test_documents_belong_to_the_entry_before(spark):
    html = "<section class='agenda-section'><h2 class='section-header'>CONSENT <i>X</i></h2><ul class='agenda-items'><ul class='agenda_item_attachments'><li><a href='0'>before</a></li></ul><li><num>4.</num> Pay <b>bills</b></li><ul class='agenda_item_attachments'><li><a href='f.pdf'>Bills</a></li></ul><li></li><ul class='agenda_item_attachments'><li><a href='g.pdf'>More</a></li></ul><li>7. Parks</li></ul></section>"
    got = rows(V.municode_items(tree(spark, html, None)), "sequence", "number", "section", "title", "attachments")
    assert [(*r[:4], [tuple(a) for a in r[4]]) for r in got] == [(1, "4", "CONSENT X", "Pay bills", [("Bills", "http://h/f.pdf"), ("More", "http://h/g.pdf")]), (3, "3", "CONSENT X", "Parks", [])]


def test_cover_sheets(spark):
    html = "<td>Around <a href='CoverSheet.aspx?ItemID=41'></a></td><a href='coversheet.aspx?itemid=42'>Second</a><a href='CoverSheet.aspx?ItemID=43'></a><a href='x.html'>no</a>"
    assert rows(V.novus_items(tree(spark, html, "")), "sequence", "vendor_item_id", "title") == [(1, "41", "Around"), (2, "42", "Second"), (3, "43", None)]


@pytest.mark.parametrize("flat", [True, False])
def test_levels(spark, flat):
    item = lambda level, title, more="": f"<div class='item level{level} x'><div class='bullet'><span>{level}.</span></div><div class='title'>{title}</div>{more}</div>"
    if flat:
        html = item(1, "Adjourn:") + item(1, "Roads") + "<div class='item'><div class='bullet'><span>9.</span></div></div>"
        want = [(1, "1", None, "Roads"), (2, "9", None, "Item 9")]
    else:
        html = item(2, "Early") + item(3, "Under it") + item(1, "ONE") + item(3, "a") + item(2, "Sub") + item(3, "Item 4", "<div class='desc'>no paragraph</div>") + item(2, "b", "<div class='documents'><a class='file' href='q.pdf'></a></div>") + item(1, "TWO") + item(3, "c")
        want = [(1, "3", "Early", "Under it"), (2, "3", "ONE", "a"), (3, "3", "ONE > Sub", "no paragraph"), (4, "2", "ONE > Sub", "b"), (5, "3", "TWO", "c")]
    assert rows(V.civicplus_items(tree(spark, html, "<p>x", None)), "sequence", "number", "section", "title") == want
