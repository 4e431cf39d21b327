"""Pages as lists of nodes: parsers work within a page, and plain pages are read as html.parser reads them."""

import random

import pytest

from moothall.sources import listings, structure, vendors, viewers

BITS = ["<p>", "</p>", '<div class="a b">', "<div style='x'>", "</div>", "<table>", "</table>", "<tr>", '<td colspan="2">', "<td>", '<th rowspan="3">', "</td>", "text", " a  b ", '<a href="x.pdf">', '<a href="v.ashx?M=F&ID=3&amp;B=1">', '<a href="?q">', "</a>", "<br>", "<li>", "<ul>", "</ul>"]
ODD = ["<br/>", "&amp;", "<!-- c -->", "<script>x<b></script>", "<title>a<b></title>", "<", "< a", "<A HREF=x>", "</ b>", '<a href="v?a&copy=1">', "\x00"]


def test_plain_pages_are_read_as_by_the_parser():
    rng, fast = random.Random(1), 0
    for k in range(3000):
        html = "".join(rng.choice(BITS + ODD if k % 3 == 0 else BITS) for _ in range(rng.randrange(14)))
        plain, full = structure._Tree("http://h/a/b.html?x=1"), structure._Tree("http://h/a/b.html?x=1")
        read = plain.plain(html)
        plain.close()
        full.feed(html)
        full.close()
        assert not read or (plain.rows, plain.at) == (full.rows, full.at), html
        fast += read
    assert fast > 2000


@pytest.mark.parametrize("parse", [
    viewers.viewer_items, viewers.grid_items, viewers.detail_attachments, viewers.accessible_items, viewers.table_items, viewers.vote_layouts, vendors.agendaonline_items, vendors.municode_items, vendors.novus_items, vendors.civicplus_items, listings.listed_meetings,
])
def test_no_rows_move_between_tasks(spark, parse):
    """The layouts' joins took some twenty shuffles and broadcasts of every node."""
    pages = structure.page_nodes(spark.createDataFrame([(1, "http://h/", "<p>x")], "page_id long, url string, html string"))
    plan = parse(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_equal_tags_are_read_once(monkeypatch):
    read, real = [], structure._plain_tag
    monkeypatch.setattr(structure, "_plain_tag", lambda base, source: read.append(source) or real(base, source))
    structure._tags.cache_clear()
    rows, _ = structure.tree_of('<table><tr><td class="a">x</td></tr></table>' * 50, "http://h/")
    assert len(rows) == 200 and len(read) == 6
