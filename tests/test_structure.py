"""Nested sets, interval joins, cell grids and layouts on small pages."""

import random

from moothall.operators.intervals import enclosing, nearest
from moothall.sources import structure as S
from moothall.sources import viewers as V


def tree(spark, *pages):
    return S.page_tree(spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string"))


def test_enclosing_by_hand(spark):
    """Any spans, crossing ones too, against all pairs; each pair once."""
    rng = random.Random(3)
    spans = [(rng.randrange(3), *sorted(rng.sample(range(1, 300), 2)), i) for i in range(120)] + [(0, 5, 5, 999), (1, 7, 8, 1000)]
    points = [(rng.randrange(3), rng.randrange(1, 300), 300, i) for i in range(150)]
    s = spark.createDataFrame(spans, "k long, a long, b long, sid long")
    p = spark.createDataFrame(points, "k long, x long, n long, pid long")
    got = sorted((r["pid"], r["sid"]) for r in enclosing(p, s, ["k"], "x", "a", "b", "n").collect())
    assert got == sorted((i, j) for k, x, _, i in points for l, a, b, j in spans if k == l and a < x <= b)
    inner = {(r["k"], r["x"]): r["a"] for r in nearest(p, s, ["k"], "x", "a", "b", "n").collect()}
    assert inner == {(k, x): max(a for l, a, b, _ in spans if k == l and a < x <= b) for k, x, _, _ in points if any(k == l and a < x <= b for l, a, b, _ in spans)}


def test_trees(spark):
    rows = tree(spark, "<p>a<p>b<ul><li>c<li>d<ul><li>e</ul>f</ul></i>g", None, "", "<b>" * 20_000 + "x").collect()
    at = {r["text"]: r for r in rows if r["page_id"] == 0 and r["text"]}
    by_open = {r["open"]: r for r in rows if r["page_id"] == 0}
    assert [by_open[at[c]["parent"]]["tag"] for c in "abcdef"] == ["p", "p", "li", "li", "li", "li"]
    assert at["f"]["parent"] == at["d"]["parent"] != at["c"]["parent"]
    assert {r["page_id"] for r in rows} == {0, 3} and max(r["depth"] for r in rows) == 20_000
    for page in (0, 3):
        numbers = sorted(n for r in rows if r["page_id"] == page for n in {r["open"], r["close"]})
        assert numbers == list(range(1, rows[[r["page_id"] for r in rows].index(page)]["size"] + 1))


def test_cells_that_reach_over_others(spark):
    html = '<table><tr><th rowspan=2>A<th colspan=2>B</tr><tr><th>b1<th>b2</tr><tr><td>x<td rowspan=2>y<table><tr><td>in</table>z</td><td><a href="q.pdf">l</a></td></tr><tr><td>x2<td colspan="zz">k</table><table><tr><td>no heading</table>'
    got = {(r["row"], r["name"]): (r["text"], [tuple(x) for x in r["links"] or []]) for r in S.records(tree(spark, html)).collect()}
    assert got == {(2, "A"): ("x", []), (2, "B / b1"): ("y z", []), (2, "B / b2"): ("l", [("l", "http://h/q.pdf")]), (3, "A"): ("x2", []), (3, "B / b1"): ("y z", []), (3, "B / b2"): ("k", [])}


def test_sections_and_quotes(spark):
    """Bare tables and tables in divs; a quote of an item isn't a section's; text after an item's end isn't in it."""
    table = lambda n, t: f"<table><tr><td>{n}.</td><td>{t}</td></tr></table>"
    html = "<body>" + table(1, "Roll Call") + table(2, "Parks ACTION: none") + '<blockquote><a href="MetaViewer?meta_id=1">d1</a>' + table("x", "in an item's quote") + "</blockquote><p>after</p><div>" + table(3, "OLD BUSINESS -") + "</div><blockquote><div>" + table("a", "Roads") + '</div><blockquote><div><a href="MetaViewer?meta_id=2"></a></div></blockquote>' + table("b", "Trees") + "</blockquote>" + table(4, "Budget") + table("no item", "x") + table(5, "")
    got = [(r["number"], r["section"], r["title"], r["attachments"]) for r in V.viewer_items(tree(spark, html)).orderBy("open").collect()]
    assert got == [("2", None, "Parks", ["d1"]), ("3.a", "OLD BUSINESS", "Roads", ["Supporting Document"]), ("3.b", "OLD BUSINESS", "Trees", []), ("4", "OLD BUSINESS", "Budget", [])]


def test_the_layout_with_most_items_is_chosen(spark):
    wrapped = '<div class="meeting-item" data-itemid="7"><div class="agenda-item">One</div></div>'
    pages = [wrapped, wrapped + '<div class="agenda-item">Two</div>', "<p>nothing</p>", None, '<div class="meeting-item"><div class="agenda-item"> </div></div>']
    got = [(r["page_id"], r["layout"], r["votes"], r["sequence"], r["title"]) for r in V.vote_layouts(tree(spark, *pages)).orderBy("page_id", "sequence").collect()]
    assert got == [(0, "wrapped", 1, 1, "One"), (1, "plain", 2, 1, "One"), (1, "plain", 2, 2, "Two")]


def test_pages_without_structure_have_no_items(spark):
    t = tree(spark, "<p>text", None, "")
    for parse in (V.viewer_items, V.grid_items, V.detail_attachments, V.accessible_items, V.table_items, V.vote_layouts):
        assert parse(t).count() == 0
