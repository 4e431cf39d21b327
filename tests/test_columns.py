"""Pages' nodes as columns are those of the lists, whatever way a page is read."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_nodes import BITS, ODD

from moothall.plans import registry
from moothall.sources import columns, structure, vendors, viewers

URLS = ["http://h/a/b.html?x=1", "http://other/", ""]


def parts(nodes):
    """(page, held, opened, mark or text, up, cell) of each node."""
    at, tab, row, col, wide, high = nodes.cells
    cell = {int(a): (int(nodes.opened[t]), int(r), int(c), int(w), int(h)) for a, t, r, c, w, h in zip(at, tab, row, col, wide, high, strict=True)}
    text = dict(zip(nodes.words.tolist(), nodes.texts.to_pylist(), strict=True))
    return [(int(nodes.page[k]), int(nodes.held[k]), int(nodes.opened[k]), text.get(k) or tuple(nodes.marks[nodes.code[k]][:6]), int(nodes.opened[nodes.up[k]]) if nodes.up[k] >= 0 else 0, cell.get(k)) for k in range(len(nodes))]


def rows(k, html, url):
    found = structure.tree_of(html, url)[0]
    return [(k, r[1], r[3], r[8] or r[7], r[5], tuple(r[9]) if r[9][0] is not None else None) for r in found]


def test_lots_are_read_as_single_pages():
    rng, walked = random.Random(5), 0
    for k in range(300):
        bits = BITS + ODD if k % 3 == 0 else BITS[:9] + BITS[-5:] if k % 3 == 1 else BITS
        html = [None, ""] + ["<!DOCTYPE html>" * (n % 4 == 0) + "".join(rng.choice(bits) for _ in range(rng.randrange(25))) for n in range(12)] + ["<ul><li>a<br>b</li></ul><table><tr><td rowspan='2'> c \xa0 d</td><td>e</td></tr><tr><td>f</td></tr></table>"]
        rng.shuffle(html)
        urls = [rng.choice(URLS[: 1 + k % 3]) for _ in html]
        got = {}
        for at, nodes in columns.of_pages(pa.array(html).slice(0), pa.array(urls)):
            walked += 1
            for page, *rest in parts(nodes):
                got.setdefault(int(at[page]), []).append((int(at[page]), *rest))
        for n, (h, u) in enumerate(zip(html, urls, strict=True)):
            assert got.get(n, []) == rows(n, h, u), h
    assert walked > 300


def test_owners_are_the_innermost_around():
    rng = random.Random(2)
    html = ["".join(rng.choice(["<b>", "</b>", "<i>", "</i>", "x"]) for _ in range(60)) for _ in range(20)]
    for _, n in columns.of_pages(pa.array(html), pa.array(["http://h/"] * 20)):
        some = np.array(sorted(rng.sample(range(len(n)), len(n) // 3)))
        want = [max((e for e in some.tolist() if e < p <= e + n.held[e]), default=-1) for p in range(len(n))]
        assert n.owner(np.arange(len(n)), some).tolist() == want


#: Layouts by their queries, with what pages of theirs are made of.
LAYOUTS = {
    "src10_table_items": (viewers.table_items, ["<table>", "</table>", "<tr>", "</tr>", "<th>Title", "<th colspan=2>File #", "<th>Type:", "<td>a", "<td rowspan='2'>b", "<td colspan='2'><a href='x'>c</a>", "</td>"]),
    "src21_civicplus": (vendors.civicplus_items, ["<div>", "</div>", "<p>d", "<div class='item level1'><div class='title'>S</div>", "<div class='item level2'>", "<div class='item level3'>", "<div class='bullet'><span>1.</span></div>", "<div class='title'>Resolution 7</div>", "<div class='desc'>", "<div class='documents'><a class='file' href='q'>", "<div id='divItems'>"]),
    "src12_accessible_items": (viewers.accessible_items, ["<div>", "</div>", "</span>", "<span class='a b'>1.</span>", "<span class='a'>2.</span>", "<span class='a'>Title</span>", "<span class='c'>", "Attachments:", "(26-2275)", "<a href='x.PDF'>p</a>", "<a href='y'>q</a>"]),
    "src17_chosen_layouts": (viewers.vote_layouts, ["<div class='meeting-item' data-itemid='7'>", "<div class='agenda-item'>", "</div>", "text", "<table data-itemid='3'>", "<tr><th>2.</th>", "<td>t</td>", "</table>", "<table style='border-collapse: collapse'>", "<td class='text'>u</td>", "<p class='MsoNormal'>", "<a name='AI5_X'>w</a>"]),
    "src19_municode": (vendors.municode_items, ["<section class='agenda-section'><ul class='agenda-items'>", "<section class='agenda-section'>", "</section>", "<h2 class='section-header'>H</h2>", "<ul class='agenda-items'>", "</ul>", "<li>A</li>", "<li>2.</li>", "<li><num>4.</num> B</li>", "<ul class='agenda_item_attachments'><li><a href='f'>F</a></li></ul>"]),
    "src15_grid_items": (viewers.grid_items, ["<div class='container'>", "</div>", "<div style='grid-column-start: 1'><div>", "<h2><span style='float:left'>A.</span></h2>", "<h3><span style='float:left'>A.1</span><span style='float:left'><a href='m.pdf'>T</a>(Clerk)</span></h3>", "<h3><span style='float:left'>A.2</span></h3>", "<div style='float:left'><a href='z.pdf'>zz</a> (me)</div>", "<div>long text</div>"]),
    "src16_viewer_items": (viewers.viewer_items, ["<div>", "</div>", "<blockquote>", "</blockquote>", "<a href='MetaViewer?m=1'>d</a>", "<table><tr><td>1.</td><td>Parks ACTION: none</td></tr></table>", "<table><tr><td>2.</td><td>CONSENT AGENDA:</td></tr></table><blockquote>", "<table><tr><td>a.</td><td>[CA] Roads</td></tr></table>", "<table><tr><td>3</td><td>Roll Call.</td></tr></table>"]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_read_pages_without_lists_of_nodes(spark, name):
    """Each node went to the JVM as a row of nineteen fields, and each step over a page's list took all of it."""
    parse, bits = LAYOUTS[name]
    rng = random.Random(7)
    pages = [(k, rng.choice(URLS), "<table><tr><th>Title</tr>" * (k % 2) + "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for k in range(150)] + [(150, None, None), (151, "http://h/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got, want = (sorted(map(str, parse(t).collect())) for t in (df, structure.page_nodes(df)))
    assert got == want and len(got) > 5
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "nodes" not in plan
