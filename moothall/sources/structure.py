"""HTML pages as nested sets: every element and text with its place among the others, tables as cell grids.

The parser (the standard library's) only numbers what it meets: an element has
the numbers of its opening and its closing, so that one element holds another
if its pair of numbers encloses the other's. Everything else is joins over
those rows: what stands inside what, which sibling comes next, which heading a
cell has.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moothall.operators.intervals import enclosing, nearest

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag ends these elements if they are open, as far up as the next of the others.
_ENDS = {"li": ("li", "ul ol"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr td th", "table"), "p": ("p", "body div td th li article section blockquote"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select")}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}
_NONE = (frozenset(), frozenset())
#: A cell's spans count up to these, as in browsers.
_MOST_COLS, _MOST_ROWS = 1000, 65534
_NODE = "at int, held int, up int, open long, close long, parent long, depth int, tag string, id string, cls string, style string, url string, key string, text string, tab long, row int, col int, wide int, high int"
_COLUMNS = [f.split()[0] for f in _NODE.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
_STRUCT = pa.struct([(c, _TYPES[t]) for c, t in (f.split() for f in _NODE.split(", "))])
#: The parser's rows have a node's fields up to depth, what its tag says (tag to key), its text, and its cell's place (tab to high); these are read or filled late.
_HELD, _CLOSE, _MARKS, _CELL = (_COLUMNS.index(c) for c in ("held", "close", "tag", "tab"))
_TEXT, _NO_CELL, _TOP = ("#text", None, None, None, None, None), (None,) * 5, (0, 0, 0, 0)
#: Different tags kept for an address.
_MOST_TAGS = 2_000
#: A batch from the parser ends with the page that reaches so many nodes.
_MOST_NODES = 20_000
PAGE = ("page_id",)


class _Grid:
    """Places cells of one table: the next column that no cell of an earlier row reaches down to."""

    def __init__(self, at: int) -> None:
        self.at, self.row, self.col, self.down = at, -1, 0, {}

    def next_row(self) -> None:
        self.row, self.col = self.row + 1, 0
        self.down = {c: n - 1 for c, n in self.down.items() if n > 1}

    def place(self, wide: int, high: int) -> tuple[int, int]:
        while self.col in self.down:
            self.col += 1
        at = self.col
        self.down |= dict.fromkeys(range(at, at + wide), high)
        self.col = at + wide
        return max(self.row, 0), at


#: Plain tags and text; _PLAIN_ATTR reads a tag's attributes. Whatever else a page has is left to html.parser.
_SPACE = r"[ \t\r\n\f]"
_ATTR = rf"""{_SPACE}+([a-zA-Z][a-zA-Z-]*)=(?:"([^"<>]*)"|'([^'<>]*)')"""
_PLAIN = re.compile(rf"<(?:/([a-zA-Z][a-zA-Z0-9]*)>|([a-zA-Z][a-zA-Z0-9]*)((?:{_ATTR.replace('(', '(?:').replace('(?:?:', '(?:')})*)>)|([^<&]+)")
_PLAIN_ATTR = re.compile(_ATTR)
_PLAIN_PATH = re.compile(r"\w[\w-]*(?:\.\w+)*(?:\?[\w=&%+-]+)?", re.ASCII)
_DOCTYPE = "<!DOCTYPE html>"
#: Elements whose content isn't read as tags.
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())


@lru_cache(64)
def _folder(base: str) -> str | None:
    """What a plain relative path is appended to."""
    return urljoin(base, "x")[:-1] if re.match("https?://", base) else None


def _full(base: str, href: str) -> str:
    folder = _folder(base)
    return folder + href if folder and _PLAIN_PATH.fullmatch(href) else urljoin(base, href)


def _marked(base: str, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[tuple, int, int]:
    """What a tag says of its node (tag, id, cls, style, url, key), and a cell's spans, 0 for other tags."""
    a = {k: v or "" for k, v in attrs}
    href = a.get("href") or (a.get("value") if tag == "option" else None)
    marks = tag, a.get("id"), a.get("class"), a.get("style"), _full(base, href) if href else None, a.get("data-itemid") or a.get("onclick") or a.get("name") or None
    if tag not in ("td", "th"):
        return marks, 0, 0
    span = lambda k, most: min(max(int(a[k]), 1), most) if a.get(k, "").isdecimal() else 1
    return marks, span("colspan", _MOST_COLS), span("rowspan", _MOST_ROWS)


def _plain_tag(base: str, source: str) -> tuple | None:
    """(tag, marks or None for an end, whether it ends others, spans, void) of what stands between a tag's brackets; None if it isn't plain."""
    m = _PLAIN.fullmatch(f"<{source}>")
    if m is None:
        return None
    if m[1]:
        return m[1].lower(), None, False, 0, 0, False
    tag, attrs = m[2].lower(), []
    if tag in _RAW:
        return None
    for name, one, other in _PLAIN_ATTR.findall(m[3]) if m[3] else ():
        value = one or other
        if "&" in value:
            rest = value.replace("&amp;", "")
            if "&" in rest and unescape(rest) != rest:
                return None
            value = value.replace("&amp;", "&")
        attrs.append((name.lower(), value))
    marks, wide, high = _marked(base, tag, attrs)
    return tag, marks, tag in _ENDS, wide, high, tag in _VOID


@lru_cache(64)
def _tags(base: str) -> dict[str, tuple]:
    """Tags read so far, of pages with one address, by what stands between their brackets; () for those that aren't plain."""
    return {}


class _Tree(HTMLParser):
    def __init__(self, base: str) -> None:
        super().__init__()
        self.base, self.at, self.rows, self.open, self.count, self.grids = base, 0, [], [], defaultdict(int), []

    def plain(self, html: str) -> bool:
        """Reads a page of plain tags and text as feed would; False, with part of it read, if it has anything else."""
        tags, rows, opened, count, grids = _tags(self.base), self.rows, self.open, self.count, self.grids
        head, *parts = html[len(_DOCTYPE) if html.startswith(_DOCTYPE) else 0 :].split("<")
        if "&" in head:
            return False
        self.handle_data(head)
        for part in parts:
            source, end, data = part.partition(">")
            if (tag := tags.get(source)) is None:
                if len(tags) >= _MOST_TAGS:
                    tags.clear()
                tag = tags[source] = _plain_tag(self.base, source) or ()
            if not tag or not end or "&" in data:
                return False
            name, marks, ended, wide, high, void = tag
            if marks is None:
                if count[name]:
                    while count[name] and opened[-1][_MARKS][0] != name:
                        self._close()
                    self._close()
            else:
                if ended or wide or name in ("tr", "table"):
                    self._begin(name, marks, wide, high)
                else:
                    self.at = at = self.at + 1
                    up = opened[-1] if opened else _TOP
                    row = [len(rows) + 1, 0, up[0], at, at, up[3], len(opened), marks, None, _NO_CELL]
                    rows.append(row)
                    if not void:
                        opened.append(row)
                        count[name] += 1
            if data and (text := " ".join(data.split())):
                self.at = at = self.at + 1
                up = opened[-1] if opened else _TOP
                rows.append([len(rows) + 1, 0, up[0], at, at, up[3], len(opened), _TEXT, text, _NO_CELL])
        return True

    def _close(self) -> None:
        row = self.open.pop()
        tag = row[_MARKS][0]
        self.count[tag] -= 1
        self.at += 1
        row[_CLOSE], row[_HELD] = self.at, len(self.rows) - row[0]
        if tag == "table" and self.grids:
            self.grids.pop()

    def _place(self) -> tuple[int, int, int, int, int, int, int]:
        self.at += 1
        up = self.open[-1] if self.open else _TOP
        return len(self.rows) + 1, 0, up[0], self.at, self.at, up[3], len(self.open)

    def _begin(self, tag: str, marks: tuple, wide: int, high: int) -> None:
        ended, within = _ENDS.get(tag, _NONE)
        if ended and any(self.count[t] for t in ended):
            last = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][_MARKS][0] in within), -1)
            first = next((k for k in range(last + 1, len(self.open)) if self.open[k][_MARKS][0] in ended), None)
            while first is not None and len(self.open) > first:
                self._close()
        cell = _NO_CELL
        if tag == "tr" and self.grids:
            self.grids[-1].next_row()
        if wide and self.grids:
            cell = (self.grids[-1].at, *self.grids[-1].place(wide, high), wide, high)
        row = [*self._place(), marks, None, cell]
        self.rows.append(row)
        if tag in _VOID:
            return
        self.open.append(row)
        self.count[tag] += 1
        if tag == "table":
            self.grids.append(_Grid(self.at))

    def handle_starttag(self, tag, attrs):
        self._begin(tag, *_marked(self.base, tag, attrs))

    def handle_endtag(self, tag):
        if self.count[tag]:
            while self.count[tag] and self.open[-1][_MARKS][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and not (self.count["script"] or self.count["style"]):
            self.rows.append([*self._place(), _TEXT, text, _NO_CELL])

    def close(self):
        super().close()
        while self.open:
            self._close()


def tree_of(html: str | None, base: str | None) -> tuple[list[list], int]:
    """A page's nodes, and its last number."""
    p = _Tree(base or "")
    if not p.plain(html or ""):
        p = _Tree(base or "")
        p.feed(html or "")
    p.close()
    return p.rows, p.at


def page_nodes(pages: DataFrame) -> DataFrame:
    """(page_id, size, nodes) of pages (page_id, url, html): each page's elements and texts (tag #text) as one list in document order.

    at is a node's place in the list, from 1; the held nodes after it are what
    it holds, up is the place of the element around it (0: none). The other
    fields are page_tree's. Pages without nodes have an empty list.
    """

    def batch(ids: list, sizes: list, offsets: list, rows: list) -> pa.RecordBatch:
        *places, marks, texts, cells = zip(*rows, strict=True) if rows else [()] * (_MARKS + 3)
        columns = [pa.array(c, f.type) for c, f in zip(places, _STRUCT, strict=False)]
        for repeated, first in ((marks, _MARKS), (cells, _CELL)):  # each different one goes to Arrow once
            kinds = {m: k for k, m in enumerate(dict.fromkeys(repeated))}
            at = pa.array([kinds[m] for m in repeated], pa.int32())
            of = zip(*kinds, strict=True) if kinds else [()] * (len(_NO_CELL) if first == _CELL else len(_TEXT))
            columns += [pa.array(c, _STRUCT[first + k].type).take(at) for k, c in enumerate(of)]
            if first == _MARKS:
                columns.append(pa.array(texts, pa.string()))
        nodes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_STRUCT)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), nodes], ["page_id", "size", "nodes"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, sizes, offsets, rows = [], [], [0], []
            for i, url, html in zip(*part.columns, strict=True):
                nodes, size = tree_of(html.as_py(), url.as_py())
                rows += nodes
                ids.append(i.as_py())
                sizes.append(size)
                offsets.append(len(rows))
                if len(rows) >= _MOST_NODES:
                    yield batch(ids, sizes, offsets, rows)
                    ids, sizes, offsets, rows = [], [], [0], []
            if ids:
                yield batch(ids, sizes, offsets, rows)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, f"page_id long, size long, nodes array<struct<{re.sub(r'(\w+) (\w+)', r'\1:\2', _NODE)}>>")


def page_tree(pages: DataFrame) -> DataFrame:
    """Rows of pages (page_id, url, html), one for each element and each text (tag #text).

    open and close are nested-set numbers from 1 (equal for texts and elements
    without an end), size the page's last number, parent the parent's open (0:
    none). Cells have their table (tab), row, column and spans. End tags
    without a beginning are skipped, elements left open end with what holds
    them. Null and empty pages have no rows.
    """
    return page_nodes(pages).select("page_id", "size", F.inline("nodes"))


def by_page(tree: DataFrame) -> DataFrame:
    """A tree as (page_id, nodes), whether it is page_nodes' lists or page_tree's rows."""
    if "nodes" in tree.columns:
        return tree.select("page_id", "nodes")
    return tree.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*_COLUMNS))).alias("nodes"))


def within(nodes: Column, x: Column) -> Column:
    """The nodes that an element holds, at the cost of these alone."""
    return F.slice(nodes, x["at"] + 1, x["held"])


def holds(x: Column, y: Column) -> Column:
    return (x["at"] < y["at"]) & (y["at"] <= x["at"] + x["held"])


def filled(text: Column) -> Column:
    return F.when(text != "", text)


def text_of(nodes: Column, x: Column, by: str = " ") -> Column:
    """The text in an element, null without any."""
    return filled(F.array_join(within(nodes, x)["text"], by))


def links_of(nodes: Column, x: Column, url: str = ".") -> Column:
    """The links in an element that match, in order, with their names."""
    found = F.filter(within(nodes, x), lambda y: (y["tag"] == "a") & y["url"].rlike(url))
    return F.transform(found, lambda y: F.struct(text_of(nodes, y).alias("name"), y["url"].alias("url")))


def around(nodes: Column, x: Column, which: Callable[[Column], Column]) -> Column:
    """The innermost element around a node that fits, else null; one step for each element around it."""
    node = lambda at: F.get(nodes, at - 1)
    steps = F.sequence(F.lit(0), x["depth"])  # the last finds nothing new
    return node(F.aggregate(steps, x["up"], lambda at, _: F.when((at == 0) | F.coalesce(which(node(at)), F.lit(False)), at).otherwise(node(at)["up"])))


def own_parts(nodes: Column, x: Column, element: Callable[[Column], Column], part: Callable[[Column], Column]) -> Column:
    """The parts in an element that stand in no other such element within it, in order."""
    inner = F.filter(within(nodes, x), lambda y: (y["held"] > 0) & element(y))
    return let(inner, lambda i: F.filter(within(nodes, x), lambda y: part(y) & ~F.exists(i, lambda z: holds(z, y))))


def has_class(name: str, column: str | Column = "cls") -> Column:
    """Whether a class is among an element's classes."""
    return F.array_contains(F.split(F.coalesce(column, F.lit("")), r"\s+"), name)


def of_class(x: Column, name: str) -> Column:
    """The same for a node; most are told by the plain search."""
    return F.coalesce(x["cls"].contains(name), F.lit(False)) & has_class(name, x["cls"])


def inside(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points with the columns of each span (page_id, s_open, s_close, ...) of the page that holds them."""
    return enclosing(points, spans, PAGE, "open", "s_open", "s_close", "size")


def spans(elements: DataFrame, *extra: str | Column) -> DataFrame:
    return elements.select("page_id", F.col("open").alias("s_open"), F.col("close").alias("s_close"), *extra)


def text_in(tree: DataFrame, elements: DataFrame, own: bool = False, by: str = " ") -> DataFrame:
    """(page_id, open, text) of elements that hold any text; own leaves out the text of elements of the list within them."""
    words = tree.where("tag = '#text'").select("page_id", "open", "size", "text")
    if own:
        held = words.join(nearest(words, spans(elements), PAGE, "open", "s_open", "s_close", "size"), ["page_id", "open"])
    else:
        held = inside(words, spans(elements))
    parts = F.sort_array(F.collect_list(F.struct("open", "text")))
    return held.groupBy("page_id", "s_open").agg(parts.alias("p")).select("page_id", F.col("s_open").alias("open"), F.array_join(F.transform("p", lambda x: x["text"]), by).alias("text"))


def links_in(tree: DataFrame, elements: DataFrame, url: str = ".") -> DataFrame:
    """(page_id, open, links): the links inside each element that match, in order, with their names."""
    a = tree.where(F.col("tag") == "a").where(F.col("url").rlike(url))
    named = a.select("page_id", "open", "size", "url").join(text_in(tree, a).withColumnRenamed("text", "name"), ["page_id", "open"], "left")
    held = inside(named, spans(elements)).groupBy("page_id", "s_open").agg(F.sort_array(F.collect_list(F.struct("open", "name", "url"))).alias("l"))
    return held.select("page_id", F.col("s_open").alias("open"), F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["url"].alias("url"))).alias("links"))


def first_of(elements: DataFrame, parts: DataFrame) -> DataFrame:
    """(page_id, open, part): the first of the parts that stand in an element and in no other of them within it."""
    owner = nearest(parts, spans(elements), PAGE, "open", "s_open", "s_close", "size")
    return owner.groupBy("page_id", "s_open").agg(F.min("open").alias("part")).select("page_id", F.col("s_open").alias("open"), "part")


def first_text(tree: DataFrame, elements: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """(page_id, open, name): the text of each element's first part, null if that has none."""
    words = text_in(tree, parts).select("page_id", F.col("open").alias("part"), F.col("text").alias(name))
    return first_of(elements, parts).join(words, ["page_id", "part"], "left").select("page_id", "open", name)


def next_sibling(tree: DataFrame, tag: str) -> DataFrame:
    """(page_id, open, n_open, n_close): for each element, the first sibling after it with the tag."""
    w = Window.partitionBy("page_id", "parent").orderBy("open").rowsBetween(1, Window.unboundedFollowing)
    found = F.first(F.when(F.col("tag") == tag, F.struct("open", "close")), ignorenulls=True).over(w)
    return tree.where("tag <> '#text'").select("page_id", "open", found.alias("n")).where("n is not null").select("page_id", "open", F.col("n.open").alias("n_open"), F.col("n.close").alias("n_close"))


def cells(tree: DataFrame) -> DataFrame:
    """(page_id, open, tab, row, col, wide, high, tag, text, links) of every table cell; a cell's text is without that of cells inside it."""
    td = tree.where("tab is not null")
    return td.select("page_id", "open", "tab", "row", "col", "wide", "high", "tag").join(text_in(tree, td, own=True), ["page_id", "open"], "left").join(links_in(tree, td), ["page_id", "open"], "left")


def records(tree: DataFrame) -> DataFrame:
    """(page_id, tab, row, name, text, links): each cell below a table's heading with the heading's text.

    A heading is a th, in any row of its own; where a table has no th, the
    first row's cells are its headings. Cells that reach over several columns
    or rows count in each; headings of several rows are joined, upper first.
    Cells under no heading have a null name.
    """
    c = cells(tree)
    heads = Window.partitionBy("page_id", "tab")
    c = c.withColumn("any_th", F.bool_or(F.col("tag") == "th").over(heads)).withColumn("data_row", F.bool_or(F.col("tag") == "td").over(Window.partitionBy("page_id", "tab", "row")))
    is_head = F.when(F.col("any_th"), (F.col("tag") == "th") & ~F.col("data_row")).otherwise(F.col("row") == 0)
    c = c.withColumn("head", is_head)
    columns = lambda df: df.withColumn("at", F.explode(F.sequence("col", F.col("col") + F.col("wide") - 1)))
    names = columns(c.where("head")).groupBy("page_id", "tab", "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("row", "text")))), lambda x: x["text"]), " / ").alias("name"))
    down = columns(c.where("not head")).withColumn("in_row", F.explode(F.sequence("row", F.col("row") + F.least(F.col("high"), F.lit(1000)) - 1)))
    last = c.groupBy("page_id", "tab").agg(F.max("row").alias("last"))
    body = down.join(last, ["page_id", "tab"]).where("in_row <= last")
    return body.join(names, ["page_id", "tab", "at"], "left").select("page_id", "tab", F.col("in_row").alias("row"), F.nullif("name", F.lit("")).alias("name"), "text", "links")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first(of: Column) -> Column:
    return F.get(of, F.lit(0))


def last(of: Column) -> Column:
    return F.try_element_at(of, F.lit(-1))


def rows_in(cells: Column) -> Column:
    """The cells of one table as a list for each row that has any."""
    starts = F.filter(F.transform(cells, lambda c, i: F.when((i == 0) | (F.get(cells, i - 1)["row"] != c["row"]), i)), lambda i: i.isNotNull())
    return let(starts, lambda s: F.transform(s, lambda i, k: F.slice(cells, i + 1, F.coalesce(F.get(s, k + 1), F.size(cells)) - i)))


def each(pages: DataFrame, items: Column) -> DataFrame:
    """A row for each of a page's items."""
    return pages.select("page_id", F.explode_outer(items).alias("i")).where("i is not null").select("page_id", "i.*")
