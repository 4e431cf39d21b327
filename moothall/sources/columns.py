"""Nodes of many pages as columns: what structure.page_nodes says of a page, for a lot of pages at once, as NumPy and Arrow arrays.

Tags are cut out of the pages' bytes, and each different one is read once.
Ends are found by a sort by level, once the implied ones of cells, rows and
entries are filled in; pages on which that fails are walked tag by tag, and
pages that aren't plain go through structure's parser.
What stands in what is a search among sorted places, so that a layout costs a
few searches a lot, whatever a page holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moothall.sources import structure

#: A lot ends with the page that reaches so many bytes of HTML, or so many nodes.
_MOST_BYTES, _MOST_NODES = 1_000_000, 50_000
_OPEN, _VOID, _END, _SKIP = range(4)
_LINK = pa.struct([("name", pa.string()), ("url", pa.string())])


class Mark(NamedTuple):
    """What a tag says of its element; wide and high are a cell's spans, else 0."""

    tag: str
    id: str | None
    cls: str | None
    style: str | None
    url: str | None
    key: str | None
    wide: int = 0
    high: int = 0

    def has(self, name: str) -> bool:
        """Whether a class is among the element's classes."""
        return name in (self.cls or "") and name in re.split(r"[ \t\n\x0b\f\r]+", self.cls)


Test = Callable[[Mark], bool]


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of lists, and their entries: the numbers from each lo up to each hi."""
    n = np.maximum(hi - lo, 0)
    offsets = np.concatenate([[0], np.cumsum(n)])
    return offsets, np.arange(offsets[-1]) + np.repeat(lo - offsets[:-1], n)


def places(at: np.ndarray) -> pa.Array:
    """Places to take from an array, null for -1."""
    return pa.array(at, pa.int64(), mask=at < 0)


def lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def joined(texts: pa.Array, lo: np.ndarray, hi: np.ndarray, by: str = " ") -> pa.Array:
    """The texts from each lo up to each hi as one, null where there are none."""
    if not len(lo) or (hi - lo).max() <= 1:
        return texts.take(places(np.where(hi > lo, lo, -1)))
    offsets, at = spread(lo, hi)
    return pc.if_else(pa.array(hi > lo), pc.binary_join(lists(offsets, texts.take(pa.array(at))), by), pa.scalar(None, pa.string()))


def first_of(owners: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each of an ascending list, the first place at which it is an owner, else -1."""
    kept = np.flatnonzero(owners >= 0)
    order = kept[np.argsort(owners[kept], kind="stable")]
    found = owners[order]
    at = np.searchsorted(found, of)
    hit = at < len(found)
    hit[hit] = found[at[hit]] == of[hit]
    out = np.full(len(of), -1)
    out[hit] = order[at[hit]]
    return out


class Nodes:
    """Nodes of a lot of pages in document order: of each its page's number, how many nodes after it it holds, its opening's number in the page, and its mark (-1: a text). words are the texts' places."""

    def __init__(self, pages: int, page: np.ndarray, held: np.ndarray, opened: np.ndarray, code: np.ndarray, marks: list[Mark], words: np.ndarray, texts: pa.Array) -> None:
        self.pages, self.page, self.held, self.opened, self.code, self.marks, self.words, self.texts = pages, page, held, opened, code, marks, words, texts

    def __len__(self) -> int:
        return len(self.page)

    def by_mark(self, value: Callable[[Mark], object], at: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
        """A value of the marks of elements (null for -1), worked out once for each mark."""
        return pa.array([value(m) for m in self.marks], kind or pa.string()).take(places(np.where(at < 0, -1, self.code[at] if len(self) else at)))

    def fits(self, test: Test) -> np.ndarray:
        """Whether each node is an element that fits."""
        return np.array([*(bool(test(m)) for m in self.marks), False])[self.code]

    def where(self, test: Test) -> np.ndarray:
        """The places of elements that fit."""
        return np.flatnonzero(self.fits(test))

    def tagged(self, *tags: str) -> np.ndarray:
        return self.where(lambda m: m.tag in tags)

    def owner(self, points: np.ndarray, elements: np.ndarray) -> np.ndarray:
        """The innermost of the elements (ascending) around each point, else -1."""
        if not len(elements) or not len(points):
            return np.full(len(points), -1)
        begun = self._before(elements)
        around = begun - self._before(elements + self.held[elements])
        level, around = around[elements], around[points]
        if level.any():  # the last of its level before the point
            order = np.argsort(level, kind="stable")
            key = level[order] * (len(self) + 1) + elements[order]
            at = order[np.maximum(np.searchsorted(key, (around - 1) * (len(self) + 1) + points) - 1, 0)]
        else:
            at = np.maximum(begun[points] - 1, 0)
        return np.where(around > 0, elements[at], -1)

    def _before(self, at: np.ndarray) -> np.ndarray:
        """How many of these places are before each node's, and before the end."""
        return np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self)))])

    @cached_property
    def up(self) -> np.ndarray:
        """The element around each node, else -1."""
        return self.owner(np.arange(len(self)), np.flatnonzero(self.held > 0))

    def inside(self, elements: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the points (ascending) that each element holds begin and end; none for -1."""
        if not len(self):
            return np.zeros_like(elements), np.zeros_like(elements)
        before = self._before(points)
        lo = before[elements + 1]
        return lo, np.where(elements < 0, lo, before[elements + self.held[elements] + 1])

    def text(self, elements: np.ndarray) -> pa.Array:
        """The text in each element, null without any and for -1."""
        return joined(self.texts, *self.inside(elements, self.words))

    def own_text(self, elements: np.ndarray, among: np.ndarray, kept: np.ndarray | None = None) -> pa.Array:
        """The text in each element that is in no other of a list within it; kept picks words."""
        owner = self.owner(self.words, among)
        if kept is not None:
            owner = np.where(kept, owner, -1)
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        return joined(self.texts.take(pa.array(order)), np.searchsorted(owner, elements), np.searchsorted(owner, elements, "right"))

    @cached_property
    def links(self) -> np.ndarray:
        return self.where(lambda m: m.tag == "a" and bool(m.url))

    def named(self, links: np.ndarray, empty: str | None = None) -> pa.Array:
        """(name, url) of links."""
        name = self.text(links)
        return pa.StructArray.from_arrays([name if empty is None else pc.fill_null(name, empty), self.by_mark(lambda m: m.url, links)], fields=list(_LINK))

    def links_in(self, elements: np.ndarray) -> pa.ListArray:
        offsets, at = spread(*self.inside(elements, self.links))
        return lists(offsets, self.named(self.links[at]))

    def nth(self, elements: np.ndarray) -> np.ndarray:
        """Each element's number among its page's (ascending), from 1."""
        page = self.page[elements]
        return np.arange(len(elements)) - np.searchsorted(page, page) + 1

    def by_page(self, elements: np.ndarray, values: pa.Array) -> pa.ListArray:
        """Values of elements (ascending) as a list for each page."""
        return lists(np.searchsorted(self.page[elements], np.arange(self.pages + 1)), values)

    @cached_property
    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Table cells in the order of tables and places: place, table, row, column and spans."""
        tables, far = self.tagged("table"), len(self) + 1
        at = self.where(lambda m: m.wide > 0)
        tab = self.owner(at, tables)
        at, tab = at[tab >= 0], tab[tab >= 0]
        order = np.argsort(tab, kind="stable")
        at, tab = at[order], tab[order]
        spans = np.array([(m.wide, m.high) for m in self.marks] or [(0, 0)])[self.code[at]] if len(at) else np.zeros((0, 2), int)
        wide, high = spans[:, 0], spans[:, 1]
        rows = self.tagged("tr")
        of = self.owner(rows, tables)
        begun = np.sort(of[of >= 0] * far + rows[of >= 0])
        nth = np.searchsorted(begun, tab * far + at) - np.searchsorted(begun, tab * far)
        row = np.maximum(nth - 1, 0)
        before = np.concatenate([[0], np.cumsum(wide)])[:-1]
        new = np.ones(len(at), bool)
        new[1:] = (tab[1:] != tab[:-1]) | (nth[1:] != nth[:-1])
        col = before - before[np.flatnonzero(new)][np.cumsum(new) - 1] if len(at) else before
        tall = np.unique(tab[high > 1])
        for lo, hi in zip(np.searchsorted(tab, tall), np.searchsorted(tab, tall, "right"), strict=True):  # cells reach over others
            grid, passed = structure._Grid(0), 0
            for k in range(lo, hi):
                while passed < nth[k]:
                    grid.next_row()
                    passed += 1
                row[k], col[k] = grid.place(int(wide[k]), int(high[k]))
        return at, tab, row, col, wide, high


def _of_rows(pages: int, page: np.ndarray, held: np.ndarray, opened: np.ndarray, marks: list[tuple], texts: list[str | None]) -> Nodes:
    """Nodes of rows with marks as the parser gives them, with a cell's spans."""
    codes: dict[tuple, int] = {}
    code = np.array([-1 if t is not None else codes.setdefault(m, len(codes)) for m, t in zip(marks, texts, strict=True)], np.int64)
    return Nodes(pages, page, held, opened, code, [Mark(*m) for m in codes], np.flatnonzero(code < 0), pa.array([t for t in texts if t is not None], pa.string()))


def of_lists(nodes: pa.ListArray) -> Nodes:
    """Nodes of pages that are lists of them, as of structure.page_nodes."""
    lengths = pc.fill_null(pc.list_value_length(nodes), 0).to_numpy()
    flat = nodes.flatten()
    spans = [pc.fill_null(flat.field(c), 0) for c in ("wide", "high")]
    marks = zip(*(a.to_pylist() for a in (*(flat.field(c) for c in ("tag", "id", "cls", "style", "url", "key")), *spans)), strict=True)
    numbers = (flat.field(c).to_numpy().astype(np.int64) for c in ("held", "open"))
    return _of_rows(len(nodes), np.repeat(np.arange(len(nodes)), lengths), *numbers, list(marks), flat.field("text").to_pylist())


def _parsed(html: list[str], urls: list[str]) -> Nodes:
    """Nodes of pages of any kind, by structure's parser."""
    rows = [(k, *row) for k, (h, u) in enumerate(zip(html, urls, strict=True)) for row in structure.tree_of(h, u)[0]]
    number = lambda k: np.array([r[k + 1] for r in rows], np.int64)
    marks = [(*r[structure._MARKS + 1], *(r[-1][3:5] if r[-1][0] is not None else (0, 0))) for r in rows]
    return _of_rows(len(html), np.array([r[0] for r in rows], np.int64), number(structure._HELD), number(structure._COLUMNS.index("open")), marks, [r[-2] for r in rows])


def _walk(kinds: list[int], names: list[int], rules: list[tuple[frozenset, frozenset] | None], first: int, stop: int, close: list[int]) -> None:
    """Finds where a page's elements end, tag by tag; rules say by name what a tag ends, and within what."""
    opened, path, count = [], [], [0] * len(rules)
    for i in range(first, stop):
        kind, name = kinds[i], names[i]
        if kind == _OPEN:
            if rule := rules[name]:
                ended, within = rule
                last = 0
                if count[-1]:
                    for k in range(1, len(path) + 1):
                        if path[-k] in within:
                            break
                        if path[-k] in ended:
                            last = k
                while last:
                    last -= 1
                    close[opened.pop()] = i
                    other = path.pop()
                    count[other] -= 1
                    count[-1] -= rules[other] is not None
                count[-1] += 1
            opened.append(i)
            path.append(name)
            count[name] += 1
        elif kind == _END and count[name]:
            other = None
            while other != name:
                close[opened.pop()] = i
                other = path.pop()
                count[other] -= 1
                if rules[other]:
                    count[-1] -= 1
    for k in opened:
        close[k] = stop


def _small(level: np.ndarray) -> np.ndarray:
    """Levels in two bytes where these hold them, which NumPy sorts by digits."""
    return level.astype(np.int16) if len(level) and -(1 << 15) < int(level.min()) and int(level.max()) < 1 << 15 else level


def _levels(kind: np.ndarray, name: np.ndarray, names: list[str], first: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each opening tag the end tag of its level, and the pages where that isn't right: an end is missing, or not its element's own, or implied."""
    n = len(kind)
    close = np.full(n, n)
    depth = np.concatenate([[0], np.cumsum((kind == _OPEN).astype(np.int64) - (kind == _END))])
    odd = depth[first[1:]] != depth[first[:-1]]
    level = depth[1:] - depth[first[:-1]][page] + (kind == _END)
    odd[page[(kind == _END) & (level < 1)]] = True
    tags = np.flatnonzero(((kind == _OPEN) | (kind == _END)) & ~odd[page])
    level = _small(level)
    order = tags[np.argsort(level[tags], kind="stable")]
    a, b = order[0::2], order[1::2]
    close[a] = b
    odd[page[a[name[a] != name[b]]]] = True
    # An opening tag may end others: those up to the next that keeps them in.
    opens, far = np.sort(a), n + 1
    by_level = np.argsort(level[opens], kind="stable")
    key = level[opens][by_level].astype(np.int64) * far + opens[by_level]
    for tag, (ended, within) in structure._ENDS.items():
        if tag in names:
            stops, ends = (np.array([x in s for x in names]) for s in (within, ended))
            at = opens[name[opens] == names.index(tag)]
            up = level[at].astype(np.int64) - 1
            while len(at):
                at, up = at[up > 0], up[up > 0]
                around = opens[by_level[np.searchsorted(key, up * far + at) - 1]]
                odd[page[at[ends[name[around]] & ~stops[name[around]]]]] = True
                on = ~stops[name[around]] & ~ends[name[around]]
                at, up = at[on], up[on] - 1
    return close, odd


#: What keeps entries in, the entries, and tags beside their own that end them; those within others come first.
_FAMILIES = (("table",), ("td", "th"), ("tr",)), (("table",), ("tr",), ()), (("ul", "ol"), ("li",), ())


def _implied(kind: np.ndarray, name: np.ndarray, names: list[str], page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of cells, rows and entries of lists that are left to the next one: the tags before which they stand, and their names. They are guesses, to be tested by level."""
    begun = np.searchsorted(page, np.arange(page[-1] + 1))
    found, called = [], []
    for outer, inner, others in _FAMILIES:
        ids = [np.array([x in s for x in names])[name] for s in (outer, inner, others)]
        step = ids[0] * ((kind == _OPEN).astype(np.int64) - (kind == _END))
        level = np.cumsum(step) + (step < 0)
        level -= (np.cumsum(step) - step)[begun][page]
        at = np.flatnonzero((ids[0] | ids[1] | ids[2]) & ((kind == _OPEN) | (kind == _END)))
        if len(at):
            at = at[np.argsort(_small(level[at]), kind="stable")]
            here, then = at, np.append(at[1:], at[0])
            alone = np.append((level[at[1:]] != level[at[:-1]]) | (page[at[1:]] != page[at[:-1]]), True)
            left = ids[1][here] & (kind[here] == _OPEN) & (alone | ~(ids[1][then] & (kind[then] == _END)))
            here, then, alone = here[left], then[left], alone[left]
            then[alone] = np.append(begun[1:], len(page))[page[here[alone]]]
            found.append(then)
            called.append(name[here])
    return (np.concatenate(found), np.concatenate(called)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _ends(kind: np.ndarray, name: np.ndarray, names: list[str], first: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each opening tag, the tag before which its element has ended: by levels, of pages with implied ends once these are filled in, else by a walk."""
    close, odd = _levels(kind, name, names, first, page)
    if odd.any():
        part = np.flatnonzero(odd[page])
        at, called = _implied(kind[part], name[part], names, page[part])
        of = np.append(part, len(kind))
        pages = np.insert(page[part], at, page[part][np.maximum(at - 1, 0)])
        real = np.insert(of[:-1], at, of[at])
        own = np.insert(np.ones(len(part), bool), at, False)
        kinds = np.insert(kind[part], at, _END)
        ends, still = _levels(kinds, np.insert(name[part], at, called), names, np.searchsorted(pages, np.arange(len(first))), pages)
        good = own & (kinds == _OPEN) & ~still[pages]
        close[real[good]] = np.minimum(real[ends[good]], first[pages[good] + 1])
        odd &= still
    if odd.any():
        number = {x: k for k, x in enumerate(names)}
        rules = [tuple(frozenset(number[x] for x in xs if x in number) for xs in structure._ENDS[x]) if x in structure._ENDS else None for x in names] + [None]  # the last is the count of all that have rules
        kinds, named, ends = kind.tolist(), name.tolist(), close.tolist()
        for k in np.flatnonzero(odd).tolist():
            _walk(kinds, named, rules, int(first[k]), int(first[k + 1]), ends)
        close = np.array(ends, np.int64)
    return close


def _plain(html: pa.StringArray, urls: list[str]) -> tuple[np.ndarray, Nodes | None]:
    """Which pages are plain, and the nodes of all if all are."""
    pages = len(html)
    starts = np.frombuffer(html.buffers()[1], np.int32)[html.offset : html.offset + pages + 1].astype(np.int64)
    data = np.frombuffer(html.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    starts = starts - starts[0]
    lt, gt = np.flatnonzero(data == ord("<")), np.flatnonzero(data == ord(">"))
    full = np.flatnonzero(starts[1:] > starts[:-1])
    ok = np.ones(pages, bool)
    ok[full] = data[starts[full]] == ord("<")
    page = np.repeat(np.arange(pages), np.diff(np.searchsorted(lt, starts)))
    stop = np.minimum(np.append(lt[1:], len(data))[: len(lt)], starts[page + 1])
    in_turn = len(lt) == len(gt) and (lt < gt).all() and (gt[:-1] < lt[1:]).all()
    end = gt if in_turn else np.append(gt, len(data))[np.searchsorted(gt, lt)]
    ok[page[end >= stop]] = False
    amp = np.flatnonzero(data == ord("&"))
    if len(amp):
        tag = np.searchsorted(lt, amp, "right") - 1
        said = (tag < 0) | (amp > end[np.maximum(tag, 0)] if len(lt) else True)
        ok[np.searchsorted(starts, amp[said], "right") - 1] = False
    if not ok.all():
        return ok, None
    # Tags and the texts behind them, in turn.
    offsets = np.empty(2 * len(lt) + 1, np.int32)
    offsets[0:-1:2], offsets[1::2], offsets[-1] = lt, end + 1, len(data)
    pieces = pa.StringArray.from_buffers(2 * len(lt), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    tags = pieces.take(pa.array(np.arange(0, 2 * len(lt), 2))).dictionary_encode()
    code, sources = tags.indices.to_numpy(zero_copy_only=False).astype(np.int64), tags.dictionary.to_pylist()
    bases = {u: k for k, u in enumerate(dict.fromkeys(urls))}
    if len(bases) > 1:
        pairs, code = np.unique(np.array([bases[u] for u in urls])[page] * len(sources) + code, return_inverse=True)
    else:
        pairs = np.arange(len(sources))
    base_of, read, names = list(bases), [], {}
    for k in pairs.tolist():
        base, source = base_of[k // len(sources)], sources[k % len(sources)]
        known = structure._tags(base)
        if (tag := known.get(source[1:-1])) is None:
            if len(known) >= structure._MOST_TAGS:
                known.clear()
            tag = known[source[1:-1]] = structure._plain_tag(base, source[1:-1]) or ()
        read.append((_SKIP, "", None) if source == structure._DOCTYPE else (-1, "", None) if not tag else (_END if tag[1] is None else _VOID if tag[5] else _OPEN, tag[0], tag[1] and Mark(*tag[1], *tag[3:5])))
    kind = np.array([k for k, _, _ in read], np.int64)[code]
    name = np.array([names.setdefault(x, len(names)) for _, x, _ in read], np.int64)[code]
    ok[page[kind < 0]] = False
    ok[page[(kind == _SKIP) & (lt != starts[page])]] = False
    if not ok.all():
        return ok, None
    at = np.flatnonzero(stop > end + 1)
    texts = pieces.take(pa.array(2 * at + 1))
    lo, hi = end[at] + 1, stop[at]
    blank = data == ord(" ")
    strange = (data < 32) | (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))  # what white space other than a single blank may begin with
    strange[1:] |= blank[1:] & blank[:-1]
    loose = blank[lo] | blank[hi - 1] if len(at) else np.zeros(0, bool)
    strange = np.flatnonzero(strange)
    of = np.searchsorted(lo, strange, "right") - 1
    within = of >= 0
    within[within] = strange[within] < hi[of[within]]
    loose[of[within]] = True
    if loose.any():
        texts = pc.replace_with_mask(texts, pa.array(loose), pa.array([" ".join(t.split()) for t in texts.filter(pa.array(loose)).to_pylist()], pa.string()))
        some = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        at, texts = at[some], texts.filter(pa.array(some))
    element = (kind == _OPEN) | (kind == _VOID)
    said = np.zeros(len(lt), bool)
    said[at] = True
    before = np.concatenate([[0], np.cumsum(element.astype(np.int64) + said)])
    first = np.searchsorted(page, np.arange(pages + 1))
    close = _ends(kind, name, list(names), first, page)
    nodes = int(before[-1])
    held, opened, marked, of = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.full(nodes, -1), np.zeros(nodes, np.int64)
    opens = np.flatnonzero(kind == _OPEN)
    held[before[opens]] = before[close[opens]] - before[opens] - 1
    tag_at, word_at = before[:-1][element], before[:-1][at] + element[at]
    marked[tag_at], of[tag_at], of[word_at] = code[element], page[element], page[at]
    ended = opens[close[opens] < first[page[opens] + 1]]
    closes = np.cumsum(np.bincount(close[ended], minlength=len(lt) + 1))
    earlier = np.concatenate([[0], closes])[first[:-1]]
    opened[tag_at], opened[word_at] = closes[:-1][element], closes[:-1][at]
    opened += np.arange(nodes) + 1 - before[first[:-1]][of] - earlier[of]
    marks = [m or Mark("", *(None,) * 5) for _, _, m in read]
    return ok, Nodes(pages, of, held, opened, marked, marks, word_at, texts)


def of_pages(html: pa.Array, urls: pa.Array) -> Iterator[tuple[np.ndarray, Nodes]]:
    """Nodes of pages, with the pages' numbers: the plain ones at once, the others through the parser."""
    html, urls = pc.fill_null(html.cast(pa.string()), ""), [u or "" for u in urls.to_pylist()]
    rest, none = np.arange(len(html)), []
    while len(rest):
        part = html.take(pa.array(rest)) if len(rest) < len(html) else html
        ok, nodes = _plain(part, [urls[k] for k in rest.tolist()])
        if nodes is not None:
            yield rest, nodes
            break
        none += rest[~ok].tolist()
        rest = rest[ok]
    if none:
        yield np.array(none), _parsed(html.take(pa.array(none)).to_pylist(), [urls[k] for k in none])


def layout(tree: DataFrame, read: Callable[[Nodes], tuple[np.ndarray | None, dict[str, pa.Array]]], fields: str) -> DataFrame:
    """Rows (page_id and fields) that a reader finds in lots of pages (page_id, url, html), of pages' lists of nodes, or of nodes' rows.

    The reader gives the rows' pages, or None where each page has one row.
    """

    def found(ids: pa.Array, nodes: Nodes) -> pa.RecordBatch:
        page, columns = read(nodes)
        return pa.RecordBatch.from_pydict({"page_id": ids if page is None else ids.take(pa.array(page)), **columns})

    def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
        lo, total = 0, np.cumsum(sizes)
        while lo < len(sizes):
            hi = max(int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most)) + 1, lo + 1)
            yield lo, min(hi, len(sizes)) - lo
            lo = hi

    def of_html(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, n in cuts(pc.fill_null(pc.binary_length(part["html"]), 0).to_numpy(zero_copy_only=False), _MOST_BYTES):
                lot = part.slice(lo, n)
                for at, nodes in of_pages(lot["html"], lot["url"]):
                    yield found(lot["page_id"].take(pa.array(at)), nodes)

    def of_trees(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, n in cuts(pc.fill_null(pc.list_value_length(part["nodes"]), 0).to_numpy(zero_copy_only=False), _MOST_NODES):
                lot = part.slice(lo, n)
                yield found(lot["page_id"], of_lists(lot["nodes"]))

    schema = f"page_id long, {fields}"
    if "html" in tree.columns:
        return tree.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(of_html, schema)
    return structure.by_page(tree).select(F.col("page_id").cast("long"), "nodes").mapInArrow(of_trees, schema)
