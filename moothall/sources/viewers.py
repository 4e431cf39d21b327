"""Agenda pages whose meaning lies in their structure: nested viewers, grids, tables by heading, positioned spans, and the choice of a layout."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moothall.sources import structure
from moothall.sources.columns import Mark, Nodes, first_of, joined, layout, lists, places, spread
from moothall.sources.structure import around, by_page, each, first, let, links_of

#: Headings of sections, and entries that are no items.
SECTIONS = (
    "CONSENT AGENDA", "CONSENT CALENDAR", "PUBLIC HEARINGS", "LEASES/CONTRACTS/LEGAL", "CONTRACT MODIFICATIONS", "CONSIDERATION OF BIDS/PURCHASES/REQUESTS FOR PROPOSALS", "ANNOUNCEMENTS/REPORTS/MOTIONS", "OTHER BUSINESS", "OLD BUSINESS", "NEW BUSINESS", "UNFINISHED BUSINESS", "BUSINESS",
)
PROCEDURAL = ("call meeting to order", "call to order", "call roll", "roll call", "pledge of allegiance", "adjourn", "adjournment", "other business")
_DASH = "–—"


def viewer_items(tree: DataFrame) -> DataFrame:
    """(page_id, open, number, section, title, attachments) of pages where an item is a small table and its documents stand in the block quote after it.

    The table's first row is number and title; an entry whose title ends in a
    colon or dash, is empty or a known heading is a section, and tables inside
    the quote after it are its items, numbered below it. Other items have the
    last section before them. Procedural entries, and tables in quotes of
    items, are no items. A quote belongs to the table or else to the div
    around it.
    """
    ends = rf":$|\s[\-{_DASH}]\s*$"

    def read(n: Nodes) -> tuple[np.ndarray, dict[str, pa.Array]]:
        tables, up = n.tagged("table"), n.up
        quotes, far = n.tagged("blockquote"), len(n) + 1
        top_up = lambda at: np.where(up[at] >= 0, up[at], len(n) + n.page[at])
        by_up = np.argsort(top_up(quotes), kind="stable")
        key = top_up(quotes)[by_up] * (far + n.pages) + quotes[by_up]

        def after(at: np.ndarray) -> np.ndarray:
            """The first quote with the same element around it behind each element, else -1."""
            k = np.searchsorted(key, top_up(at) * (far + n.pages) + at)
            found = np.append(quotes[by_up], -1)[k]
            return np.where((found >= 0) & (top_up(found) == top_up(at)), found, -1) if len(n) else found

        def cell_text(col: int) -> pa.Array:
            at, tab, row, column, wide, _ = n.cells
            chosen = (row == 0) & (column == col) & (wide == 1) & n.fits(lambda m: m.tag == "td")[at]
            text = n.text(at[chosen])
            if col:
                text = pc.fill_null(text, "")
            return _greatest(tab[chosen], np.arange(len(text)), text, tables)

        cut = lambda text, *patterns: cut(pc.replace_substring_regex(text, patterns[0], ""), *patterns[1:]) if patterns else text
        number = pc.utf8_rtrim(cut(cell_text(0), r"\.+$"), " ")
        title = pc.utf8_trim(cut(cell_text(1), r"^\[CA\]\s*", r"(?s)\s*ACTION:.*$"), " ")
        length = pc.fill_null(pc.utf8_length(number), 0).to_numpy(zero_copy_only=False)
        entry = (length >= 1) & (length <= 5) & title.is_valid().to_numpy(zero_copy_only=False)
        at, number, title = tables[entry], number.filter(pa.array(entry)), title.filter(pa.array(entry))
        box = n.fits(lambda m: m.tag == "div")
        own = after(at)
        around = np.where((up[at] >= 0) & box[up[at]], up[at], -1)
        own = np.where(own >= 0, own, np.where(around >= 0, after(np.maximum(around, 0)), -1)) if len(n) else own
        top = n.owner(at, quotes) < 0
        plain = cut(title, r"\s*\(.*\)\s*$", rf"[\s.:,\-{_DASH}]+$")
        bare = cut(title, r"\.+$")
        true = lambda mask: mask.to_numpy(zero_copy_only=False)
        heads = true(pc.match_substring_regex(bare, ends)) | true(pc.equal(title, "")) | true(pc.is_in(pc.utf8_upper(plain), pa.array(SECTIONS)))
        procedural = true(pc.is_in(pc.utf8_lower(bare), pa.array(PROCEDURAL)))
        # Items by the last section before them, and those in a section's quote below it.
        head = np.flatnonzero(top & heads)
        items = np.flatnonzero(top & ~heads & ~procedural)
        k = np.searchsorted(head, items) - 1
        section = np.append(head, -1)[k]
        section = np.where((k >= 0) & (n.page[at[section]] == n.page[at[items]]), section, -1) if len(at) else section
        below = np.flatnonzero(~top & true(pc.not_equal(title, "")))
        heading = head[own[head] >= 0]
        order = np.argsort(own[heading], kind="stable")
        heading = heading[order]
        offsets, inner = spread(*n.inside(own[heading], at[below]))
        of, inner = np.repeat(heading, np.diff(offsets)), below[inner]
        take = lambda values, k: values.take(places(k))
        every = np.concatenate([items, inner])
        links = n.where(lambda m: m.tag == "a" and "MetaViewer" in (m.url or ""))
        offsets, papers = spread(*n.inside(own[every], links))
        return n.page[at[every]], {
            "open": pa.array(n.opened[at[every]]), "number": pa.concat_arrays([number.take(pa.array(items)), pc.binary_join_element_wise(number.take(pa.array(of)), number.take(pa.array(inner)), ".")]),
            "section": pa.concat_arrays([take(plain, section), plain.take(pa.array(of))]), "title": title.take(pa.array(every)), "attachments": lists(offsets, pc.fill_null(n.text(links[papers]), "Supporting Document")),
        }

    items = layout(tree, read, "open long, number string, section string, title string, attachments array<string>")
    return items.withColumn("section", F.nullif("section", F.lit("")))


def grid_items(tree: DataFrame) -> DataFrame:
    """(page_id, open, number, section, title, staff, description, attachments) of pages laid out as a grid: cells of div.container with a heading inside.

    An h2 begins a section by its letter, an h3 is an item: its first floating
    span is the number, the second (else the first floating div beside it)
    the title, a link or plain text; brackets after the link are staff. Other
    divs beside it are the description, their documents attachments too.
    """

    def read(n: Nodes) -> tuple[np.ndarray, dict[str, pa.Array]]:
        div, up = n.fits(lambda m: m.tag == "div"), n.up
        box = n.fits(lambda m: m.tag == "div" and m.has("container"))
        cells = n.where(lambda m: m.tag == "div" and "grid-column-start" in (m.style or ""))
        cells = cells[(up[cells] >= 0) & box[up[cells]]]
        divs = np.flatnonzero(div)
        inner = first_of(up[divs], cells)
        inner = divs[inner[inner >= 0]]
        tops = n.tagged("h2", "h3")
        order = np.sort(inner)
        head = first_of(up[tops], order)
        inner, head = order[head >= 0], tops[head[head >= 0]]
        order = np.argsort(head, kind="stable")
        inner, head = inner[order], head[order]
        spans = n.where(lambda m: m.tag == "span" and "float" in (m.style or ""))
        lo, hi = n.inside(head, spans)
        two = [np.append(spans, -1)[np.where(hi - lo > k, lo + k, -1)] for k in range(2)]
        # The divs beside a heading.
        by_inner = np.argsort(inner, kind="stable")
        beside = divs[np.isin(up[divs], inner)]
        of = by_inner[np.searchsorted(inner[by_inner], up[beside])]
        order = np.argsort(of, kind="stable")
        beside, of = beside[order], of[order]
        first, last = n.inside(beside, n.links)
        floats = n.fits(lambda m: "float" in (m.style or ""))[beside]
        other = first_of(np.where(floats & (last > first), of, -1), np.arange(len(head)))
        body = np.where(two[1] >= 0, two[1], np.where(other >= 0, np.append(beside, -1)[other], -1))
        text = n.text(beside)
        long = np.flatnonzero(pc.fill_null(pc.greater(pc.utf8_length(text), 5), False).to_numpy(zero_copy_only=False))
        description = joined(text.take(pa.array(long)), *(np.searchsorted(of[long], np.arange(len(head)), side) for side in ("left", "right")), "\n")
        _, at = spread(first, last)
        more = n.named(n.links[at])
        of = np.repeat(of, last - first)
        number = n.text(two[0])
        known = number.is_valid().to_numpy(zero_copy_only=False)
        letters = head[n.fits(lambda m: m.tag == "h2")[head] & known]
        k = np.searchsorted(letters, head) - 1
        letter = np.where((k >= 0) & (n.page[np.append(letters, 0)[k]] == n.page[head]), np.append(letters, 0)[k], -1) if len(head) else head
        lo, hi = n.inside(body, n.links)
        link = np.append(n.links, -1)[np.where(hi > lo, lo, -1)]
        papers = lists(np.searchsorted(of, np.arange(len(head) + 1)), more)
        kept = np.flatnonzero(n.fits(lambda m: m.tag == "h3")[head] & known)
        a = pa.StructArray.from_arrays([n.text(link[kept]), n.by_mark(lambda m: m.url, link[kept])], ["name", "url"], mask=pa.array(link[kept] < 0))
        return n.page[head[kept]], {
            "open": pa.array(n.opened[head[kept]]), "number": number.take(pa.array(kept)), "letter": number.take(places(np.where(letter >= 0, np.searchsorted(head, letter), -1))).take(pa.array(kept)),
            "said": n.text(body[kept]), "link": a, "description": description.take(pa.array(kept)), "more": papers.take(pa.array(kept)),
        }

    fields = "open long, number string, letter string, said string, link struct<name:string,url:string>, description string, more array<struct<name:string,url:string>>"
    out = layout(tree, read, fields).select(
        "page_id", "open", F.regexp_replace("number", r"[\x{a0}\s]+$", "").alias("number"), F.regexp_replace("letter", r"[.\x{a0}\s]+$", "").alias("section"), "said", "link",
        F.nullif("description", F.lit("")).alias("description"), F.filter("more", lambda x: F.lower(x["url"]).rlike(r"cloudfront\.net|s3\.amazonaws\.com|\.pdf")).alias("papers"),
    )
    title = F.coalesce("link.name", "said")
    rest = F.when(F.col("said").startswith(F.col("link.name")), F.trim(F.col("said").substr(F.length("link.name") + 1, F.length("said"))))
    every = F.array_distinct(F.concat(F.when(F.col("link").isNotNull(), F.array("link")).otherwise(F.slice("papers", 1, 0)), F.col("papers")))
    return out.where(F.coalesce(title, F.lit("")) != "").select("page_id", "open", "number", "section", title.alias("title"), F.nullif(F.regexp_extract(rest, r"^\(([^)]+)\)", 1), F.lit("")).alias("staff"), "description", F.transform(every, lambda x: x["url"]).alias("attachments"))


def detail_attachments(tree: DataFrame) -> DataFrame:
    """(page_id, nth, name, url) of a matter's page: the links of its attachments' own element, else those of documents in the table or div around the first mention of attachments. Links without a name are left out."""
    pages, n = by_page(tree), F.col("nodes")
    own = F.filter(n, lambda x: (x["tag"] == "span") & (x["id"] == "ctl00_ContentPlaceHolder1_lblAttachments2"))
    exact = first(F.filter(F.transform(own, lambda x: links_of(n, x)), lambda links: F.size(links) > 0))
    said = first(F.filter(n, lambda x: x["text"].rlike("(?i)attachments?")))
    cell = let(said, lambda x: around(n, x, lambda z: z["tag"].isin("td", "div", "span", "tr")))
    box = let(cell, lambda x: around(n, x, lambda z: z["tag"].isin("table", "div")))
    near = let(box, lambda x: links_of(n, x, r"(?i)View\.ashx\?"))
    named = F.filter(F.coalesce(exact, near), lambda x: x["name"].isNotNull())
    return each(pages, F.transform(named, lambda x, i: F.struct(i.alias("nth"), x["name"].alias("name"), x["url"].alias("url"))))


def accessible_items(tree: DataFrame) -> DataFrame:
    """(page_id, sequence, number, title, file, attachments) of pages of positioned spans.

    The first span that is a number and a dot gives the class of numbers and
    titles; each such number begins an item, text of that class (or in a span
    of it) up to the word Attachments is its title, a number in brackets such
    as (26-2275) its file. Links after that word, and links to a PDF
    anywhere, are attachments. An item without a title has its number as one.
    """
    is_number, is_mark, has_file = r"^\d+\.$", r"^[Aa][Tt][Tt][Aa][Cc][Hh][Mm][Ee][Nn][Tt][Ss]?\s*:?\s*$", r"\(\d{2}-\d{3,5}\)"

    def read(n: Nodes) -> tuple[np.ndarray, dict[str, pa.Array]]:
        leaf = n.owner(n.words, n.tagged("span", "a"))
        at, text, leaf = n.words[leaf >= 0], n.texts.filter(pa.array(leaf >= 0)), leaf[leaf >= 0]
        matches = lambda pattern: pc.match_substring_regex(text, pattern).to_numpy(zero_copy_only=False)
        span, page, up = n.fits(lambda m: m.tag == "span"), n.page[at], n.up[leaf]
        above = np.where((up >= 0) & span[up], n.code[up], -1)
        # Each page's class, and the words of it: one test for each kind of page and span.
        numbered = span[leaf] & matches(is_number)
        first = first_of(np.where(numbered, page, -1), np.arange(n.pages))
        bold = np.where(first >= 0, n.code[leaf[first]] if len(leaf) else first, -1)
        base = len(n.marks) + 1
        kinds = pa.array(((bold[page] + 1) * base + n.code[leaf] + 1) * base + above + 1).dictionary_encode()

        def in_class(b: int, x: int, y: int) -> bool:
            own = [n.marks[k].cls for k in (x, y) if k >= 0 and n.marks[k].cls is not None]
            return b >= 0 and n.marks[b].cls is not None and re.split(r"\s+", n.marks[b].cls)[0] in re.split(r"\s+", " ".join(own))

        is_bold = np.array([in_class(k // base // base - 1, k // base % base - 1, k % base - 1) for k in kinds.dictionary.to_pylist()], bool)[kinds.indices.to_numpy(zero_copy_only=False)]
        starts = np.flatnonzero(numbered & is_bold)
        ends = np.minimum(np.append(starts[1:], len(at))[: len(starts)], np.searchsorted(page, page[starts], "right"))
        item = np.cumsum(np.isin(np.arange(len(at)), starts)) - 1
        more = (item >= 0) & (np.arange(len(at)) < (ends[item] if len(starts) else 0)) & ~(numbered & is_bold)
        owner = np.where(more, item, -1)
        every = np.arange(len(starts))
        mark = first_of(np.where(matches(is_mark), owner, -1), every)
        late = more & (mark[item] >= 0) & (np.arange(len(at)) >= mark[item]) if len(starts) else more
        title = np.flatnonzero(more & span[leaf] & is_bold & ~late)
        to_pdf = n.fits(lambda m: m.tag == "a" and m.url is not None and ".pdf" in m.url.lower())
        papers = np.flatnonzero(more & (to_pdf[leaf] | late & n.fits(lambda m: m.tag == "a" and m.url is not None)[leaf]))
        named = pa.StructArray.from_arrays([text.take(pa.array(papers)), n.by_mark(lambda m: m.url, leaf[papers])], ["name", "url"])
        file = first_of(np.where(matches(has_file), owner, -1), every)
        return page[starts], {
            "sequence": pa.array(n.nth(at[starts])), "number": text.take(pa.array(starts)), "title": joined(text.take(pa.array(title)), *(np.searchsorted(item[title], every, side) for side in ("left", "right"))), "file": text.take(places(file)),
            "attachments": lists(np.searchsorted(item[papers], np.arange(len(starts) + 1)), named),
        }

    items = layout(tree, read, "sequence long, number string, title string, file string, attachments array<struct<name:string,url:string>>")
    number = F.rtrim(F.regexp_replace("number", r"\.$", ""))
    return items.select("page_id", "sequence", number.alias("number"), F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Item "), number)).alias("title"), F.regexp_extract("file", r"\((\d{2}-\d{3,5})\)", 1).alias("file"), "attachments")


def _greatest(key: np.ndarray, at: np.ndarray, texts: pa.Array, wanted: np.ndarray) -> pa.Array:
    """For each wanted key (ascending) the greatest of its texts, which stand at these places; null without any."""
    some = texts.is_valid().to_numpy(zero_copy_only=False)[at]
    key, at = key[some], at[some]
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    again = np.flatnonzero(key[1:] == key[:-1])
    if len(again):
        best: dict[int, tuple[str, int]] = {}
        for k in np.unique(np.concatenate([again, again + 1])).tolist():
            best[key[k]] = max(best.get(key[k], ("", -1)), (texts[int(at[k])].as_py(), int(at[k])))
        key, first = np.unique(key, return_index=True)
        at = np.array([best[k][1] if k in best else a for k, a in zip(key.tolist(), at[first].tolist(), strict=True)])
    found = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
    return texts.take(places(np.where(key[found] == wanted, at[found], -1) if len(key) else np.full(len(wanted), -1)))


def table_items(tree: DataFrame, number: str = "agenda #", file: str = "file #", title: str = "title", kind: str = "type") -> DataFrame:
    """(page_id, tab, row, number, file, kind, title, url) of tables that have the title's heading: a row is an item, its parts are named by the headings (in either case), wherever the columns stand. Rows without a title are left out.

    Headings are the th of rows that have no td, or the first row where a
    table has no th; those of several rows are joined, upper first. Cells
    count in each column and row that they reach. Of cells of one name in a
    row the greatest text counts, and the greatest address of a first link.
    """
    wanted = {"number": number, "file": file, "kind": kind, "title": title}

    def read(n: Nodes) -> tuple[np.ndarray, dict[str, pa.Array]]:
        at, tab, row, col, wide, high = n.cells
        far = max(len(n), structure._MOST_COLS, structure._MOST_ROWS) * 2 + 1
        among = np.sort(at)
        text = n.own_text(among, among).take(pa.array(np.searchsorted(among, at)))
        th = n.fits(lambda m: m.tag == "th")[at]
        line = tab * far + row
        head = np.where(np.isin(tab, tab[th]), th & ~np.isin(line, line[~th]), row == 0)
        # The names that stand over each column.
        heads = np.flatnonzero(head & text.is_valid().to_numpy(zero_copy_only=False))
        offsets, column = spread(col[heads], col[heads] + wide[heads])
        cell = np.repeat(heads, np.diff(offsets))
        over = tab[cell] * far + column
        order = np.lexsort((row[cell], over))
        over, cell = over[order], cell[order]
        parts = text.take(pa.array(cell)).dictionary_encode()
        called = parts.dictionary.to_pylist() if len(parts) else []
        codes = parts.indices.to_numpy(zero_copy_only=False)
        places_of, begun, count = np.unique(over, return_index=True, return_counts=True)
        first = codes[begun]
        tidy = lambda name: re.sub(r"[:\s]+$", "", name).strip(" ").lower()
        names = [tidy(name) for name in called]
        for k in np.flatnonzero(count > 1).tolist():  # headings of several rows
            several = range(int(begun[k]), int(begun[k] + count[k]))
            first[k] = len(names)
            names.append(tidy(" / ".join(t for _, t in sorted((int(row[cell[i]]), called[codes[i]]) for i in several))))
        columns = {c: places_of[np.array([name == w for name in names] or [False])[first]] if len(first) else places_of for c, w in wanted.items()}
        # What is below them, in each row that it reaches.
        body = np.flatnonzero(~head & np.isin(tab, columns["title"] // far))
        ends = np.flatnonzero(np.append(tab[1:] != tab[:-1], True)) if len(tab) else np.zeros(0, np.int64)
        bottom = np.maximum.reduceat(row, np.append(0, ends[:-1] + 1))[np.searchsorted(tab[ends], tab[body])] if len(body) else row[body]
        offsets, reached = spread(row[body], np.minimum(row[body] + np.minimum(high[body], 1000), bottom + 1))
        cell = np.repeat(body, np.diff(offsets))
        line = tab[cell] * far + reached
        under = {c: np.searchsorted(k, tab[cell] * far + col[cell]) < np.searchsorted(k, tab[cell] * far + col[cell] + wide[cell]) for c, k in columns.items()}
        titled = under["title"] & text.is_valid().to_numpy(zero_copy_only=False)[cell]
        rows = np.unique(line[titled])
        out = {c: _greatest(line[which], cell[which], text, rows) for c, which in under.items()}
        lo, hi = n.inside(at, n.links)
        url = n.by_mark(lambda m: m.url, np.append(n.links, -1)[np.where(hi > lo, lo, -1)])
        of = rows // far
        return n.page[of], {
            "tab": pa.array(n.opened[of]), "row": pa.array(rows % far, pa.int32()), "number": out["number"], "file": out["file"], "kind": out["kind"], "title": out["title"], "url": _greatest(line[under["file"]], cell[under["file"]], url, rows),
        }

    return layout(tree, read, "tab long, row int, number string, file string, kind string, title string, url string")


class Look(NamedTuple):
    """A layout: patterns on an element's step (tag.classes#id~style@key) for an item, and for its title and number inside it."""

    name: str
    item: str
    title: str
    number: str = "$^"


#: Marks by which each layout's items are known; of layouts with as many items an earlier one counts.
LOOKS = (
    Look("wrapped", r"^div\.(?:[^#~@]*\.)?meeting-item(?:[.#~][^@]*)?@", r"^div\.(?:[^#~@]*\.)?agenda-item(?:[.#~@]|$)", r"^td\.(?:[^#~@]*\.)?number-cell(?:[.#~@]|$)"),
    Look("plain", r"^div\.(?:[^#~@]*\.)?agenda-item(?:[.#~@]|$)", r"^div\.(?:[^#~@]*\.)?agenda-item(?:[.#~@]|$)"),
    Look("rows", r"^table[^@]*@", r"^td(?:[.#~@]|$)", r"^th(?:[.#~@]|$)"),
    Look("bordered", r"(?i)^table[^~]*~.*border-collapse: collapse", r"^td\.(?:[^#~@]*\.)?text(?:[.#~@]|$)", r"^td\.(?:[^#~@]*\.)?num(?:[.#~@]|$)"),
    Look("word", r"^p\.(?:[^#~@]*\.)?MsoNormal(?:[.#~@]|$)", r"^a[^@]*@AI\d+_NAME$", r"^b(?:[.#~@]|$)"),
)


def vote_layouts(tree: DataFrame, looks: Sequence[Look] = LOOKS) -> DataFrame:
    """(page_id, layout, votes, sequence, vendor_item_id, number, title): each page's items by the layout that finds the most of them.

    A layout has a vote for each item with a title; of equal layouts the
    earlier one of the list counts. Pages on which none finds an item have no
    row. Text counts for the innermost item around it.
    """

    def step(m: Mark) -> str:
        cls = re.sub(r"\s+", ".", m.cls.strip(" ")) if m.cls else m.cls
        return m.tag + "".join(mark + c for mark, c in ((".", cls), ("#", m.id), ("~", m.style), ("@", m.key)) if c)

    def read(n: Nodes) -> tuple[np.ndarray, dict[str, pa.Array]]:
        steps = [step(m) for m in n.marks]
        some = n.held > 0

        def fit(look: Look, part: str) -> np.ndarray:
            pattern = re.compile(getattr(look, part))
            return np.flatnonzero(np.array([*(bool(pattern.search(s)) for s in steps), False])[n.code] & some)

        items = [fit(look, "item") for look in looks]
        titles = [n.own_text(at, at, n.owner(n.words, fit(look, "title")) >= 0) for at, look in zip(items, looks, strict=True)]
        titled = [t.is_valid().to_numpy(zero_copy_only=False) for t in titles]
        items, among = [at[t] for at, t in zip(items, titled, strict=True)], items
        votes = np.stack([np.bincount(n.page[at], minlength=n.pages) for at in items])
        best, most = votes.argmax(axis=0), np.maximum(votes.max(axis=0), 1)
        kept = [best[n.page[at]] == k for k, at in enumerate(items)]
        at = np.concatenate([at[k] for at, k in zip(items, kept, strict=True)])
        number = [n.own_text(at[k], all_, n.owner(n.words, fit(look, "number")) >= 0) for at, k, all_, look in zip(items, kept, among, looks, strict=True)]
        return n.page[at], {
            "look": pa.array(best[n.page[at]], pa.int32()), "votes": pa.array(most[n.page[at]]), "sequence": pa.array(np.concatenate([n.nth(at[k]) for at, k in zip(items, kept, strict=True)])),
            "vendor_item_id": n.by_mark(lambda m: m.key, at), "number": pa.concat_arrays(number), "title": pa.concat_arrays([t.drop_null().filter(pa.array(k)) for t, k in zip(titles, kept, strict=True)]),
        }

    found = layout(tree, read, "look int, votes long, sequence long, vendor_item_id string, number string, title string")
    name = F.get(F.array(*(F.lit(look.name) for look in looks)), F.col("look"))
    return found.select("page_id", name.alias("layout"), "votes", "sequence", "vendor_item_id", F.regexp_replace("number", r"\.$", "").alias("number"), "title")
