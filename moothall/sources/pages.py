"""HTML pages to rows of links, headings and blocks, by the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCKS = frozenset("p li td th div section article blockquote".split())
_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))


#: A batch from a parser ends with the page that reaches so many rows, however many pages came in at once.
MOST_ROWS = 20_000


def arrow_schema(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(c, kinds[t]) for c, t in (f.split() for f in fields.split(", "))])


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class _Rows(HTMLParser):
    """Collects (kind, text, url) in document order; scripts and styles are left out."""

    def __init__(self, base: str) -> None:
        super().__init__()
        self.base, self.rows, self.hidden = base, [], 0
        self.link: list | None = None
        self.heading: list | None = None
        self.block: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "a" and (url := dict(attrs).get("href")) is not None:
            self.end_link()
            self.link = ["link", "", urljoin(self.base, url)]
        elif tag in _HEADINGS:
            self.end_block()
            self.heading = ["heading", "", None]
        elif tag in _BLOCKS:
            self.end_block()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a":
            self.end_link()
        elif tag in _HEADINGS:
            self.end_heading()
        elif tag in _BLOCKS:
            self.end_block()

    def handle_data(self, data):
        if not self.hidden:
            for part in (self.link, self.heading):
                if part is not None:
                    part[1] += data
            self.block.append(data)

    def end_link(self):
        if self.link is not None:
            self.rows.append(tuple(self.link))
            self.link = None

    def end_heading(self):
        if self.heading is not None:
            self.rows.append(tuple(self.heading))
            self.heading, self.block = None, []

    def end_block(self):
        text = " ".join("".join(self.block).split())
        if text and self.heading is None:
            self.rows.append(("block", text, None))
        self.block = []

    def close(self):
        super().close()
        self.end_link()
        self.end_heading()
        self.end_block()


def rows_of(html: str | None, base: str | None) -> list[tuple[str, str, str | None]]:
    p = _Rows(base or "")
    p.feed(html or "")
    p.close()
    return [(kind, " ".join(text.split()), url) for kind, text, url in p.rows]


def parse_pages(pages: DataFrame) -> DataFrame:
    """Rows (page_id, nth, kind, text, url) of pages (page_id, url, html); null and empty pages have none."""

    fields = "page_id long, nth int, kind string, text string, url string"
    schema = arrow_schema(fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for i, url, html in zip(*part.columns, strict=True):
                out += ((i.as_py(), n, *row) for n, row in enumerate(rows_of(html.as_py(), url.as_py())))
                if len(out) >= MOST_ROWS:
                    yield as_batch(out, schema)
                    out = []
            yield as_batch(out, schema)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, fields)
