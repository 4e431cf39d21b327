"""Listings of meetings on small pages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from moothall.sources import listings
from moothall.sources import structure as S


@pytest.mark.parametrize(("text", "want"), [
    ("December 22, 2025 - 06:00 PM", dt.datetime(2025, 12, 22, 18)), ("1768204800Jan 12, 2026", dt.datetime(2026, 1, 12)), ("Tuesday, March 31, 2026", dt.datetime(2026, 3, 31)), ("03 / 31 / 2026", dt.datetime(2026, 3, 31)), ("177489360003/30/26", dt.datetime(2026, 3, 30)),
    ("Mon Mar 2, 2026 at 7:15 PM", dt.datetime(2026, 3, 2, 19, 15)), ("1768204800", dt.datetime(2026, 1, 12, 8)), ("1768204800 soon", dt.datetime(2026, 1, 12, 8)), ("Monitors", None), ("2024", None), ("", None), (None, None),
])
def test_dates(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(listings.listing_date(F.col("t"))).first()[0] == want


def test_rows_and_links(spark):
    cell = lambda x, cls="listItem": f'<td class="{cls}">{x}</td>'
    pages = [
        # classed rows only: the plain row of the listing table is none; one cell, no link and no number are no meetings
        '<table class="listingTable"><tr class="odd">' + cell("A") + cell("1/2/2024") + '<td><a href="AgendaViewer.php?clip_id=5">x</a><a href="p.pdf">p</a></tr><tr class="even">' + cell("A again") + cell("1/3/2024") + '<td><a href="AgendaViewer.php?clip_id=5">x</a></tr><tr class="odd">' + cell("lone") + '<a href="AgendaViewer.php?clip_id=6">x</a></tr>'
        + '<tr class="even">' + cell("no link") + cell("1/4/2024") + '</tr><tr class="even">' + cell("no number") + cell("1/4/2024") + '<td><a href="AgendaViewer.php">x</a></tr><tr>' + cell("plain", "listedItem") + cell("1/5/2024", "listedItem") + '<td><a href="AgendaViewer.php?clip_id=7">x</a></tr></table>',
        # a packet's UUID; an anchor goes before a choice
        '<table><tr class="listingRow">' + cell("") + cell("never") + '<td><a href="//cdn/0123abcd-4567-89ef-0123-456789abcdef.pdf">x</a></tr><tr class="listingRow x">' + cell("B") + cell("May 5, 2024") + '<td><select><option value="AgendaViewer.php?event_id=1">o</select><a href="AgendaViewer.php?event_id=2">x</a></tr></table>',
        # plain rows need a listed cell; panels name rows without a title, each its own
        '<div class="CollapsiblePanelTab">One</div><div class="CollapsiblePanelContent"><table class="listingTable"><tr>' + cell("May 6, 2024", "listedItem") + cell("Agenda", "listedItem") + '<td><a href="AgendaViewer.php?event_id=3">x</a></tr></table></div><div class="CollapsiblePanelTab">Two</div><div class="CollapsiblePanelContent"><table class="listingTable"><tr>'
        + cell("May 7, 2024", "listedItem") + cell("Agenda", "listedItem") + '<td><a href="AgendaViewer.php?event_id=4">x</a></tr><tr>' + cell("May 8, 2024") + cell("Agenda") + '<td><a href="AgendaViewer.php?event_id=8">x</a></tr></table></div>',
        "", None, "<tr class=odd><td class=listItem>",
    ]
    tree = S.page_tree(spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string"))
    got = sorted((r["page_id"], r["event_id"], r["title"], str(r["start"])[:10], r["agenda_url"], r["packet_url"]) for r in listings.listed_meetings(tree).collect())
    view = "http://h/AgendaViewer.php?"
    assert got == [
        (0, "5", "A", "2024-01-02", f"{view}clip_id=5", "http://h/p.pdf"), (1, "0123abcd4567", None, "None", None, "http://cdn/0123abcd-4567-89ef-0123-456789abcdef.pdf"), (1, "2", "B", "2024-05-05", f"{view}event_id=2", None),
        (2, "3", "One", "2024-05-06", f"{view}event_id=3", None), (2, "4", "Two", "2024-05-07", f"{view}event_id=4", None),
    ]
