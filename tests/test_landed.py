"""The landed source on a few rows."""

import json

from pyspark.sql import functions as F

from moothall.sources.landed import in_window, read_landed


def test_landed(spark, tmp_path):
    ok = {"vendor": "legistar", "vendor_id": "1", "title": "Council", "start": "2024-05-07T18:00:00", "items": [{"title": "Roll", "sequence": 1, "attachments": [{"name": "a", "url": "http://x"}]}]}
    rows = [ok, ok | {"start": "soon"}, ok | {"title": " "}, ok | {"vendor": "who"}, ok | {"items": [{"title": "", "sequence": "x", "attachments": [{"name": "a", "url": ""}]}]}, ok | {"vendor": "granicus", "vendor_id": None}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    got = read_landed(spark, str(tmp_path))
    assert got.meetings.count() == 1
    assert sorted(",".join(r["problems"]) for r in got.rejected.collect()) == sorted(["start", "title", "vendor", "item,attachment", "vendor_id", "json,vendor,vendor_id,title,start"])
    assert {r["vendor"]: r["success"] for r in got.status.collect()} == {"legistar": True, "granicus": False, "who": False, None: False}
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    assert in_window(got.meetings, at("2024-05-21 10:00:00")).count() == 1
    assert in_window(got.meetings, at("2024-05-22 10:00:00")).count() == 0
