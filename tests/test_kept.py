"""Retention, sketches, claims and the guard on plans."""

import datetime as dt
import os

import pytest

from moothall import api
from moothall.operators import daily
from moothall.streaming.ledger import JobQueue

EVENTS = [(i, f"2024-01-{1 + i % 5:02d} {i % 24:02d}:00:00", i % 7) for i in range(200)] + [(999, None, 1)]


@pytest.fixture
def events(spark):
    return spark.createDataFrame(EVENTS, "event_id long, ts string, who long").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "who")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_purge_deletes_and_leaves_other_days(spark, events, tmp_path):
    at = str(tmp_path / "t")
    daily.write_days(events, at)
    before, cut = files(at), dt.datetime(2024, 1, 3, 12)
    old = [e for e in EVENTS if e[1] and e[1] < "2024-01-03 12"]
    assert daily.purge(spark, at, cut) == len(old)
    after = files(at)
    untouched = {f: t for f, t in before.items() if "day=2024-01-04" in f or "day=2024-01-05" in f}
    assert untouched and all(after[f] == t for f, t in untouched.items())
    assert {r["event_id"] for r in spark.read.parquet(at).collect()} == {e[0] for e in EVENTS if e[1]} - {e[0] for e in old}
    assert daily.purge(spark, at, cut) == 0 and files(at) == after
    assert daily.purge(spark, at, dt.datetime(2024, 1, 4)) == sum("2024-01-03 12" <= e[1] < "2024-01-04" for e in EVENTS if e[1])
    assert os.listdir(tmp_path) == ["t"]


def test_sketches_add_up(spark, events, tmp_path):
    at = str(tmp_path / "s")
    e = events.selectExpr("*", "event_id % 3 as k")
    daily.add_sketches(e.where("day(ts) <> 3"), at, "k", "who")
    still = {f: t for f, t in files(at).items() if "day=2024-01-01" in f}
    for _ in range(2):
        daily.add_sketches(e.where("day(ts) = 3 or event_id = 4"), at, "k", "who")
    assert {f: t for f, t in files(at).items() if "day=2024-01-01" in f} == still
    got = {r["k"]: r["visitors"] for r in daily.trending(spark, at, "k", dt.date(2024, 1, 4), 3).collect()}
    assert got == {k: len({w for i, ts, w in EVENTS if ts and i % 3 == k and "2024-01-02" <= ts < "2024-01-05"}) for k in range(3)}


def test_many_visitors_are_counted_exactly(spark, tmp_path):
    """An estimate was off by some per cent from a few hundred visitors a key on."""
    at = str(tmp_path / "many")
    e = spark.range(40_000).selectExpr("timestamp'2024-01-01' + make_interval(0, 0, 0, id % 3) as ts", "id % 2 as k", "id div 4 as who")
    for load in (e.where("who % 5 <> 0"), e.where("who % 5 = 0"), e.where("who % 10 = 0")):
        daily.add_sketches(load, at, "k", "who")
    assert {r["k"]: r["visitors"] for r in daily.trending(spark, at, "k", dt.date(2024, 1, 3)).collect()} == {0: 10_000, 1: 10_000}


def test_replayed_batches_change_nothing(spark, tmp_path):
    q = JobQueue(spark, str(tmp_path / "q"))
    batch = spark.createDataFrame([(i, float(i % 10)) for i in range(30)], "job_id long, priority double")
    assert q.arrive(batch, 0) and not q.arrive(batch, 0) and not q.arrive(batch.where("job_id > 100"), 0)
    assert q.arrive(batch.where("job_id < 3"), 1)
    assert q.pending().count() == 30


def test_two_claimers_never_share_a_job(spark, tmp_path):
    q = JobQueue(spark, str(tmp_path / "q"))
    q.arrive(spark.createDataFrame([(i, float(i % 10)) for i in range(25)], "job_id long, priority double"), 0)
    other = {}

    def interfere():
        if not other:
            other["b"] = True
            other["b"] = {r["job_id"] for r in q.claim("b", 10).collect()}

    mine = {r["job_id"] for r in q.claim("a", 10, between=interfere).collect()}
    want = sorted(range(25), key=lambda i: (-(i % 10), i))
    assert other["b"] == set(want[:10]) and mine == set(want[10:20])
    assert q.claim("a", 10).count() == 5 and q.claim("b", 10) is None
    assert sorted((r["job_id"]) for r in q.claims().collect()) == list(range(25))


@pytest.mark.parametrize(("sql", "fine"), [
    ("SELECT 1", True), ("select update, `drop` from (select state as update, name as `drop` from jurisdictions)", True), ("WITH insert AS (SELECT * FROM items) SELECT count(*) FROM insert", True), ("SELECT 'DELETE FROM x;' -- drop", True), ("SELECT * FROM items WHERE meeting_id IN (SELECT id FROM meetings);", True),
    ("DELETE FROM items", False), ("SELECT 1; DROP TABLE items", False), ("INSERT INTO items SELECT 1", False), ("WITH x AS (SELECT 1) INSERT INTO items SELECT * FROM x", False), ("SET spark.sql.ansi.enabled=false", False), ("CREATE TABLE t AS SELECT 1", False), ("SELECT * FROM csv.`/etc/passwd`", False), ("SELECT * FROM secret_table", False),
    ("SELECT TRANSFORM(id) USING 'sh' FROM items", False), ("SELECT java_method('java.lang.System', 'exit', 1)", False), ("SELECT id FROM items WHERE EXISTS (SELECT 1 FROM json.`/x`)", False), ("", False), ("nonsense", False), ("EXPLAIN SELECT 1", False),
])
def test_the_guard_reads_the_plan(spark, sql, fine):
    assert (api.plan_problem(spark, sql) is None) == fine
