"""Streams with timers against a loop over rows in order of time, rows coming out of order over many triggers."""

import random

from pyspark.sql import functions as F

from moothall.session import shared_folder
from moothall.streaming import events, timers

DAY = 24 * 60


def written(spark, rows, at, files):
    """Rows (event_id, user_id, minute, kind) dealt to files; a day's delay covers the disorder."""
    df = spark.createDataFrame(rows, "event_id long, user_id long, minute long, kind string").selectExpr("event_id", "user_id", "timestamp_seconds(1700000000 + 60 * minute) as ts", "kind")
    for k in range(files):
        df.where(F.col("event_id") % files == k).coalesce(1).write.mode("append").parquet(f"{at}/in")
    return events.read_events(spark, f"{at}/in", 1)


def ran(spark, stream, at):
    def write(batch, n):
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    events.drain(stream, "append", write, f"{at}/checkpoint", timers.PROVIDER)
    assert spark.conf.get(name) == before
    return spark.read.parquet(f"{at}/out")


def minutes(column):
    return ((F.unix_seconds(column) - 1700000000) / 60).cast("long")


def looped(rows, upto, lease=30, idle=2 * DAY, tries=3):
    """The same by one list of a job's rows and a clock."""
    out = []
    for u in sorted({r[1] for r in rows}):
        job = None
        todo = sorted((r[2], r[0], r[3]) for r in rows if r[1] == u and r[3])
        for at, event_id, kind in [*todo, (upto + 1, None, "end")]:
            while job and job["until"] < at and job["until"] <= upto:
                if job["status"] == "processing":
                    out.append((u, None, job["until"], "pending", job["n"], job["p"]))
                    job = {**job, "status": "pending", "until": job["until"] + idle}
                else:
                    out.append((u, None, job["until"], "expired", job["n"], job["p"]))
                    job = None
            if at > upto:
                break
            job = job or {"n": 0, "p": 100}
            if kind == "start":
                job.update(status="processing", until=at + lease)
            elif kind == "retry":
                job["n"] += 1
                dead = job["n"] >= tries
                job.update(status="dead_letter" if dead else "pending", p=job["p"] - (0 if dead else 20 * job["n"]), until=at + idle)
            else:
                job["status"] = {"done": "completed", "fatal": "failed"}[kind]
            out.append((u, event_id, at, job["status"], job["n"], job["p"]))
            if job["status"] not in ("pending", "processing"):
                job = None
    return out


def test_jobs_by_a_loop(spark, tmp_path):
    rng, rows = random.Random(3), []
    for i in range(900):  # event i lies within half a day of minute 20 * i
        rows.append((i, rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, 8]), 20 * i + rng.randrange(-DAY // 2, DAY // 2) if i < 880 else 20 * i, rng.choice(["start", "start", "retry", "retry", "retry", "done", "fatal", None])))
    rows += [(900, 9, 100, "start"), (901, 9, 100, "retry"), (902, 9, 100, "retry"), (903, 10, 5000, "retry")]
    at = str(tmp_path)
    stream = written(spark, rows, at, 1)
    got = ran(spark, timers.job_changes(stream, "user_id", F.col("kind")), at)
    got = [tuple(r) for r in got.select("user_id", "event_id", minutes("ts"), "status", "retries", "priority").collect()]
    want = looped(rows, max(r[2] for r in rows if r[3]) - DAY)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[3] for r in got} == {"pending", "processing", "completed", "failed", "dead_letter", "expired"}


def test_order_of_files_does_not_matter_and_state_shrinks(spark, tmp_path):
    rows = [(i, i % 5, 20 * i, ("start", "retry", "retry", "done", "retry")[i // 5 % 5]) for i in range(600)]
    rows += [(600, 77, 20 * 599 + 6 * DAY, "start")]  # its time lets the watermark pass all others and their deadlines
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    a = ran(spark, timers.job_changes(written(spark, rows, one, 1), "user_id", F.col("kind")), one)
    swapped = [r for k in range(0, 600, 60) for r in rows[k : k + 60][::-1]] + rows[600:]  # disorder of twenty hours
    for part in [swapped[k : k + 60] for k in range(0, len(swapped), 60)]:
        written(spark, part, many, 1)
    b = ran(spark, timers.job_changes(events.read_events(spark, f"{many}/in", 1), "user_id", F.col("kind")), many)
    cols = ["user_id", "event_id", "ts", "status", "retries", "priority"]
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))
    left = spark.read.format("statestore").option("path", f"{one}/checkpoint").option("stateVarName", "own").load()
    assert left.count() == 0  # all jobs are finished or expired; the last start still waits
    waiting = spark.read.format("statestore").option("path", f"{one}/checkpoint").option("stateVarName", "waiting").load()
    assert [r["key"]["user_id"] for r in waiting.collect()] == [77]


def test_due_syncs_and_empty_streams(spark, tmp_path):
    rows = [(0, 1, 0, "fine"), (1, 1, 600, "error"), (2, 1, 3000, "error"), (3, 1, 3060, "fine"), (4, 2, 10, "fine"), (5, None, 20, "fine"), (6, 3, 30, None), (7, 2, 9000, "fine")]
    at = str(tmp_path / "a")
    got = ran(spark, timers.due_syncs(written(spark, rows, at, 1), "user_id", F.col("kind")), at).select("user_id", minutes("due"), "reason").collect()
    assert sorted(map(tuple, got)) == [(1, 600 + 120, "error"), (1, 3060 + DAY, "fine"), (2, 10 + DAY, "fine")]
    at = shared_folder(spark, "empty")
    empty = written(spark, rows[6:7], at, 1)
    assert ran(spark, timers.due_syncs(empty, "user_id", F.col("kind")), at).count() == 0
