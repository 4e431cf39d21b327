"""Streams over more files than one trigger reads."""

from moothall.plans import registry


def test_the_last_state_of_a_job_counts(spark, tmp_path):
    for k in range(20):  # 8 files a trigger; three errors of a user lie in three batches
        rows = [(100 * k + u, u, f"2024-01-{k + 1:02} 00:00:00", "error") for u in range(40) if k in (1, 10, 19)] or [(100 * k, 99, f"2024-01-{k + 1:02} 00:00:00", "view")]
        spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").selectExpr("event_id", "user_id", "cast(ts as timestamp_ntz) ts", "event_type").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = {r["user_id"]: (r["failed"], r["status"]) for r in registry.QUERIES["str03_retried_jobs"](spark, str(tmp_path)).collect()}
    assert got == {u: (3, "dead_letter") for u in range(40)} | {99: (0, "pending")}
