"""Structured Streaming over the event log: windows, sessions, counters and retried jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """The event files as a stream, with event times that watermarks take; `files` bounds what a trigger reads."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events of each type in tumbling windows; those later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """A visitor's runs of events without a longer gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def funnel(events: DataFrame) -> DataFrame:
    """Events by type since the start."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def retained(events: DataFrame, days: int = 7) -> DataFrame:
    """Each event once; what comes later than the days that are kept is left out."""
    return events.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "ts")


def retry_jobs(events: DataFrame, tries: int = 3) -> DataFrame:
    """State of each job (user_id) after its events: an error is tried again until there were `tries`, then it's a dead letter; a purchase completes it."""

    def fold(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed, status = state.get if state.exists else (0, "pending")
        for e in sorted((x for p in parts for x in zip(p.ts, p.event_id, p.event_type, strict=True))):
            if status == "dead_letter":
                break
            if e[2] == "error":
                failed += 1
                status = "dead_letter" if failed >= tries else "pending"
            elif e[2] == "purchase":
                failed, status = 0, "completed"
        state.update((failed, status))
        yield pd.DataFrame({"user_id": [key[0]], "failed": [failed], "status": [status]})

    narrow = events.select("user_id", "ts", "event_id", "event_type")
    return narrow.groupBy("user_id").applyInPandasWithState(fold, "user_id long, failed long, status string", "failed long, status string", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str, provider: str | None = None) -> None:
    """Run the stream over all that is there, batch by batch, and stop; its state is held by the provider, if one is named."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    try:
        if provider:
            conf.set(name, provider)
        running = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if provider:  # a started stream has its own copy of the session
            conf.set(name, before)
    running.awaitTermination()
