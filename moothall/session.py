"""A local session for tests, benchmarks and the command line; clusters bring their own."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    cores = cores or os.cpu_count() or 2
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("moothall").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cores)).config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-checkpoint-")).getOrCreate()
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a job's tables under spark.checkpoint.dir, which only a local session may leave unset."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="spark-tables-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
