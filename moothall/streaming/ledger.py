"""Jobs that are claimed once: tables that count only when a ledger of commits names them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """Commits under one path: a table is written aside, then named by a file that only one writer can create.

    A commit is the renaming of a complete file to its number. That is atomic,
    and fails if the number is taken, on HDFS; other stores need a table
    format's log in its place.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def commits(self, kind: str) -> dict[int, str]:
        """The committed tables of a kind by their number."""
        fs, p = self._fs(f"{self.path}/ledger/{kind}")
        if not fs.exists(p):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return {int(n): self._read(f"{self.path}/ledger/{kind}/{n}") for n in names if n.isdecimal()}

    def _read(self, path: str) -> str:
        return self.spark.read.text(path).first()[0]  # one line: where the table is

    def commit(self, kind: str, number: int, df: DataFrame) -> bool:
        """Write df as the table of that number; False, and no change, if the number is taken."""
        if number in self.commits(kind):
            return False
        at = f"{self.path}/{kind}/{uuid.uuid4().hex}"
        df.write.parquet(at)
        name = f"{self.path}/ledger/{kind}/{number}"
        written = f"{self.path}/ledger/{kind}/.{uuid.uuid4().hex}"
        fs, p = self._fs(written)
        out = fs.create(p, False)
        out.write(bytearray(f"{at}\n", "utf-8"))
        out.close()
        if not self._take(fs, p, self._fs(name)[1]):
            fs.delete(p, False)
            fs.delete(self._fs(at)[1], True)
            return False
        return True

    @staticmethod
    def _take(fs, written, name) -> bool:
        """Renaming the complete file fails where the name stands already (local file systems would replace it, so they are asked first)."""
        return not fs.exists(name) and fs.rename(written, name)

    def rows(self, kind: str, schema) -> DataFrame:
        tables = list(self.commits(kind).values())
        return self.spark.read.schema(schema).parquet(*tables) if tables else self.spark.createDataFrame([], schema)


JOBS = "job_id long, priority double"
CLAIMS = "job_id long, priority double, claim long, worker string"


class JobQueue:
    """Jobs (job_id, priority) that arrive in batches and are claimed by workers, each once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.ledger = Ledger(spark, path)

    def arrive(self, batch: DataFrame, number: int) -> bool:
        """Take in a batch; one that is replayed under its number changes nothing. For foreachBatch."""
        return self.ledger.commit("arrivals", number, batch.select("job_id", "priority"))

    def pending(self) -> DataFrame:
        """Jobs that arrived and aren't claimed; a job that came in several batches counts once, with its highest priority."""
        jobs = self.ledger.rows("arrivals", JOBS).groupBy("job_id").agg(F.max("priority").alias("priority"))
        return jobs.join(self.ledger.rows("claims", CLAIMS).select("job_id"), "job_id", "left_anti")

    def claim(self, worker: str, most: int, tries: int = 20, between: Callable[[], None] | None = None) -> DataFrame | None:
        """Claim up to `most` jobs, highest priority first; None if none is left.

        What is pending is read as of the last claim; if another worker's claim
        comes first, the choice is made anew, so that no job is claimed twice.
        `between` is called before a claim is committed (for tests).
        """
        for _ in range(tries):
            number = max(self.ledger.commits("claims"), default=0) + 1
            chosen = self.pending().orderBy(F.desc("priority"), "job_id").limit(most)
            rows = chosen.withColumn("claim", F.lit(number).cast("long")).withColumn("worker", F.lit(worker))
            if between:
                between()
            if self.ledger.commit("claims", number, rows):
                own = self.ledger.spark.read.schema(CLAIMS).parquet(self.ledger.commits("claims")[number])
                return None if own.isEmpty() else own
        raise RuntimeError("other workers' claims always came first")

    def claims(self) -> DataFrame:
        return self.ledger.rows("claims", CLAIMS)
