"""The corpus pipeline: five stages from raw documents to token digests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moothall.llm.bpe import digests, encode_documents, vocabulary
from moothall.llm.common import crc_mod, shared_folder, table
from moothall.llm.decontaminate import decontaminate
from moothall.llm.jaccard_join import jaccard_classes
from moothall.llm.pii import pseudonymise
from moothall.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is below 0.5 stay; a fifth of the labels isn't learned from, so that it can judge."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    own = "__score"
    while own in docs.columns:
        own += "_"
    return score_toxicity(docs, model, score_col=own).where(F.col(own) < 0.5).drop(own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 over five-word shingles join, the one with the least id stays; documents without words or id stay. Of rows that share id and text one stays."""
    classes = jaccard_classes(docs, n=5, num=80, den=100)
    gone = classes.where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    once = left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; n_chars follows the new text. Null texts stay null with null n_chars, empty ones empty."""
    out = pseudonymise(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts; null texts count as empty, which have no tokens."""
    return digests(encode_documents(docs, vocabulary()))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("benchmark_decontamination", drop_contaminated), ("pii", hide_personal_values), ("bpe", encode)]

#: Trees, alignment and Feistel networks have no SQL form; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each but the last is written in the shared folder and read again."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
