"""A full-text index that lasts: postings in buckets of terms, BM25 ranks, smallest windows that hold all terms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moothall.operators.search import MOST_WORDS, STOP, query_terms, stem

BUCKETS = 64
#: BM25's usual weights.
K1, B = 1.2, 0.75
_TOKEN = "array<struct<t:string,s:int,e:int>>"


def _spots(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    word, known = regex.compile(r"[\p{L}\p{N}]+"), {}
    for part in texts:
        lists, ends, found = [], [0], []
        for k, text in enumerate(part):
            for m in word.finditer(text.as_py() or ""):
                w = m[0].lower()
                if w not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[w] = None if w in STOP else stem(w)
                found.append((known[w], m.start(), m.end()))
            ends.append(len(found))
            if len(found) >= MOST_WORDS or k + 1 == len(part):
                columns = zip(*found, strict=True) if found else [()] * 3
                words = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()), strict=True)], ["t", "s", "e"])
                lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words))
                ends, found = [0], []
        yield pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.struct([("t", pa.string()), ("s", pa.int32()), ("e", pa.int32())])))


def spots(text: Column) -> Column:
    """Every word of a text, in order: its stem (null for words that no query needs), first character and end, from 0."""
    return F.arrow_udf(_spots, _TOKEN)(text)


def _runs(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    word, of = regex.compile(r"[\p{L}\p{N}]+"), pa.struct([("t", pa.string()), ("w", pa.string())])
    for part in parts:
        lists, ends, found = [], [0], []
        for k, (text, first, last) in enumerate(zip(*part, strict=True)):
            for m in islice(word.finditer(text.as_py() or ""), first.as_py(), last.as_py() + 1):
                w = m[0].lower()
                found.append((None if w in STOP else stem(w), m[0]))
            ends.append(len(found))
            if len(found) >= MOST_WORDS or k + 1 == len(part[0]):
                columns = zip(*found, strict=True) if found else [()] * 2
                lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], ["t", "w"])))
                ends, found = [0], []
        yield pa.concat_arrays(lists) if lists else pa.array([], pa.list_(of))


def run_of(text: Column, first: Column, last: Column) -> Column:
    """The words of a text from one to another, from 0, with their stems: one walk over the text, however many words."""
    return F.arrow_udf(_runs, "array<struct<t:string,w:string>>")(text, first, last)


@dataclass(frozen=True)
class Index:
    """postings (term, id, tf, at; partitioned by bucket and version) and lengths (id, version, size) under one path."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def add(self, docs: DataFrame, version: int) -> None:
        """Index docs (id, text) as a version; an id's newest version counts, a null text takes the id out.

        A hot term's postings are dealt out by ranges of ids. Writing a version
        again replaces it.
        """
        words = docs.select("id", F.posexplode(spots(F.col("text"))).alias("nth", "w")).where("w.t is not null")
        posted = words.groupBy(F.col("w.t").alias("term"), "id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("nth")).alias("at"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        placed = posted.withColumn("bucket", bucket).repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/version={version}")
        sized = docs.select("id", F.when(F.col("text").isNotNull(), F.size(F.filter(spots(F.col("text")), lambda x: x["t"].isNotNull()))).cast("long").alias("size"))
        sized.write.mode("overwrite").parquet(f"{self.path}/lengths/version={version}")

    def lengths(self) -> DataFrame:
        """(id, version, size) of the documents that are in."""
        every = self.spark.read.parquet(f"{self.path}/lengths")
        newest = every.groupBy("id").agg(F.max_by(F.struct("version", "size"), "version").alias("d"))
        return newest.select("id", "d.version", "d.size").where("size is not null")

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """The terms' postings; other buckets' files aren't read."""
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
        where = sorted({r["b"] for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("b")).collect()})  # a query's terms
        rows = self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(where) & F.col("term").isin(list(terms)))
        return rows.select("term", "id", "version", "tf", "at")

    def search(self, query: str, k1: float = K1, b: float = B) -> DataFrame:
        """(id, rank) of the documents that hold every term, by BM25; a query without terms matches nothing."""
        terms = list(dict.fromkeys(query_terms(query)))
        live = self.lengths()
        if not terms:
            return live.select("id", F.lit(0.0).alias("rank")).where(F.lit(False))
        stats = live.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
        held = self.postings(terms).join(live, ["id", "version"])
        counts = {r["term"]: r["df"] for r in held.groupBy("term").agg(F.count("*").alias("df")).collect()}  # one row a term of the query
        n, mean = stats["n"], stats["mean"] or 1.0
        idf = F.element_at(F.create_map(*(F.lit(x) for t in terms for x in (t, float(n - counts.get(t, 0) + 0.5) / (counts.get(t, 0) + 0.5)))), F.col("term"))
        weight = F.log1p(idf) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / mean))
        return held.groupBy("id").agg(F.sum(weight).alias("rank"), F.count("*").alias("met")).where(F.col("met") == len(terms)).select("id", "rank")

    def windows(self, query: str) -> DataFrame:
        """(id, first, last): the shortest run of words of each document that holds every term, the earliest of equals.

        Each hit may end a window, which begins at the earliest of the terms'
        last hits up to there: one pass over the hits of a document in order.
        """
        terms = list(dict.fromkeys(query_terms(query)))
        hits = self.postings(terms).join(self.lengths().select("id", "version"), ["id", "version"]).select("id", "term", F.explode("at").alias("p"))
        order = Window.partitionBy("id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
        seen = [F.last(F.when(F.col("term") == t, F.col("p")), ignorenulls=True).over(order) for t in terms]
        begins = F.array_min(F.array(*seen))
        whole = F.forall(F.array(*seen), lambda x: x.isNotNull())
        ends = hits.select("id", "p", F.when(whole, begins).alias("first")).where("first is not null")
        best = ends.groupBy("id").agg(F.min(F.struct((F.col("p") - F.col("first")).alias("wide"), "first", F.col("p").alias("last"))).alias("w"))
        return best.select("id", F.col("w.first").alias("first"), F.col("w.last").alias("last"))


def headlines(docs: DataFrame, windows: DataFrame, query: str, before: int = 5, words: int = 30) -> DataFrame:
    """(id, first, last, headline) of docs (id, text): the words of the window and some around it, at least `words` where the text has them, hits in marks. Only the texts that have a window are cut into words."""
    terms = F.array(*map(F.lit, query_terms(query)))
    start = F.greatest(F.col("first") - before, F.lit(0))
    until = F.greatest(F.col("last"), start + words - 1)
    met = docs.join(windows, "id").withColumn("w", run_of(F.col("text"), start.cast("long"), until.cast("long")))
    marked = F.transform("w", lambda x: F.when(F.array_contains(terms, x["t"]), F.concat(F.lit("<mark>"), x["w"], F.lit("</mark>"))).otherwise(x["w"]))
    return met.select("id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.array_join(marked, " ").alias("headline"))
