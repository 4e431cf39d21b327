"""Operator 1, I-Match fingerprints over randomised lexicon subsets."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark import Broadcast
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE, map_arrow, mix, table, texts

#: The band of document frequencies, as shares of all documents, whose terms are kept.
LEAST, MOST = 0.001, 0.1
#: Subsets hold a lexicon term with chance 4**-(scale + 1); so many subsets at each of the scales.
SCALES, EACH = 5, 16
_HEX = 6
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_NONE = "0" * _HEX


def terms(text: str | None) -> set[bytes]:
    return set(_WORD.findall((text or "").lower().encode("utf-8", "surrogatepass")))


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST, text_col: str = "text") -> list[bytes]:
    """The terms of the frequency band, counted over all texts.

    At most (mean distinct terms of a text) / least terms reach the band,
    however many documents there are; so the list may be broadcast.
    """

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in texts(b.column(0)):
                seen.update(terms(t))
                if len(seen) > 2 * CACHE:
                    yield {"w": list(seen), "c": list(seen.values())}
                    seen.clear()
        yield {"w": list(seen), "c": list(seen.values())}

    filled = docs.select(F.col(text_col).cast("string").alias("t")).where("t is not null and t <> ''")
    n = filled.count()
    df = map_arrow(filled, count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))
    return sorted(bytes(r["w"]) for r in df.where((F.col("c") >= max(2, least * n)) & (F.col("c") <= max(2, most * n))).select("w").collect())


class Fingerprints:
    """Fingerprints of texts by a lexicon."""

    def __init__(self, words: list[bytes]) -> None:
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        member: list[list[int]] = [[] for _ in words]
        with np.errstate(over="ignore"):
            for k in range(SCALES * EACH):
                chance = 4.0 ** -(k // EACH + 1)
                for i in np.flatnonzero(mix(h + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15)) < np.uint64(int(chance * 2**64))):
                    member[i].append(k)
        self.member = dict(zip(words, map(tuple, member), strict=True))

    def of(self, text: str | None) -> str:
        """A hash of each subset's terms in the text, sorted; a text without lexicon terms is its sorted terms' digest."""
        all_terms = terms(text)
        kept = sorted(all_terms & self.member.keys())
        if not kept:
            return "x" + hashlib.sha256(b" ".join(sorted(all_terms))).hexdigest()
        parts: list[list[bytes]] = [[] for _ in range(SCALES * EACH)]
        for t in kept:
            for k in self.member[t]:
                parts[k].append(t)
        return "".join([f"{xxhash.xxh3_64_intdigest(b' '.join(p)) & 0xFFFFFF:06x}" if p else _NONE for p in parts])


def likeness(a: str, b: str) -> float:
    """The share of equal hashes among the subsets that hold a term of either, at the sparsest scale where half of them do.

    The sparser the subsets, the nearer to the Jaccard similarity of the terms
    is the chance of equal hashes.
    """
    if a == b:
        return 1.0
    if a[:1] == "x" or b[:1] == "x":
        return 0.0
    for scale in reversed(range(SCALES)):
        at = range(scale * EACH * _HEX, (scale + 1) * EACH * _HEX, _HEX)
        pairs = [(x, y) for i in at if (x := a[i : i + _HEX]) != _NONE or b[i : i + _HEX] != _NONE for y in (b[i : i + _HEX],)]
        if len(pairs) >= EACH // 2 or scale == 0 and pairs:
            return sum(x == y for x, y in pairs) / len(pairs)
    return 0.0


def with_successors(docs: DataFrame, n: int) -> DataFrame:
    """docs (doc_id, text) in about n sorted ranges of ids, one to a partition, each followed by a guard row: the first row of the next range, after the last that of the first.

    Order: doc_id, nulls last, then text. Only the range borders and their
    least ids, n numbers, pass through the driver.
    """
    borders = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    ranged = docs.withColumn("__d", F.col("doc_id").cast("double"))
    ranged = Bucketizer(splits=[-float("inf"), *borders, float("inf")], inputCol="__d", outputCol="__b").setHandleInvalid("keep").transform(ranged) if borders else ranged.withColumn("__b", F.lit(0))
    ranged = ranged.select("doc_id", "text", F.when(F.col("doc_id").isNull(), len(borders) + 1).otherwise(F.col("__b").cast("int")).alias("b"))
    heads = sorted((r["b"], r["m"]) for r in ranged.groupBy("b").agg(F.min("doc_id").alias("m")).collect())
    if not heads:
        return docs.withColumn("guard", F.lit(False))
    before = dict(zip((b for b, _ in heads), (b for b, _ in heads[-1:] + heads[:-1]), strict=True))
    ids = [m for _, m in heads if m is not None]
    first = F.col("doc_id").isin(ids) if ids else F.lit(False)
    if any(m is None for _, m in heads):
        first = first | F.col("doc_id").isNull()
    to = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("b"))
    guards = ranged.where(first).select("doc_id", "text", to.alias("b"), F.lit(True).alias("guard"))
    both = ranged.withColumn("guard", F.lit(False)).unionByName(guards)
    return both.repartitionById(len(borders) + 2, F.col("b")).sortWithinPartitions("guard", F.asc_nulls_last("doc_id"), "text").drop("b")


def fingerprint_documents(docs: DataFrame, words: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text, and how like they and the next document's are.

    The edited text has the last floor(n_chars / 4) code points replaced by as
    many first ones of the next document. Null texts count as empty; an empty
    text's fingerprint is that of no terms. Null ids come last, rows that
    share an id are ordered by text; the last row's next is the first, a lone
    row's next is itself. Other columns are ignored. Texts are shuffled once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        prints = Fingerprints(words.value)
        last = None
        for b in batches:
            out = {k: [] for k in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
            for i, t, guard in zip(b.column("doc_id").to_pylist(), texts(b.column("text")), b.column("guard").to_pylist(), strict=True):
                if last == "done":
                    break
                mine = prints.of(t)
                if last is not None:
                    j, text, own = last
                    cut = len(text) // 4
                    edited = text[: len(text) - cut] + t[:cut]
                    changed = prints.of(edited) if edited != text else own
                    row = (j, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, changed, likeness(own, changed), likeness(own, mine))
                    for k, x in zip(out, row, strict=True):
                        out[k].append(x)
                last = "done" if guard else (i, t, mine)
            yield out

    return map_arrow(with_successors(docs, n), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprint_documents(docs, spark.sparkContext.broadcast(lexicon(docs)))
