"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from moothall.llm.common import Shelf, crc_mod
from moothall.llm.merkle import build, descend, manifest_proofs

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    i, _, lang, source, n = row
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path_of(levels, i):
    for level in levels[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        yield i % 3, run[: i % 3] + run[i % 3 + 1 :]
        i //= 3


def by_hand(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append(r)
    for source, own in trees.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[source] = own, levels_of([leaf(r, r[1]) for r in own])
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top, out = levels_of([trees[s][1][-1][0] for s in names]), []
    for k, s in enumerate(names):
        own, levels = trees[s]
        for i, r in enumerate(own):
            path = [*path_of(levels, i), *path_of(top, k)]
            text = r[1].replace("\n", "") if r[1] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            folded = leaf(r, text)
            for at, others in path:
                folded = digest(*others[:at], folded, *others[at:])
            out.append((r[0], levels[0][i], levels[-1][0], top[-1][0], digest(*(x for _, others in path for x in others)), folded, folded == top[-1][0]))
    return out


def rows_of(sizes):
    rng, out = random.Random(4), []
    for k, size in enumerate(sizes):
        for _ in range(size):
            i = len(out)
            out.append((i, rng.choice(["a\nb", "x", "", None, f"line {i}\n", "ж\n漢"]), rng.choice(["en", None]), f"s{k}é" if k else None, rng.choice([i, None])))
    rng.shuffle(out)
    return out + [(3, "same id", "en", "s1é", 1), (3, "same id", "en", "s1é", 1), (None, "no\nid", None, "s1é", 2), (None, None, None, "", None)]


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_proofs_equal_those_built_by_hand(spark, levels):
    """Trees of one leaf, of exactly a pack, of several packs and heights; nulls, repeated rows, a clashing column."""
    rows = rows_of([1, 2, 3, 4, 9, 10, 28, 81, 90])
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit(1)).withColumn("idx", F.lit("x"))
    got = manifest_proofs(docs, F.when(crc_mod("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))), levels=levels)
    assert got.columns == COLUMNS
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, by_hand(rows)))


def test_without_tampering_all_is_verified(spark):
    docs = spark.createDataFrame(rows_of([5, 30]), SCHEMA)
    assert manifest_proofs(docs).where("not verified").isEmpty()
    assert manifest_proofs(docs.where("false")).collect() == []
    alone = manifest_proofs(docs.where("doc_id = 7")).first()
    assert alone["leaf"] == alone["subroot"] == alone["root"] and alone["proof_sha256"] == digest("")


def test_some_leaves_are_requested(spark):
    leaves = spark.createDataFrame([("t", i, digest(str(i))) for i in range(100)], "tree string, id long, digest string")
    forest = build(Shelf(spark), leaves, ["id"], 2)
    start = forest.roots.select("tree", "digest", F.array().cast("array<struct<d:int,s:array<string>>>").alias("path"))
    got = descend(forest, forest.leaves.where("id in (0, 57, 99)").select("tree", "idx", "n", "id"), start, ["id"]).collect()
    levels = levels_of([digest(str(i)) for i in range(100)])
    assert {r["id"]: [(x["d"], x["s"]) for x in reversed(r["path"])] for r in got} == {i: list(path_of(levels, i)) for i in (0, 57, 99)}
    assert {r["top"] for r in got} == {levels[-1][0]}
