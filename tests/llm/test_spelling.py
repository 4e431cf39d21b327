"""Spelling variants against deletion neighbourhoods in plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from moothall.llm.common import Shelf
from moothall.llm.spelling import count_words, follow, letter_classes, near_pairs, spelling_variants

SCHEMA = "doc_id long, text string"


def counted(rows):
    out = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]+", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                out[w] += 1
    return {w: n for w, n in out.items() if n > 1}


def by_hand(rows):
    n = counted(rows)
    near, gaps = {w: set() for w in n}, defaultdict(set)
    for w in n:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n[w], len(near[w]), n[form[w]] if w in form else 0) for w in n)


def corpus():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeéÿ÷", k=rng.randint(7, 9))) for _ in range(80)] + ["a" * 9, "a" * 8, "ab" * 4, "ba" * 4, "x" * 3000, "x" * 2999 + "y", "x" * 2999, "é" * 5000, "é" * 4999]
    chain = ["abcdefgh", "abcdefgx", "abcdefyx"]
    pool = words + ["".join(w[:i] + rng.choice("abz") + w[i + rng.randint(0, 1) :]) for w in words[:60] for i in [rng.randrange(len(w))]]
    texts = [" ".join(rng.choices(pool, k=60)) for _ in range(60)] + ["-".join([c] * k) for c, k in zip(chain, (700, 60, 4), strict=True)]
    texts += ["Straße ABCDEFG abcdefg ÉcoleÉcole écoleécole 漢字abcdefgİabcdefg", None, "", "short", "\n"]
    return list(enumerate(texts)) + [(3, texts[3]), (3, texts[3]), (None, "orphans orphans orphans")]


def flat(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def test_variants_by_hand(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    want = by_hand(rows)
    assert any(f and r != f for _, f, r, *_ in want) and sum(x[4] for x in want) > 50
    got = spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert flat(got) == want


def test_blocks_of_few_words_give_the_same(spark):
    """A class count's words in several blocks, and one class, in which the blocks are lengths."""
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    want = by_hand(rows)
    assert flat(spelling_variants(docs, block=3, classes=3)) == want
    assert flat(spelling_variants(docs, block=20, classes=1)) == want


def test_empty(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    assert spelling_variants(docs.where("false")).count() == 0
    assert spelling_variants(docs.where("text is null or text = ''")).count() == 0


def test_counts(spark):
    rows = corpus()
    got = {r["word"]: r["n"] for r in count_words(spark.createDataFrame(rows, SCHEMA)).where("n > 1").collect()}
    assert got == counted(rows)


def test_near_pairs_of_matrices():
    code = lambda *w: np.array([list(x.encode("latin-1")) for x in w], np.uint8)
    a, b = code("abcdefg", "abcdegf", "aaaaaaa"), code("abcdefgg", "xabcdefg", "aaaaaaaa", "abdcefgh")
    assert list(zip(*(x.tolist() for x in near_pairs(a, b, False)), strict=True)) == [(0, 0), (0, 1), (2, 2)]
    same = code("abcdefg", "abcdefh", "abcdegf", "abcxefg")
    assert list(zip(*(x.tolist() for x in near_pairs(same, same, True)), strict=True)) == [(0, 1), (0, 3)]


def test_classes_are_even():
    got = letter_classes({"a": 10, "b": 6, "c": 5, "d": 5, "e": 4}, 3)
    load = Counter()
    for c, k in got.items():
        load[k] += {"a": 10, "b": 6, "c": 5, "d": 5, "e": 4}[c]
    assert sorted(load.values()) == [10, 10, 10]


def test_chains_end(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [("z", "w5")], "word string, form string")
    assert {r["word"]: r["root"] for r in follow(Shelf(spark), forms).collect()} == {**{f"w{i}": "w11" for i in range(11)}, "z": "w11"}
