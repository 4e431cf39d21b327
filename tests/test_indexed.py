"""The lasting index, windows of terms, close names and text automata against brute force."""

import random
import re
from difflib import get_close_matches

from pyspark.sql import functions as F

from moothall.operators import fuzzy
from moothall.operators.index import Index, headlines
from moothall.sources import grammars as G


def test_close_names_by_all_pairs(spark):
    rng = random.Random(1)
    names = ["".join(rng.choices("abcde", k=rng.randint(1, 14))) for _ in range(300)]
    asked = {"".join(rng.choices("abcde", k=rng.randint(1, 14))) for _ in range(120)} | {n[:3] + n[4:] + "a" for n in names[:80]} | set(names[:20])
    q = spark.createDataFrame([(x.upper(),) for x in asked] + [(None,), ("",)], "q string")
    got = {}
    for r in fuzzy.close_names(q, spark.createDataFrame([(n,) for n in names + [None, ""]], "name string")).collect():
        got.setdefault(r["q"].lower(), []).append((r["place"], r["name"]))
    for x in asked:
        want = get_close_matches(x, sorted(set(names)), n=5, cutoff=0.8)
        assert [n for _, n in sorted(got.get(x, []))] == ([x] if x in want else want), x


def test_only_the_terms_buckets_are_read(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), 16)
    index.add(spark.createDataFrame([(i, f"common word{i} trash") for i in range(50)], "id long, text string"), 1)
    rows = index.postings(["trash"])
    assert rows.count() == 50
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plan) and re.search(r"PushedFilters: \[[^\]]*(EqualTo|In)\(term", plan)


def test_versions(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), 4)
    index.add(spark.createDataFrame([(1, "trash and idiots"), (2, "trash"), (3, "the trash"), (4, None)], "id long, text string"), 1)
    index.add(spark.createDataFrame([(2, "clean"), (3, None)], "id long, text string"), 2)
    for _ in range(2):  # a version that is written again changes nothing
        index.add(spark.createDataFrame([(5, "Trash, trash!")], "id long, text string"), 3)
    found = lambda q: {r["id"] for r in index.search(q).collect()}
    assert found("trash") == {1, 5} and found("clean") == {2} and found("idiot trash") == {1} and found("the and") == set()
    assert {r["id"]: r["size"] for r in index.lengths().collect()} == {1: 2, 2: 1, 5: 2}
    rank = {r["id"]: r["rank"] for r in index.search("trash").collect()}
    assert rank[5] > rank[1]


def test_windows_by_hand(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "x", "the"], k=rng.randint(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = Index(spark, str(tmp_path / "i"), 8)
    index.add(docs, 1)
    got = {r["id"]: (r["first"], r["last"]) for r in index.windows("alpha beta gamma").collect()}
    for i, t in enumerate(texts):
        w = t.split()
        spans = [(b - a, a, b) for a in range(len(w)) for b in range(a, len(w)) if {"alpha", "beta", "gamma"} <= set(w[a : b + 1])]
        assert got.get(i) == (min(spans)[1:] if spans else None)
    lines = {r["id"]: r["headline"] for r in headlines(docs, index.windows("alpha beta gamma"), "alpha beta gamma", before=2, words=6).collect()}
    for i, (a, b) in got.items():
        w = [f"<mark>{x}</mark>" if x in ("alpha", "beta", "gamma") else x for x in texts[i].split()]
        start = max(a - 2, 0)
        assert lines[i] == " ".join(w[start : max(b, start + 5) + 1])


def test_automaton_by_a_loop(spark):
    """States over block borders are those of a loop over the lines."""
    rng = random.Random(4)
    kinds = ["--- PAGE 2", "H. Section", "H{}. An item", "plain", "", "J3. Again"]
    texts = ["\n".join(rng.choice(kinds).format(rng.randint(1, 9)) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    docs = spark.createDataFrame([*enumerate(texts), (99, None), (100, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["line"]): (r["class"], r["state"]) for r in G.read_lines(docs, G.LETTERED, block=4).collect()}
    for i, t in enumerate(texts):
        state = "cover"
        for n, line in enumerate(t.split("\n")):
            kind = "page" if line.startswith("---") else "section" if line.startswith("H. ") else "item" if line[:1] in "HJ" and line else "other"
            state = G.LETTERED.moves.get((state, kind), state)
            assert got[i, n] == (kind, state)
    assert (99, 0) not in got and got[100, 0] == ("other", "cover")


def test_items_of_a_text(spark):
    text = "Cover\nH1. no\n--- PAGE 1\nH. Talks\nH1.   First \n one\n\ntwo\nH2. Second\n--- PAGE 2\nstray\nH1. First again\nH3. Third"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    links = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 10, "c"), (1, 12, "d")], "doc_id long, line int, url string")
    got = [(r["sequence"], r["number"], r["title"], r["body"], list(r["links"])) for r in G.text_items(docs, G.LETTERED, links).orderBy("sequence").collect()]
    assert got == [(1, "H1", "First", "one\ntwo", ["a", "b"]), (2, "H2", "Second", "", []), (3, "H3", "Third", "", ["d"])]
    assert G.text_items(docs.where(F.lit(False)), G.RECORDS).count() == 0


def test_runs_of_words_in_one_walk():
    """Words of long windows, by batches whose words go to Arrow in several lots."""
    import pyarrow as pa

    from moothall.operators import index

    text = "é trash idiots the " * 500
    part = pa.array([text, None, text] * 20), pa.array([3, 0, 1998] * 20), pa.array([1999, 5, 5000] * 20)
    (got,) = index._runs(iter([part]))
    words, stems = text.split(), ["é", "trash", "idiot", None] * 500
    assert got.to_pylist() == [[{"t": t, "w": w} for t, w in zip(stems[a:b], words[a:b])] for a, b in ((3, 2000), (0, 0), (1998, 2000))] * 20


def test_automata_move_lines_twice(spark):
    texts = spark.createDataFrame([(1, "O2025-0000001 x\nbody")], "doc_id long, text string")
    links = spark.createDataFrame([(1, 1, "u"), (1, 9, "none")], "doc_id long, line int, url string")
    items = G.text_items(texts, G.RECORDS, links)
    assert items._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(doc_id") <= 3
    assert [r["links"] for r in items.collect()] == [["u"]]
