"""Fingerprints, features and a step of training against plain Python, and the pipeline's stages on edge rows."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_edges import EXTRA, LONG, ROWS

import corpus_pipeline
from moothall.llm import imatch, langid
from moothall.llm.common import mix

SF = "/root/testdata/sf0.001"
ALL = (1 << 64) - 1


def plain_print(text, band):
    """Hash by hash: which terms of the band a subset holds, sorted, joined and hashed."""
    found = sorted(imatch.terms(text) & band)
    if not found:
        return None
    out = []
    for k in range(imatch.SCALES * imatch.EACH):
        limit = int(4.0 ** -(k // imatch.EACH + 1) * 2**64)
        held = [t for t in found if int(mix(np.array([xxhash.xxh3_64_intdigest(t) + (k + 1) * 0x9E3779B97F4A7C15 & ALL], np.uint64))[0]) < limit]
        out.append(f"{xxhash.xxh3_64_intdigest(b' '.join(held)) % 2**24:06x}" if held else "000000")
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if a is None or b is None:
        return 0.0
    for scale in range(imatch.SCALES - 1, -1, -1):
        held = [(x, y) for x, y in list(zip(a, b, strict=True))[scale * imatch.EACH : (scale + 1) * imatch.EACH] if (x, y) != ("000000", "000000")]
        if len(held) >= imatch.EACH // 2 or (scale == 0 and held):
            return sum(x == y for x, y in held) / len(held)
    return 0.0


def test_fingerprints_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()
    count = Counter(t for _, text in rows for t in imatch.terms(text))
    full = sum(bool(text) for _, text in rows)
    band = {t for t, c in count.items() if max(2, imatch.LEAST * full) <= c <= max(2, imatch.MOST * full)}
    assert set(imatch.lexicon(docs)) == band and band
    got = {r["doc_id"]: r for r in imatch.fingerprint_documents(docs, spark.sparkContext.broadcast(sorted(band))).collect()}
    for k in range(0, len(rows), 4):
        (i, text), (_, after) = rows[k], rows[(k + 1) % len(rows)]
        cut = len(text) // 4
        own, edited, near = plain_print(text, band), plain_print(text[: len(text) - cut] + after[:cut], band), plain_print(after, band)
        for value, want in ((got[i]["fingerprint"], own), (got[i]["edited_fingerprint"], edited)):
            assert value == "".join(want) if want else value.startswith("x")
        assert got[i]["near_next"] == pytest.approx(plain_likeness(own, near)) and got[i]["near_edited"] == pytest.approx(plain_likeness(own, edited))


def test_features_by_hand():
    vocabulary = [b"a", b"the", "straße".encode(), "漢".encode(), b"x" * 30]
    word, slot = langid.features(vocabulary)
    want = []
    for i, w in enumerate(vocabulary):
        m = b"^" + w + b"$"
        for n in range(1, langid.LONGEST + 1):
            for j in range(len(m) - n + 1):
                want.append((i, int(mix(np.array([int.from_bytes(m[j : j + n], "big") + (n << 40) & ALL], np.uint64))[0]) % langid.SLOTS))
    assert sorted(zip(word.tolist(), slot.tolist(), strict=True)) == sorted(want)


def test_a_step_of_training_by_hand():
    """From nothing the model expects each pair alike, so that the first gradient is counts less their mean."""
    seqs = [[(b"le", 0), (b"chat", 0), (b"cat", 1), (b"cat", 1)], [(b"the", 1), (b"cat", 1), (b"le", 0)]]
    model = langid.train(seqs, ["en", "fr"], steps=1, rate=0.3, common=3)
    step = lambda g: 0.3 * g / math.sqrt(1e-6 + g * g)
    seen = Counter((a[1], b[1]) for s in seqs for a, b in zip(s, s[1:], strict=False))
    want = [[step(seen[i, j] - 5 / 4) for j in range(2)] for i in range(2)]
    assert np.allclose(model.transitions, want)
    assert set(model.lexicon) == {b"cat"} and np.allclose(model.lexicon[b"cat"], [step(0 - 1.5), step(3 - 1.5)])
    more = langid.train(seqs, ["en", "fr"], steps=30)
    e = more.emissions([b"le", b"cat"])
    assert e[0].argmax() == 0 and e[1].argmax() == 1


def test_the_sample_of_long_texts(spark):
    w = [f"w{i}".encode() for i in range(10_000)]
    some = langid.stretches(w, 400)
    assert len(some) == 400 and some[:40] == w[:40] and some[-40:] == w[-40:] and langid.stretches(w, 10_000) == w
    rows = [(i, " ".join(["chat noir"] * 3000 + ["x" * 5000]) if i % 2 else "the black cat", "fr" if i % 2 else "en") for i in range(40)] + [(1, "chat noir", "fr")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_langid(df, rows=5, most=80)
    assert model.languages == ["en", "fr"] and b"x" * 5000 not in model.lexicon
    assert {r["lang_pred"] for r in langid.predict_language(df.where("lang = 'fr'"), model).collect()} == {"fr"}


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate([*EXTRA, "component_id", "n_shingles", "__score"])))


def listed(df):
    return sorted(str((r["doc_id"], r["text"] and len(r["text"]), r["text"] and r["text"][:50])) for r in df.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_edge_rows(spark, edge, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got, none = stage(spark, edge, SF), stage(spark, edge.where("false"), SF)
    assert none.count() == 0 and none.columns == got.columns
    if name == "bpe":
        rows = got.collect()
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
        assert all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (1, 2, 5))
        return
    assert got.columns == edge.columns
    every, kept = Counter(listed(edge)), Counter(listed(got))
    if name == "ngram_jaccard_join":  # one row of those with id 0, and 3 for 3 and 4
        gone = every - kept
        assert sorted(gone.elements()) == sorted([str((0, len(ROWS[0][1]), ROWS[0][1][:50])), str((4, len(LONG) + 4, LONG[:50]))])
    elif name == "toxicity":
        assert not kept - every
    elif name == "benchmark_decontamination":
        assert kept == every
    else:
        assert kept == every and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.collect())


def test_rows_that_share_an_id_with_other_texts(spark):
    """Rows of one id are one document with several texts: each text stays once unless a link to a smaller id drops the id."""
    a, b, c = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (2, c), (3, c), (None, c), (None, c)], "doc_id long, text string")
    got = sorted(str(tuple(r)) for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect())
    assert got == sorted(str(x) for x in [(1, a), (1, b), (2, c), (None, c), (None, c)])
