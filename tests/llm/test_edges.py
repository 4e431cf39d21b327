"""Each operator on nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from moothall.llm.bpe import digests, encode_documents, vocabulary
from moothall.llm.decontaminate import contaminated_regions, decontaminate
from moothall.llm.imatch import fingerprint_documents, lexicon
from moothall.llm.jaccard_join import jaccard_classes
from moothall.llm.langid import fit_langid, predict_language
from moothall.llm.licenses import scan_licenses
from moothall.llm.merkle import manifest_proofs
from moothall.llm.pii import pseudonymise
from moothall.llm.secret_scan import scan_secrets
from moothall.llm.suffix_dedup import repeated_spans
from moothall.llm.toxicity import fit_toxicity, score_toxicity
from moothall.llm.url_filter import filter_urls

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [
    (0, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 1), (1, "", "en", None, 0), (2, None, None, "b", None), (3, LONG, "fr", "a", len(LONG)), (4, LONG + " end", "fr", "a", 1), (5, "\n \t", "en", "a", 3),
    (0, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 1), (None, "no id at all", "en", "a", 1), (None, None, None, None, None), (6, "Straße ЖЖ 漢字 😀 <|endoftext|> ok", "de", "c", 9),
]
EXTRA = ["label", "score", "v", "rank", "component", "id", "token", "guard", "pos", "prediction", "features"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(EXTRA)))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def bench(spark):
    return spark.createDataFrame([(1, "seven eight nine ten eleven twelve"), (2, None), (3, ""), (None, "absent from every document here")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(0, 0), (3, 1), (4, 1), (6, 0), (1, None), (None, 1), (0, 0)], "doc_id long, toxic int")


def prints(df):
    return fingerprint_documents(df, df.sparkSession.sparkContext.broadcast(lexicon(df)))


ONE_EACH = {
    "imatch": prints,
    "toxicity": lambda df: score_toxicity(df, fit_toxicity(df, labels(df.sparkSession))),
    "licenses": scan_licenses,
    "jaccard": jaccard_classes,
    "bpe": lambda df: digests(encode_documents(df, vocabulary())),
    "pii": lambda df: pseudonymise(df, kinds_col="kinds"),
    "langid": lambda df: predict_language(df, fit_langid(df)),
    "secrets": scan_secrets,
    "merkle": manifest_proofs,
}


@pytest.mark.parametrize("name", ONE_EACH)
def test_a_row_for_each_row(docs, empty, name):
    got = ONE_EACH[name](docs).collect()
    assert len(got) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert ONE_EACH[name](empty).count() == 0


def test_defined_results(docs):
    by = lambda df: {r["doc_id"]: r for r in df.where("doc_id is not null").collect()}
    j = by(jaccard_classes(docs))
    assert [j[i]["n_shingles"] for i in (1, 2, 5)] == [0, 0, 0]
    assert [j[i]["component_id"] for i in (0, 1, 2, 3, 4, 5)] == [0, 1, 2, 3, 3, 5]
    lang = by(predict_language(docs, fit_langid(docs)))
    assert [lang[i]["lang_pred"] for i in (1, 2, 5)] == ["und"] * 3
    e = by(digests(encode_documents(docs, vocabulary())))
    assert [e[i]["n_tokens"] for i in (1, 2, 5)] == [0, 0, 0]
    p = by(pseudonymise(docs))
    assert (p[1]["text"], p[2]["text"], p[3]["text"]) == ("", None, LONG)
    f = by(prints(docs))
    assert f[1]["fingerprint"] == f[2]["fingerprint"] == f[5]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in f.values())


def test_spans_of_edge_rows(docs, empty):
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in repeated_spans(docs).collect()}
    assert {(3, 0, 60_000), (4, 0, 60_000)} <= got
    assert {i for i, _, _ in got} == {3, 4}
    assert repeated_spans(empty).count() == 0


def test_contamination_of_edge_rows(spark, docs, empty):
    got = contaminated_regions(docs, bench(spark)).collect()
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in got] == [(0, 1, 0)] * 2
    assert decontaminate(docs, bench(spark)).count() == len(ROWS) - 2
    assert decontaminate(docs, bench(spark)).columns == docs.columns
    assert contaminated_regions(empty, bench(spark)).count() == 0
    assert contaminated_regions(docs, bench(spark).where("false")).count() == 0


def test_urls(spark):
    captures = spark.createDataFrame([(1, "https://a.bad.com/x/y?q", 2), (2, "http://u@A.BAD.com:80", 5), (3, None, 2), (4, "nonsense", 2), (None, "http://good.org/p/q", 2), (1, "https://a.bad.com/x/y?q", 2), (5, "http://bad.com", None)], "page_id long, url string, d int")
    captures = captures.withColumn("fetched_at", F.expr("timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(d)")).withColumn("list", F.lit(1))
    entries = spark.createDataFrame([("spam", "domain", "bad.com", "add", 1), ("spam", "domain", "bad.com", "remove", 4), ("trusted", "prefix", "good.org/p", "add", 0), ("spam", "host", "good.org", "add", 2), ("spam", None, None, None, None), ("spam", "host", "good.org", "add", 2)], "list string, kind string, pattern string, action string, d int")
    entries = entries.withColumn("at", F.expr("timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(d)"))
    got = sorted((str(r["page_id"]), str(r["url"])[:10], r["lists"], r["decision"]) for r in filter_urls(captures, entries).collect())
    assert got == [("1", "https://a.", "spam", "block"), ("1", "https://a.", "spam", "block"), ("2", "http://u@A", "", "keep"), ("3", "None", "", "keep"), ("4", "nonsense", "", "keep"), ("5", "http://bad", "", "keep"), ("None", "http://goo", "spam,trusted", "allow")]
    assert filter_urls(captures, entries.where("false")).where("decision <> 'keep'").count() == 0
    assert filter_urls(captures.where("false"), entries).count() == 0


def test_url_paths_keep_their_case(spark):
    captures = spark.createDataFrame([(1, "http://Example.com/Spam/x"), (2, "http://example.com/spam/x")], "page_id long, url string").withColumn("fetched_at", F.expr("timestamp_ntz'2024-03-01 00:00:00'"))
    entries = spark.createDataFrame([("spam", "prefix", "EXAMPLE.com/Spam", "add")], "list string, kind string, pattern string, action string").withColumn("at", F.expr("timestamp_ntz'2024-02-01 00:00:00'"))
    assert {r["page_id"]: r["decision"] for r in filter_urls(captures, entries).collect()} == {1: "block", 2: "keep"}
