"""Library functions on literal rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from moothall.functions import ids, texts
from moothall.operators import relational as R
from moothall.operators import search
from moothall.operators.merge import insert_absent, replace_children, upsert
from moothall.operators.opinions import cluster_opinions, cluster_results, group_count, participants, positions
from moothall.sources.pages import rows_of


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def sha(text, n=16):
    return hashlib.sha256(text.encode()).hexdigest()[:n]


LONG = "Ordinance amending the zoning code of the city"


@pytest.mark.parametrize(("file", "vendor", "title", "key"), [
    ("25-1", "v", LONG, "c:file:25-1"), ("", "v", LONG, "c:id:v"), (None, None, f"FIRST READING:  {LONG}", f"c:title:{LONG.lower()}"), (None, "", f"reintroduced first reading: {LONG} ", f"c:title:{LONG.lower()}"),
    (None, None, "Public Comment", None), (None, None, "FIRST READING: a short title here", None), (None, None, None, None),
])
def test_matter_id(spark, file, vendor, title, key):
    lit = lambda x: F.lit(x).cast("string")
    assert one(spark, ids.matter_id(F.lit("c"), lit(file), lit(vendor), lit(title))) == (key and f"c_{sha(key)}")


def test_attachment_hash_ignores_order(spark):
    a, b = (F.struct(F.lit(u).alias("url"), F.lit(n).alias("name")) for u, n in (("u1", "n1"), ("u2", "n2")))
    x, y, z = one(spark, ids.attachments_hash(F.array(a, b))), one(spark, ids.attachments_hash(F.array(b, a))), one(spark, ids.attachments_hash(F.array(a)))
    assert x == y != z
    assert one(spark, ids.attachments_hash(F.slice(F.array(a), 1, 0))) == ""


@pytest.mark.parametrize(("title", "date", "status"), [("Meeting CANCELLED", None, "cancelled"), ("cancelled", "Postponed", "postponed"), ("Deferred and updated", None, "revised"), ("Council", "May 1", None), (None, None, None)])
def test_status(spark, title, date, status):
    assert one(spark, texts.meeting_status(F.lit(title).cast("string"), F.lit(date).cast("string"))) == status


def test_text_functions(spark):
    assert one(spark, texts.strip_html(F.lit("<p>A&amp;B<br/>c &#8211;  d</p>"))) == "A&B c – d"
    assert one(spark, texts.strip_markdown(F.lit("## T\n**b** *i* [x](u) `c`"))) == "T b i x c"
    assert one(spark, texts.attachment_type(F.lit("http://x/a.DOCX"), F.lit(None).cast("string"))) == "doc"
    assert one(spark, texts.highlight(F.lit("a<b Red"), "red")) == "a&lt;b <mark>Red</mark>"
    assert one(spark, texts.truncate(F.lit("one two, three"), 9)) == "one two..."
    assert one(spark, texts.is_test_meeting(F.lit("Mock hearing")))
    assert not one(spark, texts.is_test_meeting(F.lit("Testimony")))
    assert not one(spark, texts.is_readable(F.lit(None).cast("string")))


@pytest.mark.parametrize(("form", "iso"), [("5/7/2024", "2024-05-07 00:00:00"), ("Tuesday, May 7, 2024", "2024-05-07 00:00:00"), ("May 7, 2024 6:30 PM", "2024-05-07 18:30:00"), ("2024-05-07T09:00:00", "2024-05-07 09:00:00"), ("soon", None)])
def test_dates(spark, form, iso):
    got = one(spark, texts.parse_date(F.lit(form)))
    assert (got and str(got)) == iso


def test_tally_and_outcome(spark):
    votes = spark.createDataFrame([(1, "Aye"), (1, " yes"), (1, "nay"), (1, "recused"), (1, "what"), (2, None)], "m int, vote string")
    got = {r["m"]: r for r in R.vote_tally(votes, ["m"]).withColumn("o", R.vote_outcome(F.col("yes"), F.col("no"))).collect()}
    assert (got[1]["yes"], got[1]["no"], got[1]["abstain"], got[1]["present"], got[1]["o"]) == (2, 1, 1, 1, "passed")
    assert (got[2]["present"], got[2]["o"]) == (1, "no_vote")


def test_validity_is_half_open(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 1, None), (3, 5, None)], "id int, joined_at int, left_at int")
    assert {r["id"] for r in R.valid_at(df, F.lit(5)).collect()} == {2, 3}


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a", "s", 3), (2, "b", None, 9)], "id int, title string, summary string, n int")
    new = spark.createDataFrame([(1, "A", None, 1), (3, "c", None, 1)], "id int, title string, summary string, n int")
    merge = lambda x: upsert(x, new, ["id"], keep=["summary"], frozen=["title"], frozen_when="summary", largest=["n"])
    once = sorted(map(tuple, merge(old).collect()), key=str)
    assert once == sorted([(1, "a", "s", 3), (2, "b", None, 9), (3, "c", None, 1)], key=str)
    assert sorted(map(tuple, merge(merge(old)).collect()), key=str) == once


def test_insert_and_replace(spark):
    old = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "id int, t string")
    assert insert_absent(old, spark.createDataFrame([(1, "z"), (3, "z")], "id int, t string"), ["id"]).count() == 4
    assert sorted(map(tuple, replace_children(old, spark.createDataFrame([(1, "q"), (1, "q")], "id int, t string"), "id").collect())) == [(1, "q"), (2, "x")]


def test_search(spark):
    df = spark.createDataFrame([(1, "The cities voted on housing"), (2, "A city"), (3, None)], "id int, t string").withColumn("k", search.tokens(F.col("t")))
    assert {r["id"] for r in search.match_all(df, "k", "house vote").collect()} == set()
    assert {r["id"] for r in search.match_all(df, "k", "Voting").collect()} == {1}
    assert search.match_all(df, "k", "the of").count() == 0
    assert "<mark>housing</mark>" in one(spark, search.headline(F.lit("voted on housing today"), ["housing"]))


@pytest.mark.parametrize(("word", "root"), [("meetings", "meet"), ("caresses", "caress"), ("ponies", "poni"), ("agreed", "agree"), ("plastered", "plaster"), ("hopping", "hop"), ("happy", "happi"), ("sky", "sky")])
def test_stem(word, root):
    assert search.stem(word) == root


def test_opinion_clusters(spark, tmp_path):
    votes = [(1, u, c, 1 if (u < 5) == (c < 3) else -1) for u in range(10) for c in range(6)] + [(2, 1, 1, 1), (3, None, 1, 1), (None, 1, 1, 1)]
    df = spark.createDataFrame(votes, "deliberation long, user_id long, comment_id long, vote int")
    clusters = cluster_opinions(df, str(tmp_path / "a"))
    got = clusters.toPandas()
    assert set(got.deliberation) == {1}
    assert got.groupby("user_id").cluster.first().tolist() == [0] * 5 + [1] * 5
    assert [group_count(n) for n in (3, 12, 100)] == [2, 3, 5]
    row = cluster_results(df, clusters).collect()
    assert [(r.deliberation, r.n_participants, r.n_comments, r.k, len(r.cluster_centers)) for r in row] == [(1, 10, 6, 2, 2)]
    assert {round(c.consensus, 6) for c in row[0].consensus} == {round((6 / 7 + 1 / 7) / 2, 6)}
    assert got.settled.all()
    assert cluster_opinions(df.limit(0), str(tmp_path / "b")).count() == 0
    assert [tuple(r) for r in participants(df).collect()] == [(1, 10, 6)]


def test_positions(spark, tmp_path):
    """Those of the clusters; all 0 where all vote alike; none below the guard."""
    votes = [(1, u, c, 1 if (u < 5) == (c < 3) else -1) for u in range(10) for c in range(6)] + [(2, u, c, 1) for u in range(4) for c in range(3)] + [(3, 1, 1, 1), (3, 2, 2, 1), (4, 1, None, 1)]
    df = spark.createDataFrame(votes, "deliberation long, user_id long, comment_id long, vote int")
    got = {(r.deliberation, r.user_id): (round(r.x, 6), round(r.y, 6)) for r in positions(df, str(tmp_path / "a")).collect()}
    assert got == {(r.deliberation, r.user_id): (round(r.x, 6), round(r.y, 6)) for r in cluster_opinions(df, str(tmp_path / "b")).collect()}
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, u): (0.0, 0.0) for u in range(4)} and {k[0] for k in got} == {1, 2}


def test_steps_that_run_out_are_told(spark, tmp_path):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(1, u, c, int(rng.integers(-1, 2))) for u in range(80) for c in range(6)], "deliberation long, user_id long, comment_id long, vote int")
    one, many = (cluster_opinions(df, str(tmp_path / str(n)), steps=n).toPandas() for n in (1, 100))
    assert not one.settled.any() and many.settled.all() and len(one) == len(many) == 80


def test_opinion_clusters_against_numpy(spark, tmp_path):
    """Positions equal those of a singular value decomposition, and no user is nearer to another group's mean than to its own."""
    rng = np.random.default_rng(3)
    full = np.where(rng.random((60, 7)) < 0.3, np.nan, rng.integers(-1, 2, (60, 7)))
    full[:, 6] = np.where(rng.random(60) < 0.5, np.nan, 1)
    df = spark.createDataFrame([(1, u, c, int(full[u, c])) for u in range(60) for c in range(7) if not np.isnan(full[u, c])], "deliberation long, user_id long, comment_id long, vote int")
    clusters = cluster_opinions(df, str(tmp_path / "a"))
    got = clusters.toPandas().sort_values("user_id")
    assert got.user_id.tolist() == list(range(60))
    m = np.where(np.isnan(full), np.nanmean(full, axis=0), full)
    x = m - m.mean(0)
    vt = np.linalg.svd(x, full_matrices=False)[2][:2]
    vt *= np.sign(vt[np.arange(2), np.abs(vt).argmax(1)])[:, None]
    assert np.allclose(got[["x", "y"]], x @ vt.T, atol=1e-6)
    label = got.cluster.to_numpy()
    centres = np.array([m[label == k].mean(0) for k in range(label.max() + 1)])
    d = ((m[:, None] - centres) ** 2).sum(2)
    assert np.allclose(d.min(1), d[np.arange(60), label])
    votes = {(v.cluster, v.comment_id): (v.agree, v.disagree, v.seen) for v in cluster_results(df, clusters).collect()[0].group_votes}
    assert votes == {(k, c): ((m[label == k, c] == 1).sum(), (m[label == k, c] == -1).sum(), (label == k).sum()) for k in range(label.max() + 1) for c in range(7)}


def test_pages():
    rows = rows_of("<h1>A <b>b</b></h1><script>x</script><p>one <a href='/q'>two</a></p>", "http://h/x")
    assert rows == [("heading", "A b", None), ("link", "two", "http://h/q"), ("block", "one two", None)]
    assert rows_of(None, None) == []
