"""Opinion clustering: two-dimensional positions, groups of like voters, and consensus.

Voters are rows that Spark partitions at will. Only what belongs to the
comments of one deliberation meets in a task: their products (the square of
the comments) and at most five centres for each start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_GROUPS = 5


def group_count(users: int) -> int:
    """How many groups so many users are split in."""
    return max(2, min(2 + users // 12, MOST_GROUPS, users))


def _groups(users: Column) -> Column:
    return F.greatest(F.lit(2), F.least(2 + F.floor(users / 12), F.lit(MOST_GROUPS), users)).cast("int")


def _clean(votes: DataFrame, by: str) -> DataFrame:
    return votes.select(by, "user_id", "comment_id", F.col("vote").cast("double").alias("vote")).dropna().groupBy(by, "user_id", "comment_id").agg(F.max("vote").alias("vote"))


def _centred(v: DataFrame, by: str) -> DataFrame:
    """(by, user_id, users, row): votes less their comment's mean, in order of the comments, 0 where there is none."""
    means = v.groupBy(by, "comment_id").agg(F.avg("vote").alias("mean"))
    comments = means.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("comment_id", "mean"))).alias("comments")).where(F.size("comments") >= 2)
    users = v.groupBy(by, "user_id").agg(F.map_from_entries(F.collect_list(F.struct("comment_id", "vote"))).alias("own"))
    sizes = users.groupBy(by).agg(F.count("*").alias("users")).where("users >= 3")
    row = F.transform("comments", lambda c: F.coalesce(F.try_element_at("own", c["comment_id"]) - c["mean"], F.lit(0.0)))
    return users.join(comments.join(sizes, by), by).select(by, "user_id", "users", row.alias("row"))


def imputed(votes: DataFrame, by: str = "deliberation") -> DataFrame:
    """(deliberation, user_id, comment_id, vote): every user of a deliberation on each of its comments, a missing vote being the comment's mean.

    The comments of a deliberation are one row with an array, which its users
    are joined with by key; Spark sends that side everywhere only where its
    measured size allows it. Rows with a null are left out, and of repeated
    votes the highest counts.
    """
    v = _clean(votes, by)
    means = v.groupBy(by, "comment_id").agg(F.avg("vote").alias("mean")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("comment_id", "mean"))).alias("comments"))
    users = v.groupBy(by, "user_id").agg(F.map_from_entries(F.collect_list(F.struct("comment_id", "vote"))).alias("own"))
    cells = users.join(means, by).select(by, "user_id", "own", F.explode("comments").alias("c"))
    return cells.select(by, "user_id", F.col("c.comment_id").alias("comment_id"), F.coalesce(F.try_element_at("own", F.col("c.comment_id")), F.col("c.mean")).alias("vote"))


def _axes(rows: DataFrame, by: str) -> DataFrame:
    """(by, axes): the two principal directions of each deliberation's rows, the largest loading of each positive."""
    kind = rows.schema[by].dataType.simpleString()

    def products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for key, g in pdf.groupby(by):
                m = np.stack(g["row"].to_list())
                yield pd.DataFrame({by: key, "i": range(m.shape[1]), "product": list(m.T @ m)})

    def directions(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf.i.max()) + 1
        gram = np.zeros((n, n))
        gram[pdf.i, pdf.j] = pdf["sum"]
        at = np.linalg.eigh(gram)[1][:, ::-1][:, :2].T
        at = at * np.where(at[np.arange(2), np.abs(at).argmax(1)] < 0, -1.0, 1.0)[:, None]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "axes": [[x.tolist() for x in at]]})

    cells = rows.select(by, "row").mapInPandas(products, f"`{by}` {kind}, i int, product array<double>").select(by, "i", F.posexplode("product").alias("j", "p"))
    return cells.groupBy(by, "i", "j").agg(F.sum("p").alias("sum")).groupBy(by).applyInPandas(directions, f"`{by}` {kind}, axes array<array<double>>")


def _along(k: int) -> Column:
    return _total(F.zip_with("row", F.col("axes")[k], lambda a, b: a * b))


def participants(votes: DataFrame, by: str = "deliberation") -> DataFrame:
    """(deliberation, users, comments) of the deliberations that can be clustered: at least three users who voted and two comments; rows with a null are left out."""
    v = votes.select(by, "user_id", "comment_id", "vote").dropna()
    return v.groupBy(by).agg(F.count_distinct("user_id").alias("users"), F.count_distinct("comment_id").alias("comments")).where("users >= 3 and comments >= 2")


def positions(votes: DataFrame, folder: str, by: str = "deliberation") -> DataFrame:
    """(deliberation, user_id, x, y): the two centred principal components of each user's votes, as in cluster_opinions; all 0 where all users vote alike."""
    rows = _centred(_clean(votes, by), by)
    rows.write.parquet(f"{folder}/rows")
    rows = votes.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")
    return rows.join(_axes(rows, by), by).select(by, "user_id", _along(0).alias("x"), _along(1).alias("y"))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _nearest(row: str, centres: str) -> Column:
    """The least (squared distance, number) of the centres."""
    return F.array_min(F.transform(centres, lambda c, i: F.named_struct(F.lit("d"), _total(F.zip_with(row, c, lambda a, b: (a - b) * (a - b))), F.lit("label"), i)))


def _starts(rows: DataFrame, by: str, tries: int, seed: int) -> DataFrame:
    """(by, start, centres): for each start as many rows as there are groups, picked by a hash of the user."""
    order = Window.partitionBy(by, "start").orderBy(F.xxhash64(F.lit(seed), "start", "user_id"), "user_id")
    ranked = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST_GROUPS)
    picked = ranked.where(F.col("rank") <= _groups(F.col("users"))).groupBy(by, "start").agg(F.sort_array(F.collect_list(F.struct("rank", "row"))).alias("p"))
    return picked.select(by, "start", F.transform("p", lambda x: x["row"]).alias("centres"))


def _sums(near: DataFrame, by: str) -> DataFrame:
    """(by, start, label, n, sums) of rows (by, row, labels): the rows of each label of each start added up, a batch at a time."""
    kind = near.schema[by].dataType.simpleString()

    def added(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for key, g in pdf.groupby(by):
                m, labels = np.stack(g["row"].to_list()), np.stack(g["labels"].to_list())
                cells = [(start, k, labels[:, start] == k) for start in range(labels.shape[1]) for k in np.unique(labels[:, start])]
                yield pd.DataFrame({by: key, "start": [c[0] for c in cells], "label": [c[1] for c in cells], "n": [c[2].sum() for c in cells], "sums": [m[c[2]].sum(0) for c in cells]})

    return near.mapInPandas(added, f"`{by}` {kind}, start int, label int, n long, sums array<double>")


def _moved(rows: DataFrame, state: DataFrame, by: str) -> DataFrame:
    """One step of Lloyd's algorithm on a deliberation's starts (by, moving, still); a centre without rows stays where it is.

    moving and still are lists of (start, centres); a start none of whose
    centres moves goes over to still and is looked at no more.
    """
    labels = F.transform("moving", lambda s: _nearest("row", s["centres"])["label"])
    near = rows.select(by, "row").join(state.where(F.size("moving") > 0).select(by, "moving"), by).select(by, "row", labels.alias("labels"))
    cells = _sums(near, by).select(by, "start", "label", "n", F.posexplode("sums").alias("at", "x")).groupBy(by, "start", "label", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    means = cells.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("start", "label", "at", "x"))).alias("new"))

    def mean(c: Column, nth: Column, i: Column) -> Column:
        own = F.transform(F.filter("new", lambda m: (m["start"] == nth) & (m["label"] == i)), lambda m: m["x"])
        return F.when(F.size(own) > 0, own).otherwise(c)

    far = lambda a, b: F.exists(F.zip_with(a, b, lambda p, q: _total(F.zip_with(p, q, lambda x, y: F.abs(x - y)))), lambda d: d > 1e-8)
    after = F.transform("moving", lambda s, nth: F.struct(s["start"].alias("start"), F.transform(s["centres"], lambda c, i: mean(c, nth, i)).alias("centres"), s["centres"].alias("before")))
    told = state.join(means, by, "left").withColumn("after", after).withColumn("after", F.transform("after", lambda s: F.struct(s["start"].alias("start"), s["centres"].alias("centres"), far(s["before"], s["centres"]).alias("far"))))
    of = lambda when: F.transform(F.filter("after", when), lambda s: F.struct(s["start"].alias("start"), s["centres"].alias("centres")))
    return told.select(by, of(lambda s: s["far"]).alias("moving"), F.concat("still", of(lambda s: ~s["far"])).alias("still"))


def cluster_opinions(votes: DataFrame, folder: str, by: str = "deliberation", tries: int = 10, steps: int = 100, seed: int = 42) -> DataFrame:
    """Rows (deliberation, user_id, x, y, cluster, settled) of the votes (deliberation, user_id, comment_id, vote), a missing vote being its comment's mean.

    Positions are the two centred principal components; groups come from
    Lloyd's algorithm on all comments, the best of some starts, and are
    numbered by their smallest user. settled tells whether the centres of the
    start that was chosen came to rest within the steps; if not, they are those
    of the last step. Deliberations of fewer than three users or two comments
    have no rows, rows with a null are left out, and of repeated votes on one
    comment the highest counts. Each step's centres are written under the
    folder, which all executors must share.
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    rows = kept(_centred(_clean(votes, by), by), "rows")
    begun = _starts(rows, by, tries, seed).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("start", "centres"))).alias("moving"))
    state = kept(begun.withColumn("still", F.slice("moving", 1, 0)), "start")
    for n in range(steps):
        state = kept(_moved(rows, state, by), f"step-{n}")
        if state.where(F.size("moving") > 0).isEmpty():
            break
    listed = lambda name, settled: state.select(by, F.explode(name).alias("s")).select(by, "s.*", F.lit(settled).alias("settled"))
    centres = listed("still", True).unionByName(listed("moving", False))
    cost = rows.join(centres, by).select(by, "start", "centres", "settled", _nearest("row", "centres")["d"].alias("d")).groupBy(by, "start", "centres", "settled").agg(F.round(F.sum("d"), 6).alias("cost"))
    best = cost.groupBy(by).agg(F.min_by(F.struct("centres", "settled"), F.struct("cost", "start")).alias("b")).select(by, "b.*")
    placed = kept(rows.join(best, by).join(_axes(rows, by), by).select(by, "user_id", "settled", _along(0).alias("x"), _along(1).alias("y"), _nearest("row", "centres")["label"].alias("label")), "placed")
    first = placed.groupBy(by, "label").agg(F.min("user_id").alias("first"))
    numbers = first.select(by, "label", (F.row_number().over(Window.partitionBy(by).orderBy("first")) - 1).cast("long").alias("cluster"))
    return placed.join(numbers, [by, "label"]).select(by, "user_id", "x", "y", "cluster", "settled")


def cluster_results(votes: DataFrame, clusters: DataFrame, by: str = "deliberation") -> DataFrame:
    """One row for each clustered deliberation: counts, centres, consensus of each comment, and the groups' votes.

    A missing vote counts as its comment's mean, so it agrees (disagrees) where
    all who voted agree (disagree). Consensus is the mean over the groups of
    (agreeing + 1) / (members + 2). Users' positions and groups stay rows of
    `cluster_opinions`, because a row has no room for any number of users.
    """
    v = _clean(votes, by)
    groups = clusters.groupBy(by, "cluster").agg(F.count("*").alias("seen"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    means = v.groupBy(by, "comment_id").agg(F.avg("vote").alias("mean"))
    cast = v.join(clusters.select(by, "user_id", "cluster"), [by, "user_id"]).groupBy(by, "cluster", "comment_id").agg(F.count("*").alias("n"), F.count_if(F.col("vote") == 1).alias("a"), F.count_if(F.col("vote") == -1).alias("d"))
    grid = groups.join(means, by).join(cast, [by, "cluster", "comment_id"], "left").fillna(0, ["n", "a", "d"])
    rest = F.col("seen") - F.col("n")
    cells = grid.select(by, "cluster", "comment_id", "seen", (F.col("a") + F.when(F.col("mean") == 1, rest).otherwise(0)).alias("agree"), (F.col("d") + F.when(F.col("mean") == -1, rest).otherwise(0)).alias("disagree"))
    agreed = cells.groupBy(by, "comment_id").agg(F.avg((F.col("agree") + 1) / (F.col("seen") + 2)).alias("consensus")).groupBy(by).agg(F.count("*").alias("n_comments"), F.sort_array(F.collect_list(F.struct("comment_id", "consensus"))).alias("consensus"))
    listed = cells.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("cluster", "comment_id", "agree", "disagree", "seen"))).alias("group_votes"))
    size = groups.groupBy(by).agg(F.sum("seen").alias("n_participants"), F.sort_array(F.collect_list(F.struct("cluster", "x", "y"))).alias("cluster_centers"))
    return size.join(agreed, by).join(listed, by).select(by, "n_participants", "n_comments", _groups(F.col("n_participants")).alias("k"), "cluster_centers", "consensus", "group_votes")
