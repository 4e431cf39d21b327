"""Queries of the lasting text index and of the join of close names."""

from __future__ import annotations

from pyspark.sql import functions as F

from moothall.catalog import Catalog
from moothall.operators import fuzzy
from moothall.operators.index import Index, headlines
from moothall.operators.search import STOP
from moothall.plans.registry import civic
from moothall.session import shared_folder

_STOP = "(" + ", ".join(f"'{w}'" for w in sorted(STOP)) + ")"
#: Every word of a text with its place; those that a query could name count for its length.
_WORDS = rf"(SELECT id, lower(w) AS w, p - 1 AS p FROM (SELECT id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS w, generate_subscripts(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), 1) AS p FROM texts))"
_STEMS = "CASE WHEN w IN ('idiot', 'idiots') THEN 'idiot' WHEN w = 'trash' THEN 'trash' WHEN w = 's' THEN 's' END"


def indexed(c: Catalog) -> Index:
    """The texts as they were (those of even ids cut short), then the even ones as they are: a second version replaces the first."""
    index = Index(c.spark, shared_folder(c.spark, "index"))
    even = F.col("id") % 2 == 0
    index.add(c.texts().select("id", F.when(even, F.lit("an idiot's old trash")).otherwise(F.col("text")).alias("text")), 1)
    index.add(c.texts().where(even).select("id", "text"), 2)
    return index


@civic(
    "fts03_bm25",
    f"""WITH t AS {_WORDS}, l AS (SELECT texts.id, count(w) FILTER (w NOT IN {_STOP}) AS size FROM texts LEFT JOIN t USING (id) WHERE text IS NOT NULL GROUP BY 1), s AS (SELECT count(*) AS n, avg(size) AS mean FROM l),
h AS (SELECT id, {_STEMS} AS term, count(*) AS tf FROM t GROUP BY 1, 2 HAVING term IN ('idiot', 'trash')), d AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS rank FROM h JOIN d USING (term) JOIN l USING (id), s GROUP BY id HAVING count(*) = 2""",
)
def _(c: Catalog):
    return indexed(c).search("idiots, the TRASH").select("id", F.round("rank", 6).alias("rank"))


@civic(
    "fts04_headline_windows",
    f"""WITH t AS {_WORDS}, h AS (SELECT id, p, {_STEMS} AS term FROM t), o AS (SELECT id, p, max(CASE WHEN term = 'idiot' THEN p END) OVER w AS a, max(CASE WHEN term = 'trash' THEN p END) OVER w AS b FROM h WHERE term IN ('idiot', 'trash') WINDOW w AS (PARTITION BY id ORDER BY p ROWS UNBOUNDED PRECEDING)),
m AS (SELECT id, min({{'wide': p - least(a, b), 'first': least(a, b), 'last': p}}) AS w FROM o WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY id),
x AS (SELECT id, w.first AS first, w.last AS last, greatest(w.first - 5, 0) AS f, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS words FROM m JOIN texts USING (id))
SELECT id, first, last, array_to_string(list_transform(words[f + 1 : greatest(last, f + 29) + 1], lambda w: CASE WHEN lower(w) IN ('idiot', 'idiots', 'trash') THEN '<mark>' || w || '</mark>' ELSE w END), ' ') AS headline FROM x""",
)
def _(c: Catalog):
    query = "idiot trash"
    return headlines(c.texts().select("id", "text"), indexed(c).windows(query), query)


@civic("jon22_close_names")
def _(c: Catalog):
    """The first label of every page's host as a visitor might mistype it (two letters swapped, or one left out), against all labels."""
    label = F.regexp_extract("url", r"://(?:www\.|m\.)?([^./]+)", 1)
    names = c.table("pages").select(F.initcap(label).alias("name")).where("name <> ''").distinct()
    n = F.length("name")
    swapped = F.concat(F.col("name").substr(F.lit(1), n - 2), F.reverse(F.col("name").substr(n - 1, F.lit(2))))
    shorter = F.concat(F.col("name").substr(F.lit(1), F.lit(2)), F.col("name").substr(F.lit(4), n))
    asked = names.select(F.explode(F.array(swapped, shorter, F.upper("name"))).alias("q"))
    return fuzzy.close_names(asked, names)
