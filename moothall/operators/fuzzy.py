"""Close names without comparing all pairs: an index of segments, joined by equality, then the ratio."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _cut(length: str, parts: str, i: str) -> str:
    """Where the i-th of so many almost equal parts of a length begins, from 0."""
    return f"cast(floor({length} * {i} / {parts}) as int)"


def segment_index(names: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """(name, l, tau, i, part): the lower-cased distinct names, cut in tau + 1 parts for each number tau of insertions and deletions that a close query may need.

    A ratio of at least c over lengths l and q leaves at most (1 - c) (l + q)
    letters unmatched, and q lies between c / (2 - c) and (2 - c) / c times l.
    """
    low = names.select(F.lower("name").alias("name")).where("name is not null and name <> ''").distinct().withColumn("l", F.length("name"))
    c = cutoff
    few, most = F.floor((1 - c) * (F.col("l") + F.ceil(F.col("l") * c / (2 - c) - 1e-9)) + 1e-9), F.floor((1 - c) * (F.col("l") + F.floor(F.col("l") * (2 - c) / c + 1e-9)) + 1e-9)
    taus = low.withColumn("tau", F.explode(F.sequence(few.cast("int"), F.least(most.cast("int"), F.col("l") - 1))))
    parts = taus.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tau"))))
    at, end = _cut("l", "(tau + 1)", "i"), _cut("l", "(tau + 1)", "(i + 1)")
    return parts.withColumn("part", F.expr(f"substring(name, {at} + 1, {end} - {at})"))


def _ratios(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        matcher, out = SequenceMatcher(), []
        for x, y in zip(a, b, strict=True):
            matcher.set_seq2(x)
            matcher.set_seq1(y)
            out.append(matcher.ratio())
        yield pd.Series(out, dtype=float)


def close_names(queries: DataFrame, names: DataFrame, cutoff: float = 0.8, most: int = 5) -> DataFrame:
    """(q, name, ratio, place): for each query text the names of ratio at least cutoff, best first, up to `most`; an equal name stands alone.

    The ratio is twice the letters in matching blocks (the longest first, then
    those on either side) over both lengths, case aside. If a pair needs tau
    insertions and deletions, one of the name's tau + 1 segments stands in the
    query unharmed, moved by at most tau: queries look up their substrings at
    those places, so that no pair is missed and only names that share a
    segment are compared. Of equal ratios the larger name is first. Null and
    empty queries have no row.
    """
    index = segment_index(names, cutoff)
    c = cutoff
    asked = queries.select("q").where("q is not null and q <> ''").distinct().withColumn("low", F.lower("q")).withColumn("n", F.length("low"))
    short, long = F.ceil(F.col("n") * c / (2 - c) - 1e-9).cast("int"), F.floor(F.col("n") * (2 - c) / c + 1e-9).cast("int")
    sized = asked.withColumn("l", F.explode(F.sequence(F.greatest(short, F.lit(1)), F.greatest(long, F.lit(1))))).withColumn("tau", F.floor((1 - c) * (F.col("l") + F.col("n")) + 1e-9).cast("int")).where("tau < l")
    parts = sized.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tau"))))
    at, end = _cut("l", "(tau + 1)", "i"), _cut("l", "(tau + 1)", "(i + 1)")
    placed = parts.withColumn("at", F.expr(at)).withColumn("size", F.expr(f"{end} - {at}"))
    first, last = F.greatest(F.col("at") - F.col("tau"), F.lit(0)), F.least(F.col("at") + F.col("tau"), F.col("n") - F.col("size"))
    subs = placed.where(first <= last).withColumn("s", F.explode(F.sequence(first, last))).withColumn("part", F.expr("substring(low, s + 1, size)"))
    keys = ["l", "tau", "i", "part"]
    met = subs.select("q", "low", *keys).distinct().join(index, keys).select("q", "low", "name").distinct()
    ratio = F.pandas_udf(_ratios, "double")
    scored = met.withColumn("ratio", ratio("low", "name")).where(F.col("ratio") >= cutoff)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("ratio"), F.desc("name")))
    exact = F.bool_or(F.col("low") == F.col("name")).over(Window.partitionBy("q"))
    ranked = scored.withColumn("place", place).withColumn("exact", exact).where((F.col("place") <= most) & (~F.col("exact") | (F.col("place") == 1)))
    return ranked.select("q", "name", "ratio", F.col("place").cast("long").alias("place"))
