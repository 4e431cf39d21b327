"""Relational operators over DataFrames of any origin: filters, as-of lookups, best rows, tallies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def any_of(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose column is one of a short list of values."""
    return df.where(F.col(column).isin(list(values)))


def optional_filters(df: DataFrame, **equal) -> DataFrame:
    """Rows equal to every value given; None stands for no condition; strings compare without case."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.lower(name) == value.lower() if isinstance(value, str) else F.col(name) == value)
    return df


def without_status(df: DataFrame, excluded: Sequence[str], column: str = "status") -> DataFrame:
    """Rows whose status is null or none of those excluded."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(list(excluded)))


def valid_at(df: DataFrame, moment: Column, start: str = "joined_at", end: str = "left_at") -> DataFrame:
    """Rows whose half-open interval [start, end) holds the moment; a null end is open."""
    return df.where((F.col(start) <= moment) & (F.col(end).isNull() | (F.col(end) > moment)))


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order (DISTINCT ON when n is 1)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def children(df: DataFrame, parent: str, order: str, fields: Sequence[str], out: str) -> DataFrame:
    """One row for each parent with its children as an ordered array of structs."""
    return df.groupBy(parent).agg(F.sort_array(F.collect_list(F.struct(order, *(f for f in fields if f != order)))).alias(out))


#: Raw votes and the bucket each counts in; others count as present.
TALLY = {"yes": "yes", "aye": "yes", "yea": "yes", "no": "no", "nay": "no", "abstain": "abstain", "abstained": "abstain", "absent": "absent", "excused": "absent", "not present": "absent", "present": "present", "recused": "abstain", "not_voting": "present"}
BUCKETS = ("yes", "no", "abstain", "absent", "present")


def vote_bucket(vote: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in TALLY.items() for x in kv))
    return F.coalesce(F.element_at(known, F.trim(F.lower(F.coalesce(vote, F.lit(""))))), F.lit("present"))


def vote_tally(votes: DataFrame, keys: Sequence[str], vote: str = "vote") -> DataFrame:
    """Votes of each bucket for each key, zeros included."""
    bucket = vote_bucket(F.col(vote))
    return votes.groupBy(*keys).agg(*(F.count_if(bucket == b).alias(b) for b in BUCKETS))


def vote_outcome(yes: Column, no: Column) -> Column:
    return F.when((yes == 0) & (no == 0), "no_vote").when(yes > no, "passed").when(no > yes, "failed").otherwise("tabled")


def prior_row(df: DataFrame, key: str, order: str, value: str, tie: str) -> Column:
    """The newest earlier non-null value of the same key."""
    w = Window.partitionBy(key).orderBy(F.asc_nulls_first(order), tie).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(w)


def gap_clusters(df: DataFrame, group: Sequence[str], order: str, gap: float, out: str = "cluster") -> DataFrame:
    """Number the runs of each group in which consecutive positions differ by at most gap."""
    w = Window.partitionBy(*group).orderBy(order)
    jump = F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)
    return df.withColumn("__jump", jump).withColumn(out, F.sum("__jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__jump")


def histogram(df: DataFrame, keys: Sequence[str], column: str, values: Sequence) -> DataFrame:
    """Rows of each key by value, zeros included."""
    return df.groupBy(*keys).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values), F.count("*").alias("total"))
