"""Merges of a batch of rows into a snapshot, as joins and grouped folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), frozen: Sequence[str] = (), frozen_when: str | None = None, largest: Sequence[str] = ()) -> DataFrame:
    """The snapshot after the batch; columns of old.

    Fields of the batch win, except that those in `keep` stay where the batch
    has null, those in `frozen` stay where the old row has `frozen_when`, and
    those in `largest` keep the larger value. Both sides have one row a key.
    """
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    joined = o.join(n, on, "full_outer")
    there = F.col(f"n.{keys[0]}").isNotNull()

    def field(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys or c in keep:
            return F.coalesce(b, a)
        if c in largest:
            return F.greatest(a, b)
        if c in frozen and frozen_when:
            return F.when(~there | F.col(f"o.{frozen_when}").isNotNull(), a).otherwise(b)
        return F.when(there, b).otherwise(a)

    return joined.select(*(field(c).alias(c) for c in old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and those rows of new whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Every child of the parents in new gives way to new's distinct rows."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new.distinct().select(*old.columns))


def last_write(log: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The newest log row of each key."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("__v")).select(*keys, "__v.*")


def first_write(log: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The oldest log row of each key."""
    return log.groupBy(*keys).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("__v")).select(*keys, "__v.*")
