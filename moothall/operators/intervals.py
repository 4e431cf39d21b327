"""Which spans hold a point: an interval join by equality, so that no key's rows are paired with one another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enclosing(points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, start: str, end: str, size: str) -> DataFrame:
    """Rows of points with the columns of each span of the same key that holds them: start < at <= end, all from 1 on.

    A span is filed once, under the number between start + 1 and end that the
    highest power of two divides; a point looks under the one number of each
    power that a span around it can be filed under, log2(size) of them. size
    is a column of points, no less than any end of its key.
    """
    filed = spans.where(f"{start} < {end}").withColumn("__k", F.expr(f"length(bin({start} ^ {end})) - 1")).withColumn("__node", F.expr(f"shiftleft(shiftright(cast({end} as bigint), __k), __k)")).drop("__k")
    powers = F.sequence(F.lit(0), F.expr(f"length(bin({size})) - 1"))
    looked = points.withColumn("__k", F.explode(powers)).withColumn("__node", F.expr(f"shiftleft(shiftright(cast({at} as bigint), __k + 1), __k + 1) + shiftleft(cast(1 as bigint), __k)")).drop("__k")
    return looked.join(filed, [*by, "__node"]).where(f"{start} < {at} and {at} <= {end}").drop("__node")


def nearest(points: DataFrame, spans: DataFrame, by: Sequence[str], at: str, start: str, end: str, size: str) -> DataFrame:
    """(by, at, start) of the innermost span that holds each point; points that none holds have no row."""
    return enclosing(points.select(*by, at, size), spans.select(*by, start, end), by, at, start, end, size).groupBy(*by, at).agg(F.max(start).alias(start))
