"""Registered queries by name, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir) under a name."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def civic(name: str, oracle_text: str | None = None):
    """Register a function of a Catalog; entities that the oracle names are put before it."""
    from moothall.catalog import Catalog, oracle

    def add(fn):
        QUERIES_BY[name] = fn
        query(name, oracle(oracle_text) if oracle_text else None)(lambda spark, sf_dir: fn(Catalog(spark, sf_dir)))
        return fn

    return add


QUERIES_BY: dict[str, Callable] = {}


def load() -> None:
    """Import the modules that register queries."""
    import importlib

    for m in ("reads", "joins", "aggregates", "ranking", "scalars", "agendas", "search", "merges", "streams", "services", "layouts", "indexed", "kept"):
        importlib.import_module(f"moothall.plans.{m}")


load()
