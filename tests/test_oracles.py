"""Every registered civic query against its DuckDB text on the smallest tables."""

import math
import os

import duckdb
import pytest

from moothall.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is getattr(__import__("pandas"), "NA", None) or v is getattr(__import__("pandas"), "NaT", None) or isinstance(v, float) and math.isnan(v):
        return "null"
    return str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) or getattr(getattr(v, "dtype", None), "kind", "") in "if" and hasattr(v, "dtype") else str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(str([plain(v) for v in r]) for r in pdf[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        assert rows(got) == rows(duck.execute(registry.ORACLES[name]).df())
    else:
        assert len(got.columns) > 0
