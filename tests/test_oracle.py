"""Every query with SQL gives the same rows as an independent engine on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from paperloom.plans import composite_queries, desk_queries, more_queries, registry, relational_queries, report_queries, scalar_queries, stream_queries  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


def plain(v):
    if v is None or pd.isna(v):
        return None
    if hasattr(v, "year"):
        return str(v)[:10]
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return round(float(v), 6)
    return v


def rows(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, db, name):
    got, want = registry.QUERIES[name](spark, FOLDER).toPandas(), db.sql(registry.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() >= 0
