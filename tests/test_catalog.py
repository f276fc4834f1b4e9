"""Every catalog query against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest
from tidemark.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if hasattr(x, "isoformat"):
        return str(pd.Timestamp(x))
    return plain(x.item()) if hasattr(x, "item") else x


def rows(df, columns):
    return sorted(repr(tuple(map(plain, r))) for r in df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want, got = con.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, data).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert rows(want, columns) == rows(got, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 20
