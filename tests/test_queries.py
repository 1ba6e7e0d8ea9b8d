"""Every core query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from stripweave.jobs import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value + 0.0 if isinstance(value, float) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    expected = con.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(expected.columns, expected.fetchall())


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
