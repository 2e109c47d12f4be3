"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from segmill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return connection


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 200


def test_one_shuffle_for_expansion_and_blocks(spark):
    """All windows are per transcript, so they share the exchange of the segments."""
    from segmill.operators import ads
    from segmill.plans.fixtures import event_segments

    plan = ads.with_blocks(ads.expand_ads(event_segments(spark, SF)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
