"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from ledgerscope import catalog

def canonical(columns, rows):
    """Rows with sorted columns; whole numbers stay exact whatever their type."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 6) if isinstance(v, float | decimal.Decimal) else v
    return sorted(repr(tuple(plain(row[i]) for i in order)) for row in rows)


def both(spark, duck, sf_dir, name):
    got, expected = catalog.QUERIES[name](spark, sf_dir), duck.execute(catalog.SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(got.columns) == sorted(columns)
    return canonical(got.columns, got.collect()), canonical(columns, expected.fetchall())


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        connection.execute(f"create view {file.split('.')[0]} as select * from '{sf_dir}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    got, expected = both(spark, duck, sf_dir, name)
    assert got == expected


def test_every_query_has_a_name_of_its_own():
    assert len(catalog.QUERIES) > 100 and set(catalog.SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", ["g7_agent_knowledge", "g7_spread_knowledge", "g8_counterparty_tally"])
def test_knowledge_by_shuffles_alone(spark, duck, sf_dir, name):
    """As on large tables: no broadcasts, no partitions put together."""
    large = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in large}
    try:
        for k, v in large.items():
            spark.conf.set(k, v)
        got, expected = both(spark, duck, sf_dir, name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == expected
