"""Every table query against its SQL, and the entry points."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

import __spark_entry__
from boxwise.plans import all_queries
from tests.comparing import rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(all_queries.ORACLE_SQL))
def test_query_equals_sql(spark: SparkSession, sf_dir: str, name: str) -> None:
    df = __spark_entry__.queries()[name](spark, sf_dir)
    names, expected = sql_rows(sf_dir, all_queries.ORACLE_SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(set(all_queries.QUERIES) - set(all_queries.ORACLE_SQL)))
def test_query_without_sql_runs(spark: SparkSession, sf_dir: str, name: str) -> None:
    """Results are compared in test_matching, test_clusters and test_sources_and_streams; here, that pruning columns changes nothing."""
    df = __spark_entry__.queries()[name](spark, sf_dir)
    assert df.count() == len(df.collect()) == len(df.select(df.columns[0]).collect()) > 0


def test_entry(spark: SparkSession) -> None:
    assert __spark_entry__.entry(spark).columns


def test_every_sql_has_its_query() -> None:
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
