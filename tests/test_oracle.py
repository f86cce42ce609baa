from __future__ import annotations

import pytest
from oracle import connect, same
from pyspark.sql import SparkSession

from korvane.plans import core_queries, core_sql


@pytest.mark.parametrize("name", sorted(core_sql.SQL))
def test_core_query_equals_sql(spark: SparkSession, data: str, name: str) -> None:
    same(core_queries.queries()[name](spark, data), connect(data), core_sql.SQL[name])


@pytest.mark.parametrize("name", sorted(set(core_queries.queries()) - set(core_sql.SQL)))
def test_core_query_without_sql_runs(spark: SparkSession, data: str, name: str) -> None:
    assert core_queries.queries()[name](spark, data).count() > 0


def test_entry(spark: SparkSession) -> None:
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
