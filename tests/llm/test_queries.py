"""Queries of the training-data operators that have SQL, against it."""

from __future__ import annotations

import duckdb
import pytest

from slackframe.llm import queries
from tests.test_queries import SF, TABLES, same


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    same(queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLE[name]).df())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
