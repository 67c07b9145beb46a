"""Every registered query against its SQL over DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from slackframe import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b)
    norm = lambda d: d[columns].map(lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v).sort_values(columns).reset_index(drop=True)
    a, b = norm(a), norm(b)
    for c in columns:
        if a[c].dtype == float:
            assert ((a[c] - b[c]).abs() <= 1e-5 * (1 + b[c].abs())).all(), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE:
        same(got, duck.sql(registry.ORACLE[name]).df())
    else:
        assert len(got) > 0
