"""Queries that have SQL against it, in DuckDB, on the smallest tables."""

import duckdb
import pytest

from cohortlake.llm import queries
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    own, sql = queries.QUERIES[name](spark, SMALL), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(own.columns) == sorted(sql.columns)
    assert sorted(map(tuple, own.collect()), key=str) == sorted(sql.project(", ".join(own.columns)).fetchall(), key=str)
