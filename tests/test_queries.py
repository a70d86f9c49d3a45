"""Every registered extraction query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from cohortlake import queries
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    text = lambda x: "~" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    own = queries.QUERIES[name](spark, SMALL)
    own = own.select([own[c].cast("string") if k == "date" else own[c] for c, k in own.dtypes]).toPandas()
    sql = duck.sql(queries.ORACLE_SQL[name])
    sql = sql.project(", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' if str(k) == "DATE" else f'"{c}"' for c, k in zip(sql.columns, sql.types, strict=True))).df()
    assert rows(own) == rows(sql)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
