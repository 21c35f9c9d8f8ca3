"""The training-data queries that SQL can express give the same rows as DuckDB."""

import os

import duckdb
import pytest

from casebook.llm.oracle import ORACLE_SQL
from casebook.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(rows: list[tuple]) -> list[tuple]:
    return sorted(tuple(f"{v:.12g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, expected = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert plain(got.select(*columns).collect()) == plain(expected.select(*columns).fetchall())
