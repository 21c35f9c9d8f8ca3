"""Every registered query with SQL gives the same rows as DuckDB; the others run."""

import os

import duckdb
import pandas as pd
import pytest

from casebook.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        return "" if v is None or (not isinstance(v, list | str) and pd.isna(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in ORACLE_SQL:
        expected = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
    assert e.entry(spark).columns == ["pattern", "actor_id", "started_at", "ended_at", "event_ids"]


def test_the_entry_needs_no_session_to_import():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(), e.oracle_sql()"], check=True, timeout=120)
