"""Every query with SQL against DuckDB on the smallest tables; the iterative ones by what they must keep."""

import duckdb
import pandas as pd
import pytest

from stratoplane.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (f[columns].sort_values(columns, ignore_index=True) for f in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=2e-6)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(catalog.ORACLES[name]).df())


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
