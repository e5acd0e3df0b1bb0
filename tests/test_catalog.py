"""Every query with SQL gives DuckDB's rows on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from quillmill import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    number = lambda v: str(int(v)) if v.is_integer() else round(float(v), 6)  # noqa: E731  nulls make floats of whole numbers
    value = lambda v: None if pd.isna(v) else number(v) if isinstance(v, float) else str(v)
    return sorted((tuple(map(value, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, expected = catalog.QUERIES[name](spark, SF_DIR).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert len(expected)
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
