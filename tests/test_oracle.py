"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from foldlake.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "customer documents embeddings events labels benchmark lineitem nation orders pages part region supplier conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float):
            return None if v != v else round(v, 6) + 0.0
        return None if v is pd.NaT or v is pd.NA else v

    return sorted(tuple(str(plain(v)) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
