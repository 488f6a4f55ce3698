"""Queries of the subpackage that have SQL, side by side with DuckDB."""

import duckdb
import pytest

from foldlake.llm import queries

SF = "/root/testdata/sf0.001"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert _rows(got.columns, got.collect()) == _rows([d[0] for d in want.description], want.fetchall())
