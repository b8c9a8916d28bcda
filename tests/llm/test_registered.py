"""Registered corpus queries against their SQL in DuckDB, over whole tables."""

import os

import duckdb
import pytest

from orgcard.llm.registry import oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF_DIR}/{file}'")
    result = con.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    df = queries()[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.select(*columns).collect()) == plain(result.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries()) == list(range(1, 14))
