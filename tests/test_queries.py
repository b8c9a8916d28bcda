"""Every registered query against its SQL in DuckDB, over whole tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from orgcard.plans.oracle import oracle
from orgcard.plans.queries import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def norm(value):
    if value is None or isinstance(value, (bool, str)):
        return repr(value)
    return f"{float(value):.6f}" if isinstance(value, float) or hasattr(value, "as_tuple") else str(value)


def test_every_query_has_sql():
    assert set(registry()) == set(oracle())
    assert set(registry()) <= set(entry_module.queries()) and set(oracle()) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry()))
def test_query(spark, duck, name):
    df = registry()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*columns).collect())
    result = duck.execute(oracle()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(norm(r[i]) for i in order) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["page_id", "url", "email", "phone"]


# Streams and whole-site jobs run stage by stage; what they return is a read of written tables.
STAGED = {"stream_results", "stream_first_seen", "stream_site_contacts", "ordered_results", "site_company_contacts", "frame_contacts", "upsert_results"}


@pytest.mark.parametrize("name", sorted(set(registry()) - STAGED))
def test_plans_hold_no_cross_joins(spark, plan, name):
    df = registry()[name](spark, SF_DIR)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["page_url_parts", "page_url_valid", "url_score_top3", "serp_first_hit"])
def test_url_queries_do_not_read_markup(spark, plan, name):
    text = plan(registry()[name](spark, SF_DIR))
    assert "html" not in text
