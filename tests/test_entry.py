from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, canonical

CHECKED = (
    "stg_products", "mart_order_fulfillment", "mart_category_order_fulfillment", "mart_payment_analysis_base",
    "geography_performance", "payment_analysis", "payment_analysis_summary", "seller_diagnostic_all", "dq_report",
    "chunk_documents", "tokenize", "hash_embedding", "hybrid_search", "retrieval_eval", "parse_requests",
    "run_plan_delivery_seller", "critic_checks", "assemble_answer", "stream_events_after",
)


def test_every_oracle_has_a_query_and_nearly_every_query_an_oracle():
    names, oracle = set(entry.queries()), set(entry.oracle_sql())
    assert oracle <= names
    from parcelmart.registry import all_jobs

    assert set(all_jobs()) - oracle == set()


def test_flagship(spark):
    assert entry.entry(spark).columns[0] == "seller_id"


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_against_the_oracle(spark, folder, duck, name):
    df = entry.queries()[name](spark, folder)
    relation = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(relation.columns)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert got == canonical(relation.columns, relation.fetchall())
