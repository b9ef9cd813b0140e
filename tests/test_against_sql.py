"""Registered queries against their SQL on the smallest data.

By default one query per family runs; TIDEMARK_ALL=1 runs every one.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tests.conftest import DATA
from tidemark.plans.all_queries import ORACLES, QUERIES
from tools.check import TABLES, rows_of

SAMPLE = [
    "c03_macd", "c11_financial_ratios", "c19_concentration_alerts", "k03_pair_correlation", "k04_lag_profile",
    "l02_enhanced_selection", "n10_overall_relevance", "n13_deduplicated", "n15_final_selection", "n23_run_contexts",
    "n28_page_articles", "p08_daily_metrics", "p13_key_drivers", "p24_scenarios", "q04_anomalies", "s01_index_csv",
    "c18_sector_overlap", "k06_partners", "k10_ranked_matrix", "p28_missing_history", "s17_exported_report", "s19_cascaded_delete", "s20_evolved_reports",
    "s05_sentiment_feed", "s13_upserted_facts", "t06_glance_table", "t10_industry_lists", "t12_sentence_mentions", "t13_resolved_conflicts", "t14_merged_extractions", "v09_canonical_industries",
    "v20_merged_extractions", "x05_series_with_change", "x11_signed_ranks", "z01_daily_source_health", "z05_upserted_stream",
]
NAMES = sorted(QUERIES) if os.environ.get("TIDEMARK_ALL") else SAMPLE


@pytest.fixture(scope="module")
def sql_engine():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sql_engine, name):
    frame = QUERIES[name](spark, DATA)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = sql_engine.execute(ORACLES[name])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    assert sorted(frame.columns) == sorted(d[0] for d in result.description)
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


def test_entry_returns_rows(spark):
    assert entry_module.entry(spark).count() > 0
