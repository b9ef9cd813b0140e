"""Literal cases: cleaning, extraction, citations, correlation, sources."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.dates import parse_month
from tidemark.functions.numbers import clean_number, safe_double
from tidemark.functions.stats import correlation_p_value, cosine
from tidemark.functions.text import cited_numbers, domain_of, normalise_citations
from tidemark.operators import cleaning as C
from tidemark.operators import correlation as K
from tidemark.operators import index_series as X
from tidemark.operators import report_text as T
from tidemark.sources import feeds as S
from tidemark.sources import index_csv as I
from tidemark.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [
    ("January 2025", dt.date(2025, 1, 1)), ("Jan 2025", dt.date(2025, 1, 1)), ("Oct-13", dt.date(2013, 10, 1)),
    ("Oct-63", dt.date(1963, 10, 1)), ("02/2024", dt.date(2024, 2, 1)), ("13/2024", None), ("soon", None), (None, None)])
def test_months(spark, text, want):
    assert one(spark, parse_month(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text,want", [("52.8%", 52.8), ("54.2", 54.2), ("n/a", None), ("-3.1", -3.1), ("", None)])
def test_numbers(spark, text, want):
    assert one(spark, clean_number(F.lit(text))) == want


def test_safe_double(spark):
    assert one(spark, safe_double(F.lit("None"))) is None and one(spark, safe_double(F.lit("1.5"))) == 1.5


@pytest.mark.parametrize("word,want", [("growing", "Growing"), ("contracting", "Contracting"), ("slower", "Slowing"),
                                       ("too HIGH", "Too High"), ("steady", "Steady"), (None, "Unknown")])
def test_directions(spark, word, want):
    assert one(spark, C.standard_direction(F.lit(word).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [
    ("Chemical", "Chemical Products"), ("Textile", "Textile Mills"), ("Fabricated Metal", "Fabricated Metal Products"),
    ("petroleum and coal products", "Petroleum & Coal Products"), ("Machinery (2)", "Machinery"), ("Zeppelins", "Zeppelins")])
def test_canonical_industries(spark, raw, want):
    assert one(spark, C.canonical_industry(F.lit("Manufacturing"), F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("1. Machinery", None), ("the  Wood   Products", "Wood Products"), ("are:", None),
                                      ("none reported", None), ("s Textile Mills", "Textile Mills")])
def test_clean_industry(spark, raw, want):
    assert one(spark, C.clean_industry(F.lit(raw))) == want


def test_clean_lists_keep_first_spelling(spark):
    rows = [(1, i, n) for i, n in enumerate(["Chemical Products", "", "are:", "in order", "chemical products", "Fabricated Metal Products"])]
    out = C.clean_lists(spark.createDataFrame(rows, "g int, rank int, industry_name string"), ["g"]).orderBy("rank").collect()
    assert [r.industry_name for r in out] == ["Chemical Products", "Fabricated Metal Products"]


GLANCE = """
MANUFACTURING AT A GLANCE
JANUARY 2025

Manufacturing PMI® at 52.8 percent, Growing
New Orders at 55.4 percent, Growing
Production at 54.2 percent, Growing
"""
ORDERS = """NEW ORDERS
The New Orders Index registered 55.4 percent in January, expanding again.
The five manufacturing industries reporting growth in new orders in January are: Transportation Equipment;
Food, Beverage & Tobacco Products; Chemical Products; and Plastics & Rubber Products.
The industries reporting a decline in new orders in January — in order — are: Textile Mills; Machinery; and Primary Metals.
PRODUCTION
The Production Index registered 52.5 percent.
"""


def reports(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_glance_table_without_end_marker(spark):
    rows = {r.index_name: (r.value, r.direction) for r in T.glance_table(reports(spark, GLANCE)).collect()}
    assert rows["Manufacturing PMI"] == ("52.8", "Growing")
    assert rows["New Orders"][0] == "55.4" and rows["Production"][0] == "54.2"


def test_industry_lists_from_text(spark):
    summaries = T.index_summaries(reports(spark, ORDERS))
    found = T.industry_mentions(T.industry_lists(summaries)).where("index_name = 'New Orders'").orderBy("rank").collect()
    growing = [r.industry_name for r in found if r.category == "Growing"]
    declining = [r.industry_name for r in found if r.category == "Declining"]
    assert growing == ["Transportation Equipment", "Food, Beverage & Tobacco Products", "Chemical Products", "Plastics & Rubber Products"]
    assert declining == ["Textile Mills", "Machinery", "Primary Metals"]
    values = {r.index_name: r.value for r in T.summary_values(summaries).collect()}
    assert values == {"New Orders": 55.4, "Production": 52.5}


def test_report_type_and_month(spark):
    services = "SERVICES AT A GLANCE\nJANUARY 2025\nServices PMI® at 54.2%\nServices industries reporting growth: Finance & Insurance"
    kinds = {r.doc_id: r.report_type for r in T.type_scores(reports(spark, GLANCE, services, "")).collect()}
    assert kinds == {0: "Manufacturing", 1: "Services", 2: "Manufacturing"}
    assert one(spark, T.report_month(F.lit("January 2025 MANUFACTURING INDEX"))) == "January 2025"
    assert one(spark, T.report_month(F.lit("May 2020, June 2021 and june 2021"))) == "June 2021"
    assert one(spark, T.report_month(F.lit("nothing"))) == "Unknown"
    assert one(spark, T.month_fallback(F.lit("rep_Jan_25.pdf"), F.lit(dt.date(2020, 3, 1)))) == "January 2025"


def test_citations_and_domains(spark):
    text = F.lit("up 15% [^3] and (S7), {s3} [9]")
    assert one(spark, normalise_citations(text)) == "up 15% [S3] and [S7], [S3] [S9]"
    assert one(spark, cited_numbers(text, F.lit(8))) == [3, 7]
    assert one(spark, domain_of(F.lit("https://www.A.com:8080/x"))) == "a.com:8080"


@pytest.mark.parametrize("n,r,want", [(10, 0.6, 0.066688), (36, 0.3, 0.075457), (5, 0.9, 0.037386), (3, 0.5, 2 / 3), (9, 1.0, 0.0)])
def test_p_values(spark, n, r, want):
    assert math.isclose(one(spark, correlation_p_value(F.lit(r), F.lit(n))), want, abs_tol=1e-6)


def test_cosine_of_zero_vector(spark):
    assert one(spark, cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0


def test_lag_profile_is_antisymmetric(spark):
    rows = []
    for i in range(12):
        rows += [("p", "q", "r", "s", i + 1, float((i * 7) % 5), float((i * 3) % 4)),
                 ("r", "s", "p", "q", i + 1, float((i * 3) % 4), float((i * 7) % 5))]
    pairs = spark.createDataFrame(rows, "type_a string, index_a string, type_b string, index_b string, position int, value_a double, value_b double")
    out = {(r.type_a, r.lag): r.correlation for r in K.lag_profile(pairs).collect()}
    for lag in range(-3, 4):
        assert math.isclose(out[("p", lag)], out[("r", -lag)], abs_tol=1e-9)


def test_first_row_kept_has_no_change(spark):
    rows = [(dt.date(2024, m, 1), "Manufacturing", "Prices", 50.0 + m) for m in range(1, 7)]
    frame = spark.createDataFrame(rows, "report_date date, report_type string, index_name string, index_value double")
    out = X.series_with_change(frame, 3).orderBy("report_date").collect()
    assert [(r.report_date.month, r.change) for r in out] == [(4, None), (5, 1.0), (6, 1.0)]


def test_wide_csv_with_mark_numbers_and_blanks(spark, tmp_path):
    path = tmp_path / "wide.csv"
    lines = ["﻿No,Month,PMI,Exports,Other"] + [f"{i},{m},{50 + i},n/a,1" for i, m in enumerate(["Oct-13", "Nov-13", "Dec-13"], 1)]
    path.write_text("\n".join(lines + ["4,Bad-13,51,50,1"]), encoding="utf-8")
    rows = I.read_index_csv(spark, str(path)).orderBy("report_date").collect()
    assert [(r.report_date.isoformat(), r.index_name, r.index_value) for r in rows] == [
        ("2013-10-01", "Manufacturing PMI", 51.0), ("2013-11-01", "Manufacturing PMI", 52.0), ("2013-12-01", "Manufacturing PMI", 53.0)]


def test_configs_skip_broken_files(spark, tmp_path):
    good = {"indices": ["New Orders", "Prices"], "index_categories": {"Prices": ["Increasing", "Decreasing"]}, "canonical_industries": ["Machinery"]}
    (tmp_path / "manufacturing_config.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "services_config.json").write_text(json.dumps(good))
    (tmp_path / "odd_config.json").write_text("{invalid json")
    configs = I.read_report_configs(spark, str(tmp_path))
    assert sorted(r.report_type for r in configs.collect()) == ["Manufacturing", "Services"]
    asked = spark.createDataFrame([("Manufacturing", "Prices"), ("Manufacturing", "Else"), ("Manufacturing", "Supplier Deliveries")], "report_type string, index_name string")
    got = {r.index_name: r.categories for r in I.categories_of(configs, asked).collect()}
    assert got == {"Prices": ["Increasing", "Decreasing"], "Else": ["Growing", "Declining"], "Supplier Deliveries": ["Slower", "Faster"]}


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1, 10, 1), ("b", 2, 20, 1)], "p string, k int, v int, ver int")
    tables.upsert(first, path, ["p", "k"], "ver", "p")
    tables.upsert(spark.createDataFrame([("a", 1, 11, 2), ("a", 3, 30, 1)], first.schema), path, ["p", "k"], "ver", "p")
    rows = sorted((r.p, r.k, r.v) for r in spark.read.parquet(path).collect())
    assert rows == [("a", 1, 11), ("a", 3, 30), ("b", 2, 20)]


def test_a_replayed_batch_is_skipped(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "p string, k int, v int, ver int"
    tables.upsert(spark.createDataFrame([("a", 1, 10, 1), ("b", 2, 20, 1)], schema), path, ["p", "k"], "ver", "p", batch="q-0")
    tables.upsert(spark.createDataFrame([("a", 1, 99, 9), ("c", 3, 30, 1)], schema), path, ["p", "k"], "ver", "p", batch="q-0")
    assert sorted((r.p, r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1, 10), ("b", 2, 20)]
    tables.upsert(spark.createDataFrame([("a", 1, 99, 9), ("c", 3, 30, 1)], schema), path, ["p", "k"], "ver", "p", batch="q-1")
    tables.upsert(spark.createDataFrame([("b", 2, 5, 0)], schema), path, ["p", "k"], "ver", "p")
    assert sorted((r.p, r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1, 99), ("b", 2, 20), ("c", 3, 30)]


def test_bars_fall_back_and_drop_malformed(spark):
    payload = json.dumps({"2024-01-02": {"open": "1", "high": "2", "low": "1", "close": "1.5", "volume": "10"},
                          "2024-01-03": {"open": "x", "high": "2", "low": "1", "close": "1.5", "volume": "10"}})
    rows = S.normal_bars(S.bar_rows(spark.createDataFrame([("A", payload)], "symbol string, payload string"))).collect()
    assert len(rows) == 1 and float(rows[0].adj_close) == 1.5
