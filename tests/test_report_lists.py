"""Industry lists and values out of literal sentences; nothing here comes from the library's own word lists."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cleaning as X
from tidemark.operators import report_text as T

SENTENCES = [
    ("Inventories", "The industries reporting growth in inventories in May are: Wood Products; Paper Products.", "Higher", ["Wood Products", "Paper Products"]),
    ("Inventories", "The two industries reporting lower or decreased inventories are: Machinery; and Textile Mills.", "Lower", ["Machinery", "Textile Mills"]),
    ("New Orders", "The three industries that reported growth in new orders in May are: Wood Products; Machinery; and Paper Products.", "Growing", ["Wood Products", "Machinery", "Paper Products"]),
    ("New Orders", "The industries reporting a decline in new orders, in order, are: Textile Mills; Machinery.", "Declining", ["Textile Mills", "Machinery"]),
    ("Supplier Deliveries", "The four industries reporting slower deliveries in March are Wood Products; Machinery.", "Slower", ["Wood Products", "Machinery"]),
    ("Supplier Deliveries", "The industries reporting faster supplier deliveries are: Mining.", "Faster", ["Mining"]),
    ("Prices", "The only industry that reported paying decreased prices in May is Wood Products.", "Decreasing", ["Wood Products"]),
    ("Prices", "In May, six industries reported paying increased prices, in the following order: Mining; Utilities.", "Increasing", ["Mining", "Utilities"]),
    ("Employment", "Two industries reported employment growth in May: Mining; Utilities.", "Growing", ["Mining", "Utilities"]),
    ("Backlog of Orders", "The industries reporting lower order backlogs in May are: Mining; Utilities.", "Declining", ["Mining", "Utilities"]),
    ("Imports", "The two industries that reported lower volumes of imports in May are: Mining; Utilities.", "Declining", ["Mining", "Utilities"]),
    ("Customers' Inventories", "The industries reporting customers' inventories as too high are: Mining; Utilities.", "Too High", ["Mining", "Utilities"]),
]


@pytest.mark.parametrize("index,sentence,category,names", SENTENCES)
def test_list_of_a_sentence(spark, index, sentence, category, names):
    rows = spark.createDataFrame([(1, index, "The Index registered 51.2 percent. " + sentence)], "doc_id long, index_name string, summary string")
    got = [(r["category"], r["industry_name"]) for r in T.industry_mentions(T.industry_lists(rows)).orderBy("rank").collect()]
    assert got == [(category, n) for n in names]


LISTS = [
    ("the manufacturing industries are: Machinery, Mining", ["Machinery", "Mining"]),
    ("Mining; Utilities andPrimary Metals", ["Mining", "Utilities", "Primary Metals"]),
    ("Food andprimary metals; Mining", ["Food and primary metals", "Mining"]),
    ("the Mining; those Utilities; that Paper; are Wood", ["Mining", "Utilities", "Paper", "Wood"]),
    ("007Mining; 0Paper Products (2); Wood Products**", ["7Mining", "Paper Products", "Wood Products"]),
    ("reported growth in the following order: Mining", ["Mining"]),
    ("Mining; Mining; X", ["Mining"]),
]


@pytest.mark.parametrize("text,names", LISTS)
def test_split_of_a_list(spark, text, names):
    row = spark.createDataFrame([(text,)], "t string").select(T.split_industries(F.col("t")).alias("n")).first()
    assert row["n"] == names


def test_conflicts_are_settled_for_the_primary_category(spark):
    rows = spark.createDataFrame([(1, "New Orders", "The industries reporting growth are: Mining; Paper. The industries reporting a decline are: Wood; Mining."),
                                  (2, "Prices", "The industries reporting lower prices are: Mining.")], "doc_id long, index_name string, summary string")
    got = sorted((r["doc_id"], r["category"], r["industry_name"], r["rank"]) for r in T.resolved_mentions(rows).collect())
    assert got == [(1, "Declining", "Wood", 0), (1, "Growing", "Mining", 0), (1, "Growing", "Paper", 1), (2, "Decreasing", "Mining", 0)]


def test_values_and_changes(spark):
    texts = [(1, "PMI", "The PMI registered 49.3 percent in May"), (2, "Prices", "The index increased 3.1 percent, a reading of 61.0 percent"),
             (3, "Imports", "The index is up by two percentage points, a percent point increase"), (4, "Exports", "Reading steady near 50.5 percent and growing")]
    rows = spark.createDataFrame(texts, "doc_id long, index_name string, summary string")
    assert {r["doc_id"]: (r["value"], r["direction"]) for r in T.summary_values(rows).collect()} == {
        1: (49.3, "Contracting"), 2: (3.1, "Contracting"), 4: (50.5, "Growing")}
    assert {r["doc_id"]: r["value"] for r in T.guarded_values(rows).collect()} == {1: 49.3}


def test_price_words_of_the_glance_table(spark):
    rows = spark.createDataFrame([(1, "MANUFACTURING AT A GLANCE\nPrices at 61.0 percent, Increasing\nNew Orders at 48.0 percent, Contracting\nOVERALL ECONOMY")], "doc_id long, text string")
    assert {r["index_name"]: r["direction"] for r in T.glance_table(rows).collect()} == {"Prices": "Increasing", "New Orders": "Contracting"}
    assert [r["index_name"] for r in T.glance_table(rows, price_words=False).collect()] == ["New Orders"]


@pytest.mark.parametrize("text,new,old", [
    ("In the  following order: x", None, None), ("industries reporting growth", None, None), ("May:", None, "May:"), ("3. Mining", None, "3. Mining"), ("(2)", None, "(2)"),
    ("- Mining", None, "Mining"), ("the Mining", "Mining", "Mining"), ("s Mining", "Mining", "Mining"), ("Paper Products", "Paper Products", "Paper"), ("None", None, "None"),
    ("andPrimary Metals", "Primary Metals", "andPrimary Metals"), ("ab", None, None), ("are :", None, "are :"), ("are:", None, None), ("of", None, None), (None, None, None)])
def test_cleaned_names(spark, text, new, old):
    row = spark.createDataFrame([(text,)], "t string").select(X.clean_industry(F.col("t")).alias("a"), X.clean_industry_old(F.col("t")).alias("b")).first()
    assert (row["a"], row["b"]) == (new, old)


def test_each_rule_is_searched_once(spark):
    """The rules of an index are looked up once and a list is taken from the search that found it."""
    rows = spark.createDataFrame([(1, "New Orders", "x")], "doc_id long, index_name string, summary string").repartition(2)
    plan = T.industry_lists(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == sum(len(r) for r in T.INDUSTRY_RULES.values())
    assert plan.count("Customers' Inventories") <= 2


@pytest.mark.parametrize("body,summary", [
    (" \t\x0b one  two\r\n \n", "one  two"), ("one \u2028", "one \u2028"), (" one \u0085 ", "one \u0085"), ("Prices rose\n  AT A GLANCE and more", "Prices rose"), ("AT A GLANCES", "AT A GLANCES"), ("", "")])
def test_ends_of_a_summary(spark, body, summary):
    rows = spark.createDataFrame([(1, f"New Orders\nnot this\nXSERVICES INDEX SUMMARIES\n new orders \t\n{body}\nImports\nlast\nNEW ORDERS\nagain")], "doc_id long, text string")
    got = {r["index_name"]: r["summary"] for r in T.index_summaries(rows).collect()}
    assert got == {"New Orders": summary, "Imports": "last"}
    assert spark.range(1).select(T._stripped(F.lit("\tone  \u2028"))).first()[0] == "one\u2028"


@pytest.mark.parametrize("summary,lists", [
    ("subindustries reporting growth are: Mining.", []), ("Industries preporting growth are: Mining.", []), ("industries that report growth fare: Mining.", ["Mining"]),
    ("INDUSTRIES REPORTING\n GROWTH share is Mining.", ["Mining"]), ("Industry reported growth: . The industries reporting hiring gains are: Wood.", [" "])])
def test_words_of_a_rule_stand_alone(spark, summary, lists):
    rows = spark.createDataFrame([(1, "New Orders", summary)], "doc_id long, index_name string, summary string")
    assert [r["list_text"] for r in T.industry_lists(rows).collect()] == lists
