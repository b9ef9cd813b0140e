"""Levels, changes, directions and lists told in sentences."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.operators import report_text as T
from tidemark.operators import report_values as R


def read(spark, text):
    t = F.col("x")
    of = R.mentions(t)
    return spark.createDataFrame([(text,)], "x string").select(
        R.level(of).alias("level"), R.sure_level(of).alias("sure"), R.tells_change(t, of).alias("change"), R.told_direction(t).alias("direction")).first()


@pytest.mark.parametrize("text,level,sure", [
    ("The Manufacturing PMI® registered 52.8 percent in January.", 52.8, 52.8),
    ("The New Orders Index registered 9.4 percent.", 9.4, None),
    ("Orders were strong; a reading of 54.2 percent", 54.2, 54.2),
    ("an index of 54.2 percent in March", 54.2, 54.2),
    ("an index of 54.2 percent in early March", 54.2, None),
    ("Growth of 3.1 percent, then it was 51.0 percent", 51.0, None),
    ("It was 51.0 percent, a reading above 50", 51.0, 51.0),
    ("First line\nIt was 51.0 percent, a reading above 50", 51.0, None),
    ("The reading moved up from 48.1 percent to 49.9 percent", 48.1, None),
    ("Nothing but 12.5percent here", 12.5, None),
    ("The index, after all, was 55.5 percent", 55.5, None),
    ("No number at all, or 50 percent", None, None), ("", None, None), (None, None, None)])
def test_levels(spark, text, level, sure):
    found = read(spark, text)
    assert (found.level, found.sure) == (level, sure)


@pytest.mark.parametrize("text,change", [
    ("rose 3.1 percent", True), ("is up 3.1 percent", True), ("a 1.5 percent point increase", True), ("changed by +0.4 percent", True), ("-0.4 percent", True),
    ("registered 51.2 percent", False), ("the increase is 3 points", False), ("", False)])
def test_changes(spark, text, change):
    assert read(spark, text).change is change


@pytest.mark.parametrize("text,direction", [("It is Growing, then contracting", "Growing"), ("outgrowing", None), ("slower deliveries", "Slowing"), ("declining", "Contracting")])
def test_directions(spark, text, direction):
    assert read(spark, text).direction == direction


def glance(spark, section, names=V.MANUFACTURING_INDICES):
    row = spark.createDataFrame([(section,)], "x string").select(R.glance_rows(F.col("x"), names, V.GLANCE_DIRECTIONS + V.PRICE_DIRECTIONS).alias("r")).first()
    return None if row.r is None else [(r.index_name, r.value, r.direction) for r in row.r]


def test_glance_rows(spark):
    section = ("AT A GLANCE\nManufacturing PMI® at 52.8%, up 1.5 points, Growing\nCustomers' Inventories at 45.0 percent, Too Low\nInventories is 46.1 percent, contracting\n"
               "Prices registered 60.1 percent, Increasing; Imports was 48.0 percent, Contracting\nProduction 50.0 Growing\nEmployment at 47.3 percent, unknown\nPrices at 1.0 percent, Growing\n")
    assert glance(spark, section) == [
        ("Manufacturing PMI", "52.8", "Growing"), ("Customers' Inventories", "45.0", "Too Low"), ("Inventories", "46.1", "Contracting"),
        ("Prices", "60.1", "Increasing"), ("Imports", "48.0", "Contracting")]
    assert glance(spark, "") == [] and glance(spark, "12.5") == [] and glance(spark, None) is None


@pytest.mark.parametrize("sentence,names", [
    ("The industries that grew: Machinery, Wood Products; others", " Machinery, Wood Products"), ("Sectors including Machinery, Primary Metals.", "Machinery, Primary Metals"),
    ("As listed: Mining", "Mining"), ("industries grew, including Mining", "Mining"), ("none", None)])
def test_listed_names(spark, sentence, names):
    assert spark.createDataFrame([(sentence,)], "x string").select(R.listed_names(F.col("x")).alias("r")).first().r == names


def test_summaries_of_a_report(spark):
    rows = [(1, "New Orders", "The New Orders Index registered 55.4 percent, growing again."), (1, "Prices", "The index increased 3.1 percent. It was 60.2 percent."), (2, "Manufacturing PMI", "The PMI® at 48.0 percent shows growth.")]
    summaries = spark.createDataFrame(rows, "doc_id int, index_name string, summary string")
    assert sorted(map(tuple, T.summary_values(summaries).collect())) == [(1, "New Orders", 55.4, "Growing"), (1, "Prices", 60.2, "Growing"), (2, "Manufacturing PMI", 48.0, "Contracting")]
    assert sorted(map(tuple, T.guarded_values(summaries).collect())) == [(1, "New Orders", 55.4, "Growing"), (2, "Manufacturing PMI", 48.0, "Growing")]


def test_long_lines_take_time_in_proportion(spark):
    """A section without an end marker may be a whole document on one line."""
    line = "nothing of note is said here at all was it " * 40_000
    assert glance(spark, "AT A GLANCE\nPrices at 60.1 percent, Increasing\n" + line + "\nProduction at 50.0 percent, Growing") == [("Prices", "60.1", "Increasing"), ("Production", "50.0", "Growing")]
    assert read(spark, line + "it was 51.0 percent").level == 51.0
