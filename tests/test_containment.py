"""Containment by postings, and canonical names from tables, against plain scans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cleaning as C
from tidemark.operators.containment import aliases_of, canonical_names, containing, names_by_overlap
from tidemark.operators.holdings import search_instruments, search_many

ODD = ["", "a", "ab", "abc", "%", "_", "a%b", "日本語テキスト", "本語", "aa", "aaa", "aaaa", " a ", "A", "ä", "x\\y", None]


@pytest.mark.parametrize("seed", [1, 2])
def test_containing_equals_a_scan(spark, seed):
    rng = random.Random(seed)
    texts = [(g, "".join(rng.choice("abc %本") for _ in range(rng.randint(0, 12)))) for g in "pq" for _ in range(150)] + [(g, t) for g in "pq" for t in ODD] * 2
    asked = [(g, "".join(rng.choice("abc %本") for _ in range(rng.randint(1, 5)))) for g in "pqr" for _ in range(60)] + [(g, t) for g in "pr" for t in ODD] * 2
    got = containing(spark.createDataFrame(texts, "g string, text string"), spark.createDataFrame(asked, "g string, asked string"), ["g"]).collect()
    want = {(g, a, t) for g, a in asked if a for h, t in texts if t and g == h and a in t}
    assert len(got) == len(want) and {(r.g, r.asked, r.text) for r in got} == want


def test_many_searches_equal_single_ones(spark):
    rows = [(f"S{i:03d}", f"Company {i} of {w}") for i, w in enumerate(["Steel", "steel", "Paper", "Pa", "Ölmühle"] * 30)]
    instruments = spark.createDataFrame(rows, "symbol string, name string")
    searches = ["steel", "PAP", "s00", "7", "of p", "ölm", "none", "s", "STEEL"]
    got = search_many(instruments, spark.createDataFrame([(s,) for s in [*searches, *searches, "", None]], "search string"), 8).collect()
    for s in searches:
        want = [r.symbol for r in search_instruments(instruments, s, 8).collect()]
        assert [r.symbol for r in sorted((x for x in got if x.search == s), key=lambda x: x.place)] == want
    assert {r.search for r in got} == set(searches) - {"none"}


def lists(spark):
    return spark.createDataFrame([(k, i, n) for k, names in C.LISTS.items() for i, n in enumerate(names)], "report_type string, position int, name string")


SPELLINGS = ["chemical", "Chemical Products", "textile", "Machinery (2)", "petroleum and coal products", "Zeppelins", "ab", "products", "Metal Fabricated Goods", "Related Support of Printing", "  Wood ", "", None,
             "mining of paper products", "Food", "real estate", "& and", "Apparel, Leather & Allied Products (12)", "Public Goods", "Support Services for Health"]


def test_tables_give_what_the_literal_lists_give(spark):
    raw = spark.createDataFrame([(k, s) for k in C.LISTS for s in SPELLINGS] * 2, "report_type string, raw string")
    k, r = F.col("report_type"), F.col("raw")
    literal = {(x.report_type, x.raw): (x.a, x.b) for x in raw.select(k, r, C.canonical_industry(k, r).alias("a"), C.canonical_by_overlap(k, r).alias("b")).collect()}
    for column, mapping in enumerate((canonical_names, names_by_overlap)):
        got = mapping(raw, lists(spark), ["report_type"]).collect()
        assert len(got) == len(literal)
        for x in got:
            if x.raw is not None and (x.raw.strip() or column == 0):
                assert x.name == literal[(x.report_type, x.raw)][column], x


def test_aliases_equal_the_literal_ones(spark):
    got = {(r.report_type, r.alias): r.name for r in aliases_of(lists(spark), ["report_type"]).collect()}
    assert got == {(kind, a): n for kind, known in C.ALIASES.items() for a, n in known.items()}


def best_overlap(spelling, names):
    words = set(spelling.lower().split())
    scored = [(len(words & set(n.lower().split())), -i, n) for i, n in enumerate(names)]
    return max(scored)[2] if max(scored)[0] else spelling.strip()


@pytest.mark.parametrize("seed", [5, 6])
def test_overlap_equals_a_count_for_every_name(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}x" for i in range(25)]
    names = ["common " + " ".join(rng.sample(words, rng.randint(1, 6))) for _ in range(300)]
    asked = [" ".join(rng.sample(words + ["Common", "zz", "yy"], rng.randint(1, 9))) for _ in range(150)]
    raw = spark.createDataFrame([("k", a) for a in asked], "g string, raw string")
    table = spark.createDataFrame([("k", i, n) for i, n in enumerate(names)], "g string, position int, name string")
    no_aliases = spark.createDataFrame([], "g string, alias string, name string")
    for r in names_by_overlap(raw, table, ["g"], no_aliases).collect():
        low = r.raw.lower()
        inside = [n for n in names if low in n or n in low]
        assert r.name == (inside[0] if inside else best_overlap(r.raw, names))


def test_a_list_of_100000_names(spark):
    """Names that share words with a third of all others; the spellings are few, the list is long."""
    names = spark.range(100_000).selectExpr("'k' AS g", "CAST(id AS int) AS position", "concat(if(id % 3 = 0, 'Common ', 'Other '), 'p', id % 317, ' q', id, ' & Products') AS name")
    raw = spark.createDataFrame([("k", "q4242"), ("k", "common p5"), ("k", "x p5 common"), ("k", "Q77 of things"), ("k", "products things")], "g string, raw string")
    exact = {r.raw: r.name for r in canonical_names(raw, names, ["g"]).collect()}
    assert re.search(r"q4242\b", exact["q4242"]) and exact["common p5"].startswith("Common p5") and exact["products things"] == "products things"
    shared = {r.raw: r.name for r in names_by_overlap(raw, names, ["g"]).collect()}
    assert shared["x p5 common"].startswith("Common p5 ") and shared["Q77 of things"].split()[2] == "q77" and shared["products things"] == "Common p0 q0 & Products"
