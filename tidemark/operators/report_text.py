"""Facts from report texts: type, month, glance table, summaries, values, industry lists.

Role: reports(doc_id, file_name, modified, text). Every extraction is a row-wise expression with
literal patterns (compiled once per task), followed by a generator; no text is ever shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.text import any_present, count_of, let, lookup, matched, presence_count
from tidemark.operators.industry_ranks import negative_category, positive_category
from tidemark.operators.report_values import glance_rows, level, listed_names, mentions, sure_level, tells_change, told_direction

MONTH_PATTERN = "(" + "|".join(V.MONTHS) + ")"


# ---- report type --------------------------------------------------------------------------
def _once(value: Column, name: str) -> Column:
    """The value as a generated column: the optimizer can't copy it into later uses, nor into the filter it infers for a generator."""
    return F.inline(F.array(F.struct(value.alias(name))))


def _share(a: Column, b: Column) -> Column:
    """a as percent of a + b, 50 when there is nothing."""
    return F.coalesce(F.try_divide(a.cast("double"), a + b) * 100, F.lit(50.0))


def _weighted_count(text: Column, weights: dict[str, int]) -> Column:
    total: Column = F.lit(0)
    for word, weight in weights.items():
        total = total + count_of(text, word) * weight
    return total


def type_scores(reports: DataFrame) -> DataFrame:
    """Keyword, structure and industry scores of both report types, and the type they give."""
    rows = reports.select("doc_id", "text", F.upper("text").alias("upper_"))
    upper = F.col("upper_")
    kinds = ("Manufacturing", "Services")
    words = {k: _weighted_count(upper, V.TYPE_KEYWORDS[k]) for k in kinds}
    mentions = {k: _weighted_count(upper, dict.fromkeys(V.TYPE_INDUSTRIES[k], 1)) for k in kinds}
    shapes = {}
    for k in kinds:
        found: Column = F.lit(0)
        for pattern in V.TYPE_STRUCTURES[k]:
            begins = re.match(r"[A-Z /]+", pattern)[0]  # what a match begins with; most texts lack it and need no pattern
            found = found + (F.contains(upper, F.lit(begins)) & F.col("text").rlike("(?is)" + pattern)).cast("int")
        shapes[k] = found / len(V.TYPE_STRUCTURES[k]) * 100
    counted = rows.select("doc_id", "text", F.inline(F.array(F.struct(
        *[words[k].alias(f"words_{k}") for k in kinds], *[mentions[k].alias(f"mentions_{k}") for k in kinds],
        *[shapes[k].alias(f"shape_{k}") for k in kinds]))))
    by_word, by_shape, by_industry = V.TYPE_SCORE_WEIGHTS

    def total(k: str, other: str) -> Column:
        return (_share(F.col(f"words_{k}"), F.col(f"words_{other}")) * by_word + F.col(f"shape_{k}") * by_shape
                + _share(F.col(f"mentions_{k}"), F.col(f"mentions_{other}")) * by_industry)

    scored = counted.withColumn("manufacturing_score", total("Manufacturing", "Services")).withColumn(
        "services_score", total("Services", "Manufacturing"))
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    return scored.select(
        "doc_id", "manufacturing_score", "services_score",
        F.when(empty | (F.col("manufacturing_score") > F.col("services_score")), "Manufacturing").otherwise("Services")
        .alias("report_type"))


def type_by_vote(text: Column) -> Column:
    """Quick vote: more services phrases present than manufacturing ones."""
    upper = F.upper(text)
    services = presence_count(upper, V.TYPE_VOTE_WORDS["Services"])
    return F.when(services > presence_count(upper, V.TYPE_VOTE_WORDS["Manufacturing"]), "Services").otherwise("Manufacturing")


# ---- month --------------------------------------------------------------------------------
def report_month(text: Column) -> Column:
    """'Month YYYY' by patterns in priority order, else the most frequent date, else 'Unknown'."""
    def dated(pattern: str, month: int, year: int) -> Column:
        full = "(?i)" + pattern
        return F.when(text.rlike(full), F.concat(
            F.initcap(F.regexp_extract(text, full, month)), F.lit(" "), F.regexp_extract(text, full, year)))

    return F.coalesce(
        dated(MONTH_PATTERN + r"\s+(\d{4})\s+(MANUFACTURING|SERVICES)", 1, 2),
        dated(r"(MANUFACTURING|SERVICES) AT A GLANCE\s+" + MONTH_PATTERN + r"\s+(\d{4})", 2, 3),
        most_frequent_month(text), F.lit("Unknown"))


def most_frequent_month(text: Column) -> Column:
    """The month named most often; on a tie the one named first."""
    found = F.transform(F.regexp_extract_all(text, F.lit("(?i)(" + MONTH_PATTERN + r"\s+\d{4})"), F.lit(1)),
                        lambda m: F.initcap(F.regexp_replace(m, r"\s+", " ")))
    counted = F.transform(F.array_distinct(found), lambda m, i: F.struct(
        F.size(F.filter(found, lambda x: x == m)).alias("n"), (-i).alias("first"), m.alias("month")))
    return F.when(F.size(found) > 0, F.array_max(counted)["month"])


def month_fallback(file_name: Column, modified: Column) -> Column:
    """'Jan_25' in the file name, else the month the file was changed."""
    pattern = r"(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[_\- ](\d{2})(?!\d)"
    full = {m[:3].lower(): m for m in V.MONTHS}
    month = lookup(F.lower(matched(file_name, pattern, 1)), full)
    return F.coalesce(F.concat(month, F.lit(" 20"), matched(file_name, pattern, 2)), F.date_format(modified, "MMMM yyyy"))


# ---- glance table -------------------------------------------------------------------------
def glance_section(text: Column, kind: str) -> Column:
    """From the glance heading to the first end marker; without a marker to the end of the text."""
    head = f"{kind.upper()} AT A GLANCE"
    return F.coalesce(
        matched(text, rf"(?is)({head}.*?(?:Month|COMMODITIES REPORTED))", 1),
        matched(text, rf"(?is)({head}.*?OVERALL ECONOMY)", 1),
        matched(text, rf"(?is)({head}.*)", 1))


def glance_table(reports: DataFrame, price_words: bool = True) -> DataFrame:
    """One row per index of the glance table; unknown types try both lists, the longer one wins.

    Without `price_words`, rows that say Increasing or Decreasing (all Prices rows) are not found.
    """
    return _with_glance(reports, price_words).select("doc_id", F.inline("glance_"))


def _with_glance(reports: DataFrame, price_words: bool = True) -> DataFrame:
    """doc_id, text and the entries of the glance table."""
    directions = V.GLANCE_DIRECTIONS + (V.PRICE_DIRECTIONS if price_words else [])
    text = F.col("text")
    upper = F.upper(text)
    # generated rows keep each search from being copied into every later use of its result
    parts = F.struct(F.contains(upper, F.lit("MANUFACTURING AT A GLANCE")).alias("m_"), F.contains(upper, F.lit("SERVICES AT A GLANCE")).alias("s_"),
                     glance_section(text, "Manufacturing").alias("m_part"), glance_section(text, "Services").alias("s_part"))
    rows = reports.select("doc_id", "text", F.inline(F.array(parts)))
    both = rows.select("doc_id", "text", "m_", "s_", F.inline(F.array(F.struct(
        glance_rows(F.col("m_part"), V.MANUFACTURING_INDICES, directions).alias("m_rows"),
        glance_rows(F.col("s_part"), V.SERVICES_INDICES, directions).alias("s_rows")))))
    first = F.coalesce(F.size("m_rows") >= F.size("s_rows"), F.lit(True))
    chosen = F.when(F.col("m_"), F.col("m_rows")).when(F.col("s_"), F.col("s_rows")).when(
        first, F.col("m_rows")).otherwise(F.col("s_rows"))
    return both.select("doc_id", "text", _once(chosen, "glance_"))


# ---- summaries ----------------------------------------------------------------------------
HEADINGS = list(dict.fromkeys(V.MANUFACTURING_INDICES + V.SERVICES_INDICES))
END_MARKERS = ["AT A GLANCE", "WHAT RESPONDENTS ARE SAYING", "COMMODITIES REPORTED", "BUYING POLICY"]


def index_summaries(reports: DataFrame) -> DataFrame:
    """One row per index section: from its heading line to the next heading or end marker."""
    return _with_summaries(reports.select("doc_id", "text")).select("doc_id", F.inline("summaries_"))


def _stripped(x: Column) -> Column:
    """The text without white space at its ends, nor before a last line separator that isn't white space to a pattern."""
    separated = F.endswith(x, F.lit("\u0085")) | F.endswith(x, F.lit("\u2028")) | F.endswith(x, F.lit("\u2029"))
    return F.when(separated, F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))).otherwise(F.btrim(x, F.lit(" \t\n\u000b\f\r")))


def _with_summaries(rows: DataFrame) -> DataFrame:
    """The rows without their text, with the index sections in it."""
    text = F.col("text")
    # the rarest words of a pattern stand first and what must stand before them is looked back at: a search then passes over the text letter by letter
    section = F.coalesce(matched(text, r"(?is)INDEX SUMMARIES(?<=(?:MANUFACTURING|SERVICES) INDEX SUMMARIES)(.*)$", 1), text)
    heads = "|".join(h.replace("'", "['’]") for h in HEADINGS)
    cut = F.regexp_replace(section, rf"(?im)^[ \t]*(?:({heads})[ \t]*$|(?:{'|'.join(END_MARKERS)})\b)", "\u0001$1\u0002")
    parts = F.split(cut, "\u0001")
    known = {h.upper(): h for h in HEADINGS}
    items = F.transform(parts, lambda p: let(F.split(p, "\u0002"), lambda h: F.struct(
        lookup(F.replace(F.upper(F.get(h, F.lit(0))), F.lit("’"), F.lit("'")), known).alias("index_name"),
        let(F.element_at(h, -1), _stripped).alias("summary"))))
    kept = [c for c in rows.columns if c != "text"]
    split = rows.select(*kept, _once(items, "items_")).withColumn(
        "names_", F.transform("items_", lambda x: x["index_name"]))
    first = F.filter("items_", lambda x, i: x["index_name"].isNotNull() & (
        F.array_position(F.col("names_"), x["index_name"]) == i + 1))
    return split.select(*kept, _once(first, "summaries_"))


def summary_values(summaries: DataFrame) -> DataFrame:
    """Value and direction of each summary; the headline's direction is by the 50 threshold."""
    told = F.struct(level(mentions(F.col("summary"))).alias("value"), told_direction(F.col("summary")).alias("word"))
    rows = summaries.select("doc_id", "index_name", F.inline(F.array(told))).where(F.col("value").isNotNull())
    by_level = F.when(F.col("value") >= 50, "Growing").otherwise("Contracting")
    return rows.select("doc_id", "index_name", "value", F.when(
        F.col("index_name").isin(list(V.HEADLINE.values())), by_level).otherwise(F.coalesce("word", by_level)).alias("direction"))


def _guarded(summary: Column, low: float, high: float) -> Column:
    """(value, direction) of a summary that does not talk about a change, with two integer digits, in range; else NULL."""
    def read(of: Column) -> Column:
        def guarded(value: Column) -> Column:
            sure = value.between(low, high) & ~tells_change(summary, of)
            return F.when(sure, F.struct(value.alias("value"), F.coalesce(told_direction(summary), F.lit("Unknown")).alias("direction")))

        return let(sure_level(of), guarded)

    return let(mentions(summary), read)


def guarded_values(summaries: DataFrame, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Values of summaries that do not talk about a change, at least two integer digits, in range."""
    rows = summaries.select("doc_id", "index_name", F.inline(F.array(F.struct(_guarded(F.col("summary"), low, high).alias("g_")))))
    return rows.where(F.col("g_").isNotNull()).select("doc_id", "index_name", "g_.value", "g_.direction")


def _any(words: list[str] | tuple[str, ...]) -> str:
    """One of the words or phrases, with any white space inside."""
    return "(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"


# ---- industries ---------------------------------------------------------------------------
# Rule table: by category, what industries report. A list is "industry/industries … report(ed/ing) <this> … are/is/: list."
# An index has two categories (V.CATEGORIES), and only their rules apply to it; the first that matches supplies the list.
RISES = ["growth", "expansion", "increase", "increased", "growing", "higher", "an increase", "an expansion"]
FALLS = ["decline", "contraction", "decrease", "decreased", "declining", "lower", "reduced", "reduction", "decreases",
         "a decline", "a contraction", "a decrease", "a reduction"]
STAFF = ["employment", "hiring", "workforce"]
INDUSTRY_RULES = {
    "Growing": [_any(RISES), rf"{_any(STAFF)}\s+{_any(['growth', 'increase', 'increases', 'expansion', 'gains'])}"],
    "Declining": [_any(FALLS)],
    "Slower": [r"slower(?:\s+supplier)?\s+deliveries"],
    "Faster": [r"faster(?:\s+supplier)?\s+deliveries"],
    "Higher": [rf"{_any([*RISES, 'growth in', 'an increase in'])}\s+inventories"],
    "Lower": [rf"{_any([*FALLS, 'lower or decreased', 'a decrease in', 'a decline in'])}\s+inventories"],
    "Too High": [r"[^.:]*?\btoo\s+high"],
    "Too Low": [r"[^.:]*?\btoo\s+low"],
    "Increasing": [rf"(?:paying\s+)?{_any([*RISES, 'increasing'])}\s+prices?", _any(["price increases", "an increase in prices"])],
    "Decreasing": [rf"(?:paying\s+)?{_any([*FALLS, 'decreasing'])}\s+prices?", _any(["price decreases", "a decrease in prices"])],
}


def list_patterns(category: str) -> list[str]:
    """Patterns of a category's sentences; group 1 is the list, up to the full stop."""
    # letters first, then a look back at the word's begin: most places fail at their letter
    return [rf"(?is)industr(?<=\bindustr)(?:y|ies)\b[^.:]{{0,60}}?report(?<=\breport)(?:ing|ed)?\s+{what}\b"
            r"[^.:]*?(?:(?:are|is)(?<=\b(?:are|is))\b\s*:?|:)\s*([^.]+)" for what in INDUSTRY_RULES[category]]


# what may stand before the first name, and what may stand before any
LIST_LEADS = [
    r"the\s+(?:\w+\s+){0,4}industr(?:y|ies)\s+(?:are|is)\b\s*:?", r"industr(?:y|ies)\s+that\s+reported\b[^;,]*?\bare\b\s*:?",
    r"in\s+" + _any(V.MONTHS) + r"\b(?:\s+\d{4})?(?:\s*[-—])?", r"(?:listed\s+)?in\s+(?:the\s+)?(?:following\s+)?order\b(?:\s*[-—])?",
    r"are\b\s*:?", r"is\b\s*:?",
]
LIST_LEAD = r"(?i)(?=[:tila])(?:\b(?:" + "|".join(LIST_LEADS) + ")|:)"
ITEM_LEADS = ["and", "&", "the", "those", "that", "are"]


def split_industries(text: Column) -> Column:
    """Ordered distinct names of a list text: ';' splits if present, else ','.

    A text without either mark is first cut to what follows its last "are", ":" or "order". A glued "and" ("andPrimary
    Metals") begins a new name, except in "andprimary", which is a lost space. Leading zeros of words go.
    """
    def uncovered(x: Column) -> Column:
        return F.when(F.contains(x, F.lit(",")) | F.contains(x, F.lit(";")), x).otherwise(F.regexp_replace(x, r"(?i)^.*(?:\bare\b|:|\border\b)\s*", ""))

    def led(x: Column) -> Column:
        return let(F.regexp_replace(x, LIST_LEAD, ""), lambda y: F.when(
            F.contains(y, F.lit("andprimary")), F.regexp_replace(y, r"\bandprimary", "and primary")).otherwise(y))

    def unglued(x: Column) -> Column:
        mark = F.when(F.contains(x, F.lit(";")), "; ").otherwise(", ")
        return F.regexp_replace(F.regexp_replace(x, r"[,;]?\s+and(?=[A-Z])", mark), r"^[,;.\s—-]+", "")

    def unled(item: Column) -> Column:
        return F.trim(F.regexp_replace(item, rf"(?i)^(?:{_any(ITEM_LEADS)}\s+|-\s*)+", ""))

    def tidy(item: Column) -> Column:
        out = unled(F.regexp_replace(F.trim(item), r"\s*\(\d+\)\s*$|\s*\*+\s*$", ""))
        return F.trim(F.regexp_replace(out, r"(?<!\S)0+(?=\S)|(?<!\S)0+(?!\S)", ""))

    def names(x: Column) -> Column:
        parts = F.split(x, F.when(F.contains(x, F.lit(";")), ";").otherwise(","))
        # a list without brackets, stars and zeros, as most are, has only leads to lose
        return F.when(x.rlike("[(*0]"), F.transform(parts, tidy)).otherwise(F.transform(parts, lambda p: unled(F.trim(p))))

    whole = let(F.regexp_replace(text, r"\s{2,}|[\t\n\x0B\f\r]", " "), lambda a: let(uncovered(a), lambda b: let(led(b), unglued)))
    return F.array_distinct(F.filter(let(whole, names), lambda x: F.length(x) > 1))


def _lists() -> Column:
    """(category, list_text) of both categories of the row's index, where a rule matches."""
    def first(patterns: list[str]) -> Column:
        found = F.regexp_extract("summary", patterns[0], 1)
        return let(found, lambda x: F.when(x != "", x).otherwise(first(patterns[1:]))) if patterns[1:] else found

    def of(mine: Column) -> Column:
        return F.array(*[F.when(F.array_contains(mine, c), F.struct(F.lit(c).alias("category"), first(list_patterns(c)).alias("list_text"))) for c in INDUSTRY_RULES])

    mine = F.array(positive_category(F.col("index_name")), negative_category(F.col("index_name")))
    return F.filter(let(mine, of), lambda e: e["list_text"] != "")


def industry_lists(summaries: DataFrame) -> DataFrame:
    """doc, index, category, list text: the first matching rule of each of the index's categories."""
    rows = summaries.select("doc_id", "index_name", _once(_lists(), "lists_"))
    return rows.select("doc_id", "index_name", F.inline("lists_"))


def industry_mentions(lists: DataFrame) -> DataFrame:
    """One row per listed industry with its position (= rank)."""
    return lists.select("doc_id", "index_name", "category",
                        F.posexplode(split_industries(F.col("list_text"))).alias("rank", "industry_name"))


def sentence_mentions(summaries: DataFrame) -> DataFrame:
    """Fallback for summaries without any list: sentences with growth or decline words.

    A part with a digit or the word Index is the sentence about the value, not a name; such parts are left out.
    """
    rows = summaries.where(F.size(_lists()) == 0).select(
        "doc_id", "index_name", F.posexplode(F.split("summary", r"(?<=[.!?])\s+")).alias("sentence_no", "sentence"))
    s = F.col("sentence")
    marked = rows.select("doc_id", "index_name", "sentence_no", "sentence", F.explode(F.filter(F.array(
        F.when(any_present(F.lower(s), V.GROWTH_WORDS), F.lit("Growing")), F.when(any_present(F.lower(s), V.DECLINE_WORDS), F.lit("Declining"))),
        lambda c: c.isNotNull())).alias("category"))
    two_capitals = F.filter(F.split(s, ","), lambda x: x.rlike(r"[A-Z][a-z]+\s+[A-Z][a-z]+"))
    names = F.coalesce(split_industries(listed_names(s)), F.when(
        F.contains(s, F.lit(",")), F.transform(two_capitals, lambda x: F.trim(x))))
    names = F.filter(names, lambda x: ~x.rlike(r"\d|\bIndex\b"))
    return marked.select("doc_id", "index_name", "category", "sentence_no", F.posexplode(names).alias("pos", "industry_name"))


def resolved_mentions(summaries: DataFrame) -> DataFrame:
    """Mentions in which an industry listed in both categories of an index stays in the primary one only.

    Both lists of an index come from one summary, so they are settled inside its row, before they are exploded.
    """
    named = F.transform(_lists(), lambda e: F.struct(e["category"].alias("category"), split_industries(e["list_text"]).alias("names")))
    rows = summaries.select("doc_id", "index_name", F.inline(F.array(F.struct(named.alias("lists_")))))
    is_primary = F.col("category") == positive_category(F.col("index_name"))
    primary = F.flatten(F.transform(F.filter("lists_", lambda e: e["category"] == positive_category(F.col("index_name"))), lambda e: e["names"]))
    rows = rows.select("doc_id", "index_name", primary.alias("primary_"), F.inline("lists_"))
    placed = F.transform("names", lambda x, i: F.struct(i.alias("rank"), x.alias("industry_name")))
    kept = F.filter(placed, lambda m: is_primary | ~F.array_contains("primary_", m["industry_name"]))
    return rows.select("doc_id", "index_name", "category", F.inline(kept))


def merged_values(reports: DataFrame, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Value and direction of each index: the guarded one of its summary (source_order 2), else that of the glance table (1).

    Both come from one text, so they are merged inside its row: one scan and no exchange.
    """
    kind = "array<struct<index_name:string,value:double,direction:string,source_order:int>>"
    rows = _with_summaries(_with_glance(reports))
    sure = F.transform("summaries_", lambda x: F.struct(x["index_name"].alias("index_name"), _guarded(x["summary"], low, high).alias("g")))
    sure = F.transform(F.filter(sure, lambda x: x["g"].isNotNull()), lambda x: F.struct(
        x["index_name"].alias("index_name"), x["g"]["value"].alias("value"), x["g"]["direction"].alias("direction"), F.lit(2).alias("source_order")))
    glance = F.transform(F.coalesce("glance_", F.array().cast("array<struct<index_name:string,value:string,direction:string>>")), lambda x: F.struct(
        x["index_name"].alias("index_name"), x["value"].try_cast("double").alias("value"), x["direction"].alias("direction"), F.lit(1).alias("source_order")))
    both = rows.select("doc_id", F.inline(F.array(F.struct(sure.cast(kind).alias("sure_"), glance.cast(kind).alias("glance_")))))
    names = F.transform("sure_", lambda x: x["index_name"])
    rest = F.filter("glance_", lambda x: ~F.array_contains(names, x["index_name"]))
    return both.select("doc_id", F.inline(F.concat("sure_", rest)))


# ---- generated analyses -------------------------------------------------------------------
SECTION_PATTERNS = {
    "executive": r"(?i)executive\s+summary", "investor": r"(?i)investor\s+insights",
    "catalysts": r"(?i)catalysts?\s*(?:&|and)?\s*risks?|risks?\s*(?:&|and)?\s*catalysts?",
}


def analysis_bullets(analyses: DataFrame, keys: list[str]) -> DataFrame:
    """Bullets per section in order; an empty section gets the fixed sentence.

    The lines of one text are folded inside the row, so there is no exchange per line.
    """
    line = F.transform(F.split("analysis", "\n"), lambda x: F.trim(x))

    def section_of(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(SECTION_PATTERNS.items()):
            out = F.when(x.rlike(pattern), F.lit(name)).otherwise(out)
        return out

    heads = F.filter(F.transform(line, lambda x, i: F.struct(i.alias("at"), section_of(x).alias("section"))),
                     lambda h: h["section"].isNotNull())
    rows = analyses.select(*keys, line.alias("lines_"), heads.alias("heads_"))

    def bullet_at(x: Column, i: Column) -> Column:
        above = F.filter("heads_", lambda h: h["at"] < i)
        text = F.trim(F.regexp_replace(x, r"^[•\-* ]+", ""))
        good = section_of(x).isNull() & x.rlike(r"^[•\-*]") & (F.length(text) > 10) & (F.size(above) > 0)
        return F.when(good, F.struct(F.try_element_at(above, F.lit(-1))["section"].alias("section"), text.alias("bullet")))

    rows = rows.select(*keys, F.filter(F.transform("lines_", bullet_at), lambda b: b.isNotNull()).alias("bullets_"))

    def section_list(name: str) -> Column:
        found = F.transform(F.filter("bullets_", lambda b: b["section"] == name), lambda b: b["bullet"])
        shown = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(V.EMPTY_SECTION)))
        return F.struct(F.lit(name).alias("section"), shown.alias("bullets"))

    return rows.select(*keys, F.inline(F.array(*[section_list(n) for n in SECTION_PATTERNS]))).select(
        *keys, "section", F.posexplode("bullets").alias("pos", "bullet"))
