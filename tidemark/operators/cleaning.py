"""Cleaning, standardisation and validation of extracted report facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.dates import parse_month
from tidemark.functions.numbers import clean_number
from tidemark.functions.text import first_upper, lookup
from tidemark.operators.industry_ranks import canonical_industries, negative_category, positive_category
from tidemark.operators.industry_ranks import valid_industry
from tidemark.runtime import small_dimension


# ---- scalars ------------------------------------------------------------------------------
def split_unparsed(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their month as a date, and the reject rows whose text is not a month."""
    parsed = rows.withColumn("report_date", parse_month(F.col(column)))
    return parsed.where(F.col("report_date").isNotNull()), parsed.where(F.col("report_date").isNull()).drop("report_date")


def is_change(value: Column) -> Column:
    """A sign in front marks a change, not a level."""
    return F.coalesce(value.rlike(r"^\s*[+-]"), F.lit(False))


def pick_level(*fields: Column) -> Column:
    """First field that holds a level, cleaned; NULL when none does."""
    return F.coalesce(*[F.when(~is_change(f), clean_number(f)) for f in fields])


def standard_direction(word: Column) -> Column:
    clean = F.lower(F.trim(word))
    return F.when(F.coalesce(clean, F.lit("")) == "", "Unknown").otherwise(
        F.coalesce(lookup(clean, V.DIRECTION_WORDS), first_upper(clean)))


# fixed values: words and phrases that are left of a list's sentence and name no industry
LEFTOVERS = ["are", "categories", *[m.lower() for m in V.MONTHS]]
LEFTOVER_BEGINS = ["in following order", "in the following order", "industries reporting", "listed in order"]
REPORTED = ["growth", "decline", "contraction", "expansion", "increase", "decrease", "slower", "faster"]
NON_INDUSTRIES = ["no change", "none reported", "not applicable", "none"]
FILLERS = ["the", "and", "only", "of", "in", "is", "are", "november", "order"]
OLD_LEFTOVERS = ["following order", "are:", "in order", "reporting", "categories"]
OLD_FILLERS = ["the", "and", "order"]


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _is_leftover(text: Column) -> Column:
    """Whether a line is a rest of the sentence around a list: a lead-in, a lone word, a number or a dash in front."""
    line = F.lower(_squeezed(text))
    begins = [line.startswith(x) for x in [*LEFTOVER_BEGINS, *[f"reporting {w}" for w in REPORTED], "-"]]
    alone = F.trim(F.regexp_replace(line, ":$", "")).isin(LEFTOVERS)
    numbered = line.rlike(r"^\d+\. |^\(\d+\)$")
    out = alone | numbered
    for b in begins:
        out = out | b
    return out


def _without(text: Column, *leads: str) -> Column:
    """The text without one lead after the other at its start, capitals or not."""
    for lead in leads:
        text = F.regexp_replace(text, f"(?i)^(?:{lead})", "")
    return text


def _filler(words: list[str]) -> str:
    return "(?:" + "|".join(words) + r")\s+"


def clean_industry(name: Column) -> Column:
    """Leftover lines, stop words, short rests and 'none' phrases removed; else NULL.

    A lone s in front (cut off a possessive), a dash, and a glued "and" before Primary go as well.
    """
    text = F.trim(name)
    out = _without(_squeezed(_without(text, _filler(FILLERS))), r"s\s+(?=\w)", r"[-—]\s+")
    out = F.regexp_replace(out, "[aA]ndPrimary", "Primary")
    bad = _is_leftover(text) | (F.length(out) < 3) | F.lower(out).isin(NON_INDUSTRIES)
    return F.when(~F.coalesce(bad, F.lit(True)), out)


def clean_industry_old(name: Column) -> Column:
    """The older rule set: also cuts a trailing 'products' and stray leading letters."""
    text = F.trim(name)
    out = _squeezed(F.regexp_replace(_without(text, _filler(OLD_FILLERS)), r"(?i)\s+products$", ""))
    out = _without(out, r"s\s+", r"[-—]\s+", r"[a-z]\s+")
    bad = F.lit(False)
    for phrase in OLD_LEFTOVERS:
        bad = bad | F.contains(F.lower(text), F.lit(phrase))
    bad = bad | F.substring(out, 1, 1).isin(list(",;:.")) | (F.length(out) < 3)
    return F.when(~F.coalesce(bad, F.lit(True)), out)


def clean_lists(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Names trimmed, artefacts and short ones dropped, first of each name (case ignored) kept."""
    name = F.trim("industry_name")
    bad = (F.length(name) < 3) | F.lower(name).isin("are:", "in order", "following order")
    rows = mentions.withColumn("industry_name", name).where(~F.coalesce(bad, F.lit(True)))
    return rows.groupBy(*keys, F.lower("industry_name").alias("low_")).agg(
        F.min("rank").alias("rank"), F.min_by("industry_name", "rank").alias("industry_name")).drop("low_")


# ---- canonical names ----------------------------------------------------------------------
def _aliases(names: list[str]) -> dict[str, str]:
    """Lower-case spellings of a canonical list; later ones win."""
    out: dict[str, str] = {}
    for name in names:
        spellings = [name, name.removesuffix(" Products"), name.replace(" & ", " and ")]
        if " & " in name or " and " in name:
            spellings.append(name.replace(" and ", " & ").split(" & ")[0])
        out.update({s.lower(): name for s in spellings})
    return out


LISTS = {"Manufacturing": V.MANUFACTURING_INDUSTRIES, "Services": V.SERVICES_INDUSTRIES}
ALIASES = {kind: _aliases(names) for kind, names in LISTS.items()}


def _per_type(report_type: Column, build) -> Column:
    return F.when(report_type == "Services", build("Services")).otherwise(build("Manufacturing"))


def _contained(clean: Column, kind: str) -> Column:
    """Longest containment match in either direction; the earlier list entry on a tie."""
    canon = F.array(*[F.struct(F.lit(-i).alias("first"), F.lit(n).alias("name")) for i, n in enumerate(LISTS[kind])])

    def score(entry: Column) -> Column:
        low = F.lower(entry["name"])
        size = F.when(F.contains(low, clean), F.length(clean)).when(F.contains(clean, low), F.length(low))
        return F.struct(size.alias("size"), entry["first"].alias("first"), entry["name"].alias("name"))

    hits = F.filter(F.transform(canon, score), lambda e: e["size"].isNotNull())
    return F.array_max(hits)["name"]


def canonical_industry(report_type: Column, raw: Column) -> Column:
    """Alias, else longest containment, else the raw name without footnote if over two characters."""
    clean = F.lower(F.trim(raw))
    rest = F.trim(F.regexp_replace(F.trim(raw), r"\s*\(\d+\)$", ""))
    return F.coalesce(
        _per_type(report_type, lambda k: lookup(clean, ALIASES[k])),
        F.when(clean != "", _per_type(report_type, lambda k: _contained(clean, k))),
        F.when(F.length(rest) > 2, rest))


def canonical_by_overlap(report_type: Column, raw: Column) -> Column:
    """Second rule set: alias, first containment in list order, most shared words, else raw."""
    clean = F.lower(F.trim(raw))
    words = F.split(clean, r"\s+")

    def first_contained(kind: str) -> Column:
        hits = F.filter(F.array(*[F.lit(n) for n in LISTS[kind]]), lambda n: F.contains(
            F.lower(n), clean) | F.contains(clean, F.lower(n)))
        return F.get(hits, F.lit(0))

    def most_shared(kind: str) -> Column:
        canon = F.array(*[F.struct(F.lit(-i).alias("first"), F.lit(n).alias("name")) for i, n in enumerate(LISTS[kind])])
        scored = F.transform(canon, lambda e: F.struct(
            F.size(F.array_intersect(words, F.split(F.lower(e["name"]), r"\s+"))).alias("n"), e["first"].alias("first"),
            e["name"].alias("name")))
        return F.array_max(F.filter(scored, lambda e: e["n"] > 0))["name"]

    return F.coalesce(_per_type(report_type, lambda k: lookup(clean, ALIASES[k])), _per_type(report_type, first_contained),
                      _per_type(report_type, most_shared), F.trim(raw))


def standardised_mentions(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Mentions under canonical names, ordered de-duplication after the mapping.

    Few spellings repeat over very many rows, so the mapping runs on the distinct ones.
    """
    spellings = mentions.select("report_type", "raw_industry").distinct().withColumn(
        "industry_name", canonical_industry(F.col("report_type"), F.col("raw_industry")))
    named = mentions.drop("industry_name").join(spellings, ["report_type", "raw_industry"]).where(
        F.col("industry_name").isNotNull())
    return named.groupBy(*keys, "industry_name").agg(F.min("rank").alias("rank"))


# ---- reports ------------------------------------------------------------------------------
def harmonise_names(facts: DataFrame, drop_old: bool = False) -> DataFrame:
    """Index names of the report's own type; a rename happens only if the target is absent.

    With `drop_old` the old name vanishes even when both exist; otherwise both stay.
    """
    renames = V.RENAMES_DROP_OLD if drop_old else V.RENAMES_KEEP_BOTH
    target = _per_type(F.col("report_type"), lambda k: lookup(F.col("index_name"), renames[k]))
    rows = facts.withColumn("target_", F.coalesce(target, F.col("index_name")))
    report = W.partitionBy("report_id", "target_")
    has_original = F.max(F.col("index_name") == F.col("target_")).over(report)
    first_old = F.row_number().over(report.orderBy((F.col("index_name") == F.col("target_")).desc(), "index_name"))
    rows = rows.withColumn("has_", has_original).withColumn("place_", first_old)
    renamed = F.col("index_name") != F.col("target_")
    if drop_old:
        kept = rows.where(F.col("place_") == 1)
        name = F.col("target_")
    else:
        kept = rows
        name = F.when(renamed & (F.col("has_") | (F.col("place_") > 1)), F.col("index_name")).otherwise(F.col("target_"))
    return kept.withColumn("index_name", name).drop("target_", "has_", "place_")


def type_by_headline(facts: DataFrame) -> DataFrame:
    """Report type from the headline index present; the stated one otherwise."""
    def has(kind: str) -> Column:
        return F.max(F.col("index_name") == V.HEADLINE[kind])

    return facts.groupBy("report_id").agg(
        has("Manufacturing").alias("m"), has("Services").alias("s"), F.max("report_type").alias("stated")).select(
        "report_id", F.when(F.col("m") & ~F.col("s"), "Manufacturing").when(F.col("s") & ~F.col("m"), "Services")
        .otherwise(F.col("stated")).alias("report_type"))


def standard_report_type(text: Column) -> Column:
    return F.coalesce(lookup(F.lower(F.trim(text)), V.REPORT_TYPE_ALIASES), F.lit("Manufacturing"))


def repair_values(facts: DataFrame) -> DataFrame:
    """Replaces levels that look like changes by the series index (current, series_index texts)."""
    series_text = F.regexp_replace("series_index", r"[+\-]", "")
    series = series_text.try_cast("double")
    signed = is_change(F.col("current")) & series.between(20, 80)
    plain = F.regexp_replace("current", r"[+\-]", "").try_cast("double")
    prone = F.col("index_name").isin(V.CHANGE_PRONE_INDICES)
    small = prone & (F.abs(plain) < 15) & (series > 20)
    return facts.withColumn("value", F.when(F.coalesce(signed | small, F.lit(False)), series).otherwise(
        F.when(~is_change(F.col("current")), plain))).withColumn(
        "needs_correction", F.coalesce(prone & is_change(F.col("current")) & F.contains("current", F.lit(".")), F.lit(False)))


def impute_headline(facts: DataFrame) -> DataFrame:
    """Adds the mean of the available components as headline where a report lacks it."""
    kind, name = F.col("report_type"), F.col("index_name")
    component = _per_type(kind, lambda k: name.isin(V.HEADLINE_COMPONENTS[k]))
    head = _per_type(kind, lambda k: F.lit(V.HEADLINE[k]))
    missing = facts.groupBy("report_id", "report_type").agg(
        F.max(name == head).alias("has_"), F.avg(F.when(component, F.col("value"))).alias("value")).where(
        ~F.col("has_") & F.col("value").isNotNull())
    inferred = missing.select(
        "report_id", "report_type", head.alias("index_name"), "value",
        F.when(F.col("value") >= 50, "Growing").otherwise("Contracting").alias("direction"), F.lit(True).alias("inferred"))
    return facts.withColumn("inferred", F.lit(False)).select(inferred.columns).unionByName(inferred)


def one_category_each(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Each industry once per index: its first category (primary before secondary) wins."""
    block = F.when(F.col("category") == positive_category(F.col("index_name")), 0).otherwise(1)
    order = W.partitionBy(*keys, "industry_name").orderBy(block, "category", "rank")
    return mentions.withColumn("place_", F.row_number().over(order)).where(F.col("place_") == 1).drop("place_")


def expected_indices(spark, with_headline: bool = True) -> DataFrame:
    rows = [(k, n) for k, names in (("Manufacturing", V.MANUFACTURING_INDICES), ("Services", V.SERVICES_INDICES))
            for n in names if with_headline or n != V.HEADLINE[k]]
    return small_dimension(spark, ["report_type", "index_name"], rows)


def complete_grid(reports: DataFrame, mentions: DataFrame) -> DataFrame:
    """Every (report, index, category) with its ordered industries; empty lists stay."""
    expected = expected_indices(reports.sparkSession, with_headline=False).withColumn("category", F.explode(
        F.array(positive_category(F.col("index_name")), negative_category(F.col("index_name")))))
    grid = reports.select("report_id", "report_type").join(expected, "report_type")
    listed = mentions.where(valid_industry(F.col("industry_name"))).groupBy("report_id", "index_name", "category").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "industry_name"))), lambda x: x["industry_name"])
        .alias("industries"))
    return grid.join(listed, ["report_id", "index_name", "category"], "left").withColumn(
        "industries", F.coalesce("industries", F.array().cast("array<string>")))


def validation_verdicts(reports: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per expected index: an expected category is present and holds at least one industry."""
    name, category = F.col("index_name"), F.lower("category")
    expected = (category == F.lower(positive_category(name))) | (
        category == F.lower(negative_category(name)))
    seen = mentions.where(F.col("industry_name").isNotNull()).groupBy("report_id", "index_name").agg(
        F.max(expected).alias("valid"))
    grid = reports.select("report_id", "report_type").join(
        expected_indices(reports.sparkSession, with_headline=False), "report_type")
    return grid.join(seen, ["report_id", "index_name"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def missing_indices(reports: DataFrame, facts: DataFrame) -> DataFrame:
    """Expected indices a report has no fact for."""
    grid = reports.select("report_id", "report_type").join(expected_indices(reports.sparkSession), "report_type")
    return grid.join(facts.select("report_id", "index_name").distinct(), ["report_id", "index_name"], "left_anti")


def merge_extractions(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two industry extractions per report: the larger one leads, unseen ones append."""
    both = first.withColumn("source_", F.lit(1)).unionByName(second.withColumn("source_", F.lit(2)))
    sizes = both.groupBy("report_id", "source_").agg(F.count(F.lit(1)).alias("n"))
    leader = sizes.groupBy("report_id").agg(F.max_by("source_", F.struct("n", -F.col("source_"))).alias("leader_"))
    ordered = both.join(leader, "report_id").withColumn("late_", (F.col("source_") != F.col("leader_")).cast("int"))
    once = ordered.groupBy("report_id", "index_name", "category", "industry_name").agg(
        F.min(F.struct("late_", "rank")).alias("at_"))
    place = F.row_number().over(W.partitionBy("report_id", "index_name", "category").orderBy("at_", "industry_name"))
    return once.withColumn("rank", place - 1).drop("at_")


def validated_reports(facts: DataFrame) -> DataFrame:
    """The whole pipeline over (report_id, month_text, report_type, index_name, value_text, direction):
    coerce, standardise, infer type, impute the headline."""
    clean = facts.select(
        "report_id", parse_month(F.col("month_text")).alias("report_date"),
        standard_report_type(F.col("report_type")).alias("report_type"), "index_name",
        clean_number(F.col("value_text")).alias("value"), standard_direction(F.col("direction")).alias("direction"))
    kinds = type_by_headline(clean)
    typed = clean.drop("report_type").join(kinds, "report_id")
    dates = typed.groupBy("report_id").agg(F.max("report_date").alias("report_date"))
    return impute_headline(typed.drop("report_date")).join(dates, "report_id")
