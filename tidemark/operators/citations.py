"""Citations in generated answers, run contexts and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.text import cited_numbers, domain_of, normalise_citations, pattern_hits, presence_count, strip_tags
from tidemark.operators.pages import page_title, publication_date

SECTION_HEADS = {"executive": "== EXECUTIVE SUMMARY ==", "investor": "== INVESTOR INSIGHTS ==",
                 "catalysts": "== CATALYSTS & RISKS =="}


def normalised(answers: DataFrame) -> DataFrame:
    return answers.withColumn("answer", normalise_citations(F.col("answer")))


def cited(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Cited source numbers per answer; `max_source` bounds the valid ones."""
    return answers.select(*keys, cited_numbers(F.col("answer"), F.col("max_source")).alias("cited"))


def resolved_citations(citations: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Each cited number with title, link and source of the run's source index."""
    rows = citations.select(*keys, F.posexplode("cited").alias("pos", "source_no"))
    return rows.join(sources, [*keys, "source_no"], "left")


def run_sources(articles: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Source index of every run: title, domain and date of the page behind each of its numbered articles.

    articles: keys, source_no, page_id; pages: page_id, url, html. Titles and dates are read off the pages before the join, so no page
    is exchanged. Articles without a page are left out.
    """
    known = pages.select("page_id", page_title(F.col("html")).alias("title"), domain_of(F.col("url")).alias("source"),
                         F.coalesce(publication_date(F.col("html")), F.lit("")).alias("published"))
    return articles.join(known, "page_id").select(*keys, "source_no", "title", "source", "published")


def contexts(bullets: DataFrame, sources: DataFrame, keys: list[str], header: Column) -> DataFrame:
    """One context document per run: header, three sections of bullets, source index.

    A run holds a handful of bullets and sources; the lines are ordered inside the group.
    """
    section_no = {name: i + 1 for i, name in enumerate(SECTION_HEADS)}
    order = F.coalesce(*[F.when(F.col("section") == n, F.lit(i)) for n, i in section_no.items()])
    lines = bullets.select(*keys, order.alias("block"), F.col("pos").cast("int").alias("pos"),
                           F.concat(F.lit("• "), strip_tags(F.col("bullet"))).alias("line"))
    heads = bullets.select(*keys).distinct().select(*keys, F.inline(F.array(
        F.struct(F.lit(0).alias("block"), F.lit(-1).alias("pos"), header.alias("line")),
        *[F.struct(F.lit(i).alias("block"), F.lit(-1).alias("pos"), F.lit(SECTION_HEADS[n]).alias("line"))
          for n, i in section_no.items()],
        F.struct(F.lit(4).alias("block"), F.lit(-1).alias("pos"), F.lit("== SOURCES INDEX ==").alias("line")))))
    listed = sources.select(*keys, F.lit(4).alias("block"), F.col("source_no").cast("int").alias("pos"), F.concat(
        F.lit("[S"), F.col("source_no").cast("string"), F.lit("] "), F.substring("title", 1, 60), F.lit(" | "),
        F.col("source"), F.lit(" | "), F.col("published")).alias("line"))
    everything = heads.unionByName(lines).unionByName(listed)
    return everything.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("block", "pos", "line"))), lambda x: x["line"]), "\n").alias("context"))


def quality_grade(score: Column) -> Column:
    return (F.when(score >= 9.0, "A+").when(score >= 8.5, "A").when(score >= 8.0, "A-").when(score >= 7.5, "B+")
            .when(score >= 7.0, "B").when(score >= 6.0, "B-").otherwise("C"))


def quality_gate(reviews: DataFrame) -> DataFrame:
    """Which text is used and whether the review passed.

    reviews: original_score, revised_score, searches (array of structs), sections_filled.
    """
    delta = F.col("revised_score") - F.col("original_score")
    useful = (delta >= 0.5) | (F.size("searches") >= 3)
    reason = (F.when(F.col("revised_score") >= 7.0, "meets threshold")
              .when((delta >= 1.0) & (F.col("revised_score") >= 6.0), "improved to acceptable")
              .otherwise("insufficient"))
    return reviews.withColumn("score_delta", delta).withColumn(
        "uses_enhanced", useful & (F.col("sections_filled") == 3)).withColumn("pass_reason", reason).withColumn(
        "passed", F.col("pass_reason") != "insufficient").withColumn("grade", quality_grade(F.col("revised_score")))


def review_summaries(reviews: DataFrame) -> DataFrame:
    """Counts, the first three updates and the findings that speak of current data."""
    firsts = F.transform(F.filter(F.slice("searches", 1, 3), lambda s: F.coalesce(s["data_updated"], F.lit("")) != ""),
                         lambda s: s["data_updated"])
    current = F.filter("searches", lambda s: F.contains(F.lower(s["key_finding"]), F.lit("current")))
    return reviews.withColumn("search_count", F.size("searches")).withColumn(
        "enhancement_count", F.size("enhancements")).withColumn("key_updates", F.array_join(firsts, "|")).withColumn(
        "top_enhancements", F.array_join(F.slice("enhancements", 1, 3), "|")).withColumn(
        "current_findings", F.size(current))


# ---- text metrics of two runs (retired) ---------------------------------------------------
def text_metrics(bullets: DataFrame, keys: list[str]) -> DataFrame:
    """Finance terms present and quantified statements over all bullets of a run."""
    b = F.col("bullet")
    return bullets.groupBy(*keys).agg(
        F.sum(presence_count(F.lower(b), V.QUALITY_TERMS)).alias("finance_terms"),
        F.sum(pattern_hits(b, V.QUANTIFIED_PATTERNS)).alias("quantified"))


def metric_improvement(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Relative change in percent of the second run over the first; NULL over zero."""
    a = base.select(*keys, F.col("finance_terms").alias("base_terms"), F.col("quantified").alias("base_quantified"))
    return a.join(other, keys).select(
        *keys, ((F.try_divide(F.col("finance_terms"), F.col("base_terms")) - 1) * 100).alias("terms_improvement"),
        ((F.try_divide(F.col("quantified"), F.col("base_quantified")) - 1) * 100).alias("quantified_improvement"))
