"""News relevance: company identifiers, scores, selection, coverage.

Role: articles(seq, company, title, snippet, full_content, link, source, source_type,
sentiment_score, sentiment_label, relevance_score, ...), one row per article and company.
Scores are row-wise expressions; nothing is shuffled before the per-company selection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.numbers import half_up
from tidemark.functions.text import (
    any_present, count_of, lookup, pattern_hits, presence_count, weighted_presence, whole_word_count, word_spaced,
    word_total)


# ---- identifiers --------------------------------------------------------------------------
def without_suffixes(name: Column, lower: bool = False) -> Column:
    """The name with every corporate suffix text removed, in list order."""
    out = name
    for suffix in V.COMPANY_SUFFIXES:
        out = F.replace(out, F.lit(suffix.lower() if lower else suffix), F.lit(""))
    return out


def looks_like_ticker(text: Column) -> Column:
    clean = F.upper(F.trim(text))
    letters = F.regexp_replace(clean, r"[.\-]", "")
    return (F.length(clean) <= 5) & letters.rlike(r"^\p{L}+$")


def resolve_companies(requests: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Adds ticker and company_name: alias list, then ticker form, then an instrument table.

    `known` (symbol, name) stands in for online look-ups; without it a ticker has no name and
    an unknown name has no ticker.
    """
    key = F.lower(F.trim("company"))
    ticker = lookup(key, {k: v[0] for k, v in V.COMPANY_ALIASES.items()})
    name = lookup(key, {k: v[1] for k, v in V.COMPANY_ALIASES.items()})
    tick = looks_like_ticker(F.col("company"))
    rows = requests.withColumn("alias_ticker", ticker).withColumn("alias_name", name).withColumn(
        "typed_ticker", F.when(F.col("alias_ticker").isNull() & tick, F.upper("company")))
    if known is None:
        looked_name, looked_ticker = F.lit(None).cast("string"), F.lit(None).cast("string")
    else:
        by_symbol = known.select(F.upper("symbol").alias("typed_ticker"), F.col("name").alias("looked_name"))
        by_name = known.select(F.lower("name").alias("looked_key"), F.col("symbol").alias("looked_ticker"))
        rows = rows.join(by_symbol, "typed_ticker", "left").withColumn(
            "looked_key", F.when(F.col("alias_ticker").isNull() & F.col("typed_ticker").isNull(), key)).join(
            by_name, "looked_key", "left").drop("looked_key")
        looked_name, looked_ticker = F.col("looked_name"), F.col("looked_ticker")
    return rows.withColumn("ticker", F.coalesce("alias_ticker", "typed_ticker", looked_ticker)).withColumn(
        "company_name", F.when(F.col("alias_ticker").isNotNull(), F.col("alias_name"))
        .when(F.col("typed_ticker").isNotNull(), looked_name).otherwise(F.col("company"))
    ).drop("alias_ticker", "alias_name", "typed_ticker", "looked_name", "looked_ticker")


def search_terms() -> Column:
    """Input, ticker, name and shortened name: the first three distinct ones."""
    short = without_suffixes(F.col("company_name"))
    terms = F.array(F.trim("company"), F.col("ticker"), F.col("company_name"),
                    F.when(short != F.col("company_name"), short))
    return F.slice(F.array_distinct(F.filter(terms, lambda t: t.isNotNull())), 1, 3)


def identifiers() -> Column:
    """Lower-case texts that count as the company."""
    name = F.lower("company_name")
    found = F.array(F.lower(F.trim("company")), F.lower("ticker"), name, without_suffixes(name, lower=True))
    return F.array_distinct(F.filter(found, lambda t: t.isNotNull() & (t != "")))


# ---- scores -------------------------------------------------------------------------------
def combined_text() -> Column:
    content = F.when(F.coalesce("snippet", F.lit("")) != "", F.col("snippet")).otherwise(
        F.coalesce("full_content", F.lit("")))
    return F.concat(F.lower(F.coalesce("title", F.lit(""))), F.lit(" "), F.lower(content))


def mention_score(text: Column, spaced: Column, ids: Column) -> Column:
    """0.3 per hit in the first 100 characters, 0.2 per whole word, 10 x hits per word; at most 1."""
    head = F.substring(text, 1, 100)
    weighted = F.aggregate(
        ids, F.lit(0.0),
        lambda acc, i: acc + count_of(head, i) * 0.3 + whole_word_count(spaced, i) * 0.2)
    hits = F.aggregate(ids, F.lit(0), lambda acc, i: acc + count_of(text, i))
    density = F.coalesce(F.try_divide(hits, word_total(text)), F.lit(0.0)) * 10
    return F.least(weighted + density, F.lit(1.0))


def finance_score(text: Column) -> Column:
    """0.1 x weight per keyword present, 0.15 per pattern hit, 0.1 per phrase; at most 1."""
    score = (weighted_presence(text, {k: v * 0.1 for k, v in V.FINANCE_KEYWORDS.items()})
             + pattern_hits(text, V.FINANCE_PATTERNS, ignore_case=False) * 0.15
             + presence_count(text, V.BUSINESS_PHRASES) * 0.1)
    return F.least(score, F.lit(1.0))


def quality_score() -> Column:
    """Length, source type, long content and sentiment data; at most 1."""
    full = F.coalesce(F.length("full_content"), F.lit(0))
    size = F.coalesce(F.length("snippet"), F.lit(0)) + full
    by_size = F.when(size > 500, 0.3).when(size > 200, 0.2).when(size > 100, 0.1).otherwise(0.0)
    by_type = F.coalesce(lookup(F.col("source_type"), V.SOURCE_TYPE_QUALITY), F.lit(0.0))
    extra = F.when(full > 300, 0.2).otherwise(0.0) + F.when(
        F.col("sentiment_label").isNotNull() & F.col("sentiment_score").isNotNull(), 0.1).otherwise(0.0)
    return F.least(by_size + by_type + extra, F.lit(1.0))


def source_score() -> Column:
    weight = lookup(F.lower("source"), {k: float(v) for k, v in V.PREMIUM_SOURCES.items()})
    return F.coalesce(weight, F.lit(V.UNKNOWN_SOURCE_WEIGHT)) / 20


def negative_penalty(text: Column) -> Column:
    return F.least(presence_count(text, V.NEGATIVE_INDICATORS) * 0.1, F.lit(0.5))


def assess(articles: DataFrame) -> DataFrame:
    """Adds the five scores, the overall relevance and the company-specific flag.

    `articles` must carry ticker and company_name (see resolve_companies).
    """
    rows = articles.withColumn("text_", combined_text()).withColumn("ids_", identifiers())
    mentioned = F.exists("ids_", lambda i: F.contains(F.col("text_"), i))
    rows = rows.withColumn("spaced_", F.when(mentioned, word_spaced(F.col("text_"))).otherwise(" "))
    parts = {"m_": mention_score(F.col("text_"), F.col("spaced_"), F.col("ids_")), "f_": finance_score(F.col("text_")),
             "q_": quality_score(), "s_": source_score(), "n_": negative_penalty(F.col("text_"))}
    # nine digits cut the float noise of the sums before they meet the thresholds; as a generated
    # row the scores are computed once, plain columns would be repeated in every later filter
    rows = rows.select("*", F.inline(F.array(F.struct(*[F.round(v, 9).alias(k) for k, v in parts.items()]))))
    overall = F.col("m_") * 0.4 + F.col("f_") * 0.3 + F.col("q_") * 0.2 + F.col("s_") * 0.1 - F.col("n_")
    rows = rows.withColumn("o_", F.round(F.least(F.greatest(overall, F.lit(0.0)), F.lit(1.0)), 9))
    specific = (F.col("m_") >= 0.6) & (F.col("f_") >= 0.3) & (F.col("o_") >= 0.5)
    names = {"m_": "company_relevance", "f_": "financial_context", "q_": "content_quality",
             "s_": "source_quality", "o_": "overall_relevance", "n_": "negative_penalty"}
    return rows.select(
        *[c for c in articles.columns], *[half_up(F.col(c), 3).alias(n) for c, n in names.items()],
        specific.alias("is_company_specific"))


def batch_statistics(assessed: DataFrame) -> DataFrame:
    """Articles, company-specific ones, their share and the mean relevance per company."""
    specific = F.col("is_company_specific")
    return assessed.groupBy("company").agg(
        F.count(F.lit(1)).alias("total_articles"), F.count_if(specific).alias("relevant_articles"),
        F.avg(specific.cast("double")).alias("relevance_share"),
        F.avg("overall_relevance").alias("average_relevance"),
        F.count_if(specific | (F.col("overall_relevance") >= 0.3)).alias("lenient_articles"))


def relevant_articles(assessed: DataFrame, statistics: DataFrame) -> DataFrame:
    """Company-specific articles; in batches below ten also those of relevance 0.3 or more.

    The per-company totals come from a pre-aggregated table, so no company's articles are
    gathered in one task.
    """
    sized = assessed.join(statistics.select("company", "total_articles"), "company")
    small = (F.col("total_articles") < 10) & (F.col("overall_relevance") >= 0.3)
    return sized.withColumn("is_relevant", F.col("is_company_specific") | small).drop("total_articles")


def escalation(statistics: DataFrame) -> DataFrame:
    """Whether a company's batch needs the extra search feed, with the reason."""
    small = F.col("total_articles") < 10
    relevant = F.when(small, F.col("lenient_articles")).otherwise(F.col("relevant_articles"))
    rows = statistics.withColumn("relevant_count", relevant)
    n = F.col("relevant_count")
    reason = (F.when(n < V.TARGET_ARTICLES / 2, "too few relevant").when(F.col("total_articles") < 15, "low volume")
              .when(n < 8, "insufficient relevant")
              .when((n >= 15) & (F.col("relevance_share") >= 0.4), "sufficient").otherwise("avoid filler"))
    return rows.select("company", "total_articles", "relevant_count", "relevance_share",
                       (reason != "sufficient").alias("escalate"), reason.alias("reason"))


def mention_synonyms(text: Column, company: Column) -> Column:
    """True when a synonym listed for the company occurs."""
    hits = [(F.lower(company) == c) & any_present(text, words) for c, words in V.COMPANY_SYNONYMS.items()]
    return reduce(lambda a, b: a | b, hits)


LEAST_SCORE = -30


def scored_articles(articles: DataFrame) -> DataFrame:
    """Ranking score; articles below LEAST_SCORE are dropped."""
    return ranked_articles(articles).where(F.col("score") >= LEAST_SCORE)


def ranked_articles(articles: DataFrame) -> DataFrame:
    """Adds the ranking score and the two flags of the backfill, for every article."""
    title = F.lower(F.coalesce("title", F.lit("")))
    content = F.concat(title, F.lit(" "), F.lower(F.coalesce("snippet", F.lit(""))))
    rows = articles.withColumn("title_", title).withColumn("content_", content)
    name = F.lower("company")
    rows = rows.withColumn("mentions_", count_of(F.col("content_"), name)).withColumn(
        "excused_", mention_synonyms(F.col("content_"), F.col("company")))
    source = F.lower("source")
    listed = {k: float(v) for k, v in {**V.UNWANTED_SOURCES, **V.PREMIUM_SOURCES}.items()}
    score = (
        F.when((F.col("mentions_") == 0) & ~F.col("excused_"), -50.0).otherwise(0.0)
        + F.coalesce(lookup(source, listed), F.lit(0.0))
        + F.when(F.col("source_type") == "alphavantage_premium",
                 15 + F.coalesce("relevance_score", F.lit(0.0)) * 10)
        .when(F.col("source_type") == "nyt_api", 25.0).when(F.col("source_type") == "rss_feed", 8.0).otherwise(0.0)
        + F.when(F.col("mentions_") > 0,
                 F.when(F.contains(F.col("title_"), name), 10.0).otherwise(0.0)
                 + F.least(F.col("mentions_") * 3, F.lit(15))).otherwise(0.0)
        + presence_count(F.col("content_"), V.SCORE_KEYWORDS) * 2)
    # as a generated row the score is computed once; a plain column would be repeated in the filter
    ranked = rows.select("*", F.inline(F.array(F.struct(score.alias("score")))))
    return ranked.withColumn(
        "mentions_company", (F.col("mentions_") > 0) | F.col("excused_")).withColumn(
        "has_finance_word", any_present(F.col("content_"), V.BACKFILL_KEYWORDS)).drop(
        "title_", "content_", "mentions_", "excused_")


def final_selection(scored: DataFrame, target: int = V.TARGET_ARTICLES) -> DataFrame:
    """Top articles per company: relevant ones by score, then eligible backfill.

    Needs is_relevant, score, mentions_company and has_finance_word. The rank filter is applied
    map-side before the exchange, so a company with a third of all rows stays cheap.
    """
    backfill = F.col("mentions_company") | (F.col("has_finance_word") & (F.col("score") > 10))
    order = W.partitionBy("company").orderBy(F.desc("is_relevant"), F.desc("score"), "seq")
    return scored.where(F.col("is_relevant") | backfill).withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= target)


def relevance_by_link(scored: DataFrame, relevant: DataFrame) -> DataFrame:
    """Marks scored articles whose link belongs to a relevant article of the same company."""
    links = relevant.where("is_relevant").select("company", "link").distinct().withColumn("is_relevant", F.lit(True))
    return scored.drop("is_relevant").join(links, ["company", "link"], "left").withColumn(
        "is_relevant", F.coalesce("is_relevant", F.lit(False)))


def coverage(selected: DataFrame, feed_counts: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Counts per feed, premium share and tier per company."""
    premium = F.col("source").isin(list(V.PREMIUM_SOURCES))
    chosen = selected.groupBy("company").agg(
        F.count(F.lit(1)).alias("total_articles"), F.count_if(premium).alias("premium_count"))
    rows = feed_counts.join(chosen, "company", "left").fillna(0, ["total_articles", "premium_count"])
    share = F.coalesce(F.try_divide(F.col("premium_count"), F.col("total_articles")) * 100, F.lit(0.0))
    rows = rows.withColumn("share", share)
    if quality is not None:
        rows = rows.join(quality.select("company", "quality_score"), "company", "left")
    else:
        rows = rows.withColumn("quality_score", F.lit(None).cast("double"))
    a, p = F.col("alphavantage_articles"), F.col("share")
    tier = (F.when(F.col("quality_score") >= 8.5, "Premium+").when((a >= 8) & (p >= 40), "Premium")
            .when((a >= 5) & (p >= 30), "Institutional").when((a >= 3) | (p >= 40), "Professional")
            .when(F.col("total_articles") >= 10, "Standard").otherwise("Limited"))
    return rows.select("company", "total_articles", "premium_count", "alphavantage_articles", "nyt_articles",
                       "rss_articles", "google_articles", F.round("share", 1).alias("premium_coverage"), tier.alias("tier"))


def feed_counts(articles: DataFrame) -> DataFrame:
    kind = F.col("source_type")
    return articles.groupBy("company").agg(
        F.count_if(kind == "alphavantage_premium").alias("alphavantage_articles"),
        F.count_if(kind == "nyt_api").alias("nyt_articles"), F.count_if(kind == "rss_feed").alias("rss_articles"),
        F.count_if(kind == "google_search").alias("google_articles"))


def budgeted_sample(assessed: DataFrame) -> DataFrame:
    """Review sample per company: up to 12 relevant rows in detail, then others up to 18 rows.

    Relevant rows cost 200 units each and stop once more than 10,000 are spent; others cost 100
    and stop beyond 12,000. Both ranks are limited before the exchange.
    """
    high = F.col("is_company_specific") | (F.col("overall_relevance") > 0.5)
    rows = assessed.withColumn("level", F.when(high, "high").otherwise("standard"))
    order = W.partitionBy("company", "level").orderBy("seq")
    placed = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 18)
    placed = placed.where((F.col("level") == "standard") | ((F.col("place") <= 12) & ((F.col("place") - 1) * 200 <= 10000)))
    company = W.partitionBy("company")
    counted = placed.withColumn("high_rows", F.count(F.when(F.col("level") == "high", 1)).over(company))
    spent = F.col("high_rows") * 200 + (F.col("place") - 1) * 100
    fits = (F.col("high_rows") + F.col("place") <= 18) & (spent <= 12000)
    kept = counted.where((F.col("level") == "high") | fits)
    detailed = F.col("level") == "high"
    return kept.select(
        "company", "seq", "level", "place",
        F.when(detailed, F.col("title")).otherwise(F.substring("title", 1, 80)).alias("title"),
        F.when(detailed, F.substring("snippet", 1, 400)).otherwise(F.substring("snippet", 1, 120)).alias("snippet"),
        F.when(detailed & (F.col("source_type") == "alphavantage_premium"), F.col("sentiment_label")).alias("sentiment_label"))


def first_link_per_source(articles: DataFrame) -> DataFrame:
    return articles.where(F.coalesce("link", F.lit("")) != "").groupBy("company", "source").agg(
        F.min_by("link", "seq").alias("link"))


def source_index(selected: DataFrame) -> DataFrame:
    """1-based source number per company with link, title, date and source."""
    order = W.partitionBy("company").orderBy("place")
    return selected.select("company", F.row_number().over(order).alias("source_no"), "link", "title", "published", "source")
