"""Rules of the retired news flow that have no successor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.text import any_present, lookup


def ambiguous_ticker(ticker: Column) -> Column:
    """Missing, one letter, or a common English word."""
    return F.coalesce((F.length(ticker) < 2) | F.upper(ticker).isin(V.AMBIGUOUS_TICKERS), F.lit(True))


def _phrase(text: Column, phrases: list[str], ticker: Column) -> Column:
    low = F.lower(ticker)
    return reduce(lambda a, b: a | b, [
        F.contains(text, F.replace(F.lit(p), F.lit("{t}"), low)) for p in phrases])


def preposition_flags(articles: DataFrame) -> DataFrame:
    """Obvious and likely false matches of a short ticker used as an ordinary word."""
    title, content = F.lower("title"), F.concat(F.lower("title"), F.lit(" "), F.lower("snippet"))
    short = F.coalesce(F.length("ticker") <= 4, F.lit(False))
    no_business = F.lower("section").isin(V.NON_BUSINESS_SECTIONS) & F.contains(title, F.lower("ticker"))
    obvious = F.when(no_business, ~any_present(title, V.BUSINESS_WORDS)).otherwise(
        _phrase(title, V.OBVIOUS_PREPOSITION_PHRASES, F.col("ticker")))
    named = F.coalesce(F.contains(content, F.lower("company_name")), F.lit(False))
    likely = ~named & _phrase(content, V.LIKELY_PREPOSITION_PHRASES, F.col("ticker"))
    return articles.select(
        "seq", "company", "ticker", ambiguous_ticker(F.col("ticker")).alias("ambiguous"),
        (short & F.coalesce(obvious, F.lit(False))).alias("obvious_preposition"),
        (short & F.coalesce(likely, F.lit(False))).alias("likely_preposition"))


def enhanced_scores(assessed: DataFrame) -> DataFrame:
    """(0.4 x relevance + 0.2 if specific) x source weight + bonuses, at most 2."""
    base = F.col("overall_relevance") * 0.4 + F.when(F.col("is_company_specific"), 0.2).otherwise(0.0)
    weight = F.coalesce(lookup(F.col("source_type"), V.ENHANCED_SOURCE_WEIGHTS), F.lit(1.0))
    bonus = (F.when(F.lower("source").isin(V.ENHANCED_PREMIUM), 0.2).otherwise(0.0)
             + F.when(F.length("full_content") > 300, 0.1).otherwise(0.0)
             + F.when(F.col("sentiment_label").isNotNull() & F.col("sentiment_score").isNotNull(), 0.1).otherwise(0.0))
    score = F.round(F.least(base * weight + bonus, F.lit(2.0)), 9)
    return assessed.select("seq", "company", "is_company_specific", "source_type",
                           F.inline(F.array(F.struct(score.alias("enhanced_score")))))


def enhanced_selection(scored: DataFrame, target: int = V.TARGET_ARTICLES) -> DataFrame:
    """Company-specific articles first, then those above 0.3, up to the target, by score."""
    first = W.partitionBy("company").orderBy(F.desc("is_company_specific"), F.desc("enhanced_score"), "seq")
    chosen = scored.where(F.col("is_company_specific") | (F.col("enhanced_score") > 0.3)).withColumn(
        "pick_", F.row_number().over(first)).where(F.col("pick_") <= target)
    order = W.partitionBy("company").orderBy(F.desc("enhanced_score"), "seq")
    return chosen.withColumn("place", F.row_number().over(order)).drop("pick_")


def source_share(articles: DataFrame, share: float = 0.25, least: int = 8) -> DataFrame:
    """Share of the sentiment feed per company, its target count and whether it is met."""
    premium = F.col("source_type") == "alphavantage_premium"
    rows = articles.groupBy("company").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(premium).alias("premium"), F.avg(premium.cast("double")).alias("share"))
    target = F.greatest(F.floor(F.col("total") * share), F.lit(least))
    return rows.withColumn("target", target.cast("bigint")).withColumn(
        "met", (F.col("share") >= share) | (F.col("premium") >= F.col("target")))


def sentiment_distribution(articles: DataFrame) -> DataFrame:
    """Counts by label, mean score and trend at +-0.2 over the sentiment feed, per company."""
    label = F.col("sentiment_label")
    rows = articles.where(F.col("source_type") == "alphavantage_premium").groupBy("company").agg(
        F.count(F.lit(1)).alias("articles"), F.count_if(label == "Bullish").alias("bullish"),
        F.count_if(label == "Neutral").alias("neutral"), F.count_if(label == "Bearish").alias("bearish"),
        F.avg("sentiment_score").alias("mean_score"))
    m = F.col("mean_score")
    return rows.withColumn("trend", F.when(m > 0.2, "Bullish").when(m < -0.2, "Bearish").otherwise("Neutral"))


def keyword_relevant(articles: DataFrame) -> DataFrame:
    """Articles that name the company, use a finance word and none of the negative terms."""
    content = F.concat(F.lower("title"), F.lit(" "), F.lower("snippet"))
    rows = articles.select("seq", "company", content.alias("content_"))
    c = F.col("content_")
    flag = F.contains(c, F.lower("company")) & any_present(c, V.RETIRED_FINANCE_WORDS) & ~any_present(c, V.RETIRED_NEGATIVE_WORDS)
    return rows.select("seq", "company", F.inline(F.array(F.struct(flag.alias("relevant")))))
