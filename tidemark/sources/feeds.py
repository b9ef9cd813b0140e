"""Article feeds and price bar feeds: landed JSON payloads to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.numbers import safe_double
from tidemark.functions.text import any_present, domain_of, strip_tags

ARTICLE = ["company", "title", "snippet", "full_content", "link", "source", "published", "source_type",
           "sentiment_score", "sentiment_label", "relevance_score", "section"]
SENTIMENT_FEED = ("feed array<struct<title:string,summary:string,url:string,time_published:string,ticker_sentiment:"
                  "array<struct<ticker:string,relevance_score:string,ticker_sentiment_score:string,"
                  "ticker_sentiment_label:string>>>>")
NEWSPAPER_FEED = ("docs array<struct<headline:struct<main:string>,abstract:string,lead_paragraph:string,web_url:string,"
                  "pub_date:string,section_name:string>>")


def _filled(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) != ""


def sentiment_feed(payloads: DataFrame, cutoff: Column) -> DataFrame:
    """Feed with per-ticker sentiment: payloads(company, ticker, payload)."""
    items = payloads.select("company", "ticker", F.explode(
        F.from_json("payload", SENTIMENT_FEED)["feed"]).alias("i"))
    day = F.try_to_timestamp(F.substring("i.time_published", 1, 8), F.lit("yyyyMMdd")).cast("date")
    kept = items.where(_filled(F.col("i.title")) & _filled(F.col("i.url")) & (day.isNull() | (day >= cutoff)))
    own = F.get(F.filter("i.ticker_sentiment", lambda t: t["ticker"] == F.col("ticker")), F.lit(0))
    return kept.select(
        "company", F.trim("i.title").alias("title"), F.substring(F.trim("i.summary"), 1, 300).alias("snippet"),
        F.trim("i.summary").alias("full_content"), F.trim("i.url").alias("link"), domain_of(F.trim("i.url")).alias("source"),
        F.col("i.time_published").alias("published"), F.lit("alphavantage_premium").alias("source_type"),
        F.coalesce(safe_double(own["ticker_sentiment_score"]), F.lit(0.0)).alias("sentiment_score"),
        F.coalesce(own["ticker_sentiment_label"], F.lit("Neutral")).alias("sentiment_label"),
        F.coalesce(safe_double(own["relevance_score"]), F.lit(0.0)).alias("relevance_score"))


def newspaper_feed(payloads: DataFrame, cutoff: Column, source: str = "nytimes.com") -> DataFrame:
    """Newspaper search results: abstract and lead joined if different; unreadable dates stay."""
    items = payloads.select("company", F.explode(F.from_json("payload", NEWSPAPER_FEED)["docs"]).alias("d"))
    day = F.substring("d.pub_date", 1, 10).try_cast("date")
    kept = items.where(_filled(F.col("d.headline.main")) & _filled(F.col("d.web_url")) & (day.isNull() | (day >= cutoff)))
    abstract, lead = F.trim("d.abstract"), F.trim("d.lead_paragraph")
    content = F.concat_ws(" ", F.nullif(abstract, F.lit("")), F.when(
        lead.isNotNull() & (lead != "") & (lead != F.coalesce(abstract, F.lit(""))), lead))
    return kept.withColumn("content", content).select(
        "company", F.trim("d.headline.main").alias("title"),
        F.when(F.col("content") != "", F.substring("content", 1, 400)).otherwise(F.col("d.headline.main")).alias("snippet"),
        F.col("content").alias("full_content"), F.trim("d.web_url").alias("link"), F.lit(source).alias("source"),
        F.col("d.pub_date").alias("published"), F.lit("nyt_api").alias("source_type"),
        F.col("d.section_name").alias("section"))


def rss_feed(entries: DataFrame, cutoff: Column, per_feed: int = 20) -> DataFrame:
    """First 20 entries of each feed that name the company or a finance word.

    entries(company, terms, feed, seq, title, link, description, published DATE). The rank is
    limited map-side, so feeds of any size are cheap.
    """
    order = W.partitionBy("company", "feed").orderBy("seq")
    first = entries.withColumn("place_", F.row_number().over(order)).where(F.col("place_") <= per_feed)
    plain = F.substring(strip_tags(F.coalesce("description", F.lit(""))), 1, 400)
    rows = first.where(_filled(F.col("title")) & _filled(F.col("link")) & (
        F.col("published").isNull() | (F.col("published") >= cutoff))).withColumn("text_", plain)
    content = F.concat(F.lower(F.trim("title")), F.lit(" "), F.lower("text_"))
    named = F.exists("terms", lambda t: F.contains(content, F.lower(t)))
    kept = rows.where(named | any_present(content, V.RSS_FINANCE_WORDS))
    body = F.when(F.col("text_") != "", F.col("text_")).otherwise(F.trim("title"))
    return kept.select(
        "company", F.trim("title").alias("title"), F.substring(body, 1, 300).alias("snippet"), body.alias("full_content"),
        F.trim("link").alias("link"), domain_of(F.trim("link")).alias("source"),
        F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit("")).alias("published"), F.lit("rss_feed").alias("source_type"))


def search_feed(results: DataFrame, present: DataFrame, cap: int = 15) -> DataFrame:
    """Search results whose link is not there yet, first 15 per company."""
    new = results.join(present.select("company", "link").distinct(), ["company", "link"], "left_anti")
    order = W.partitionBy("company").orderBy("seq")
    return new.withColumn("place_", F.row_number().over(order)).where(F.col("place_") <= cap).select(
        "company", "title", "snippet", F.col("snippet").alias("full_content"), "link",
        domain_of(F.col("link")).alias("source"), F.lit("google_search").alias("source_type"))


def all_feeds(feeds: list[DataFrame]) -> DataFrame:
    """Union of feeds with differing columns; a missing feed is simply absent from the list."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


# ---- price bars ---------------------------------------------------------------------------
BAR_MAP = "map<string,struct<open:string,high:string,low:string,close:string,adj_close:string,volume:string>>"


def bar_rows(payloads: DataFrame) -> DataFrame:
    """symbol, moment text and bar fields of payloads(symbol, payload) holding moment -> fields."""
    return payloads.select("symbol", F.explode(F.from_json("payload", BAR_MAP)).alias("moment", "bar")).select(
        "symbol", "moment", "bar.*")


def _number(name: str) -> Column:
    return F.col(name).try_cast("decimal(18,8)")


def normal_bars(rows: DataFrame, intraday: bool = False) -> DataFrame:
    """Typed bars; the adjusted close falls back to the close; malformed bars are dropped."""
    stamp = F.regexp_replace("moment", "T", " ").try_cast("timestamp_ntz")
    key = stamp.alias("moment") if intraday else stamp.cast("date").alias("date")
    typed = rows.select(
        "symbol", key, *[_number(c).alias(c) for c in ("open", "high", "low", "close")],
        F.coalesce(_number("adj_close"), _number("close")).alias("adj_close"),
        F.col("volume").try_cast("double").cast("bigint").alias("volume"))
    whole = [F.col(c).isNotNull() for c in (typed.columns[1], "open", "high", "low", "close", "volume")]
    return typed.where(reduce(lambda a, b: a & b, whole))
