"""Company analytics: earnings, financial ratios, sentiment, portfolio context, health score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.numbers import safe_double


# ---- earnings and statements --------------------------------------------------------------
def earnings_surprises(feed: DataFrame) -> DataFrame:
    """Quarters with both EPS values: surprise, surprise % (0 for a zero estimate), outcome."""
    parsed = feed.select("symbol", "fiscal_date", "reported_date",
                         safe_double(F.col("reported_eps")).alias("reported"),
                         safe_double(F.col("estimated_eps")).alias("estimated"))
    both = parsed.where(F.col("reported").isNotNull() & F.col("estimated").isNotNull())
    surprise = F.col("reported") - F.col("estimated")
    return both.withColumn("surprise", surprise).withColumn(
        "surprise_pct", F.coalesce(F.try_divide(surprise, F.col("estimated")) * 100, F.lit(0.0))).withColumn(
        "outcome", F.when(surprise > 0, "beat").when(surprise < 0, "miss").otherwise("meet"))


def beat_rates(surprises: DataFrame) -> DataFrame:
    """Share of beats in percent and counts of beats, misses and meets per symbol."""
    outcome = F.col("outcome")
    return surprises.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("quarters"), F.count_if(outcome == "beat").alias("beats"),
        F.count_if(outcome == "miss").alias("misses"), F.count_if(outcome == "meet").alias("meets"),
        (F.avg((outcome == "beat").cast("double")) * 100).alias("beat_rate"))


def statement_table(feed: DataFrame) -> DataFrame:
    """symbol, kind, period, fiscal_date, data: the nested feed flattened."""
    parts = [(f"{kind}_{period}", kind, period)
             for kind in ("income", "balance", "cash") for period in ("quarterly", "annual")]
    nested = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(period).alias("period"), F.col(name).alias("rows"))
                       for name, kind, period in parts])
    return feed.select("symbol", F.inline(nested)).select(
        "symbol", "kind", "period", F.explode("rows").alias("data")).select(
        "symbol", "kind", "period", F.col("data")["fiscalDateEnding"].alias("fiscal_date"), "data")


def financial_ratios(statements: DataFrame) -> DataFrame:
    """Per fiscal date: revenue and income (billions), margin %, free cash flow, ROE %.

    One conditional aggregation over the statement kinds replaces the three look-ups.
    """
    def field(kind: str, name: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, safe_double(F.try_element_at("data", F.lit(name)))))

    rows = statements.groupBy("symbol", "period", "fiscal_date").agg(
        F.max(F.col("kind") == "income").alias("has_income"),
        field("income", "totalRevenue").alias("revenue"), field("income", "netIncome").alias("income"),
        field("balance", "totalShareholderEquity").alias("equity"),
        field("cash", "operatingCashflow").alias("operating"), field("cash", "capitalExpenditures").alias("capex"))
    return rows.where("has_income").select(
        "symbol", "period", "fiscal_date", (F.col("revenue") / 1e9).alias("revenue_bn"),
        (F.col("income") / 1e9).alias("net_income_bn"),
        (F.try_divide(F.col("income"), F.col("revenue")) * 100).alias("margin_pct"),
        ((F.col("operating") + F.col("capex")) / 1e9).alias("free_cash_flow_bn"),
        (F.try_divide(F.col("income"), F.col("equity")) * 100).alias("roe_pct"))


# ---- sentiment ----------------------------------------------------------------------------
def parsed_news(feed: DataFrame) -> DataFrame:
    """Articles with the sentiment of their own ticker (0 / Neutral when absent) and topics."""
    own = F.get(F.filter("ticker_sentiment", lambda t: t["ticker"] == F.col("symbol")), F.lit(0))
    return feed.select(
        "article_id", "symbol", "overall_sentiment_score",
        F.try_to_timestamp("time_published", F.lit("yyyyMMdd'T'HHmmss")).alias("published_at"),
        F.coalesce(safe_double(own["relevance_score"]), F.lit(0.0)).alias("relevance_score"),
        F.coalesce(safe_double(own["ticker_sentiment_score"]), F.lit(0.0)).alias("ticker_score"),
        F.coalesce(own["ticker_sentiment_label"], F.lit("Neutral")).alias("ticker_label"),
        F.transform("topics", lambda t: t["topic"]).alias("topics"))


def sentiment_trend(news: DataFrame) -> DataFrame:
    return news.groupBy("symbol", F.to_date("published_at").alias("date")).agg(
        F.avg("ticker_score").alias("score"), F.count(F.lit(1)).alias("article_count"))


def topic_distribution(news: DataFrame) -> DataFrame:
    return news.select("symbol", F.explode("topics").alias("topic")).groupBy("symbol", "topic").agg(
        F.count(F.lit(1)).alias("articles"))


def sentiment_class(news: DataFrame, topics: list[str] | None = None, day: str | None = None) -> DataFrame:
    """Mean score and class at +-0.15, optionally for articles with any of the topics or a date."""
    rows = news
    if topics:
        rows = rows.where(F.arrays_overlap("topics", F.array(*[F.lit(t) for t in topics])))
    if day:
        rows = rows.where(F.to_date("published_at") == F.lit(day).cast("date"))
    return rows.groupBy("symbol").agg(
        F.avg("ticker_score").alias("score"), F.count(F.lit(1)).alias("articles")).withColumn(
        "class", F.when(F.col("score") > 0.15, "bullish").when(F.col("score") < -0.15, "bearish").otherwise("neutral"))


# ---- portfolio context --------------------------------------------------------------------
def portfolio_context(holdings: DataFrame, contributions: DataFrame, period: str = "90d") -> DataFrame:
    """Shares, weight and contribution of each holding; unpriced ones count zero."""
    part = contributions.where(F.col("period") == period).select(
        "portfolio_id", "symbol", F.col("weight").alias("part_weight"), F.col("contribution").alias("part"))
    return holdings.join(part, ["portfolio_id", "symbol"], "left").select(
        "portfolio_id", "symbol", F.when(F.col("part").isNotNull(), F.col("position")).alias("shares_held"),
        F.coalesce("part_weight", F.lit(0.0)).alias("weight"),
        F.coalesce("part", F.lit(0.0)).alias("contribution"))


def sector_overlap(holdings: DataFrame, sectors: DataFrame, requests: DataFrame) -> DataFrame:
    """For each requested holding (portfolio_id, symbol) the other ones of its portfolio in the same sector."""
    placed = holdings.join(sectors.select("symbol", "sector"), "symbol")
    others = placed.select("portfolio_id", "sector", F.col("symbol").alias("other"),
                           F.col("weight").alias("other_weight"))
    asked = placed.join(requests.select("portfolio_id", "symbol").distinct(), ["portfolio_id", "symbol"], "left_semi")
    return asked.select("portfolio_id", "sector", "symbol").join(others, ["portfolio_id", "sector"]).where(
        F.col("symbol") != F.col("other"))


def concentration_alerts(holdings: DataFrame, sectors: DataFrame) -> DataFrame:
    """Positions above 20 % and sectors above 30 % with more than one holding, and the holdings involved (the row's own first)."""
    placed = holdings.join(sectors.select("symbol", "sector"), "symbol", "left").withColumn(
        "sector", F.coalesce("sector", F.lit("Unknown")))
    group = W.partitionBy("portfolio_id", "sector")
    rows = placed.withColumn("sector_weight", F.sum("weight").over(group)).withColumn(
        "sector_size", F.count(F.lit(1)).over(group)).withColumn("peers_", F.collect_set("symbol").over(group))  # one portfolio's holdings of one sector

    def percent(value: Column) -> Column:
        return F.concat(F.format_number(value * 100, 1), F.lit("%"))

    heavy = F.when(F.col("weight") > 0.20, F.struct(
        F.lit("position_size").alias("alert_type"),
        F.concat(F.col("symbol"), F.lit(" represents "), percent(F.col("weight")),
                 F.lit(" of your portfolio (>20%)")).alias("message"), F.col("weight").alias("combined_weight"),
        F.array("symbol").alias("holdings_involved")))
    crowded = F.when(
        (F.col("sector") != "Unknown") & (F.col("sector_weight") > 0.30) & (F.col("sector_size") > 1),
        F.struct(F.lit("sector_overlap").alias("alert_type"),
                 F.concat(F.col("sector"), F.lit(" sector represents "), percent(F.col("sector_weight")),
                          F.lit(" of portfolio")).alias("message"), F.col("sector_weight").alias("combined_weight"),
                 F.concat(F.array("symbol"), F.array_sort(F.array_remove("peers_", F.col("symbol")))).alias("holdings_involved")))
    return rows.select("portfolio_id", "symbol", F.inline(F.filter(F.array(heavy, crowded), lambda a: a.isNotNull())))


# ---- health score -------------------------------------------------------------------------
def fundamentals_score(overview: DataFrame) -> DataFrame:
    pe, margin = safe_double(F.col("pe_ratio")), safe_double(F.col("profit_margin"))
    points = (F.lit(12.5) + F.when((pe != 0) & pe.between(10, 25), 5.0).otherwise(0.0)
              + F.when(margin > 0.10, 5.0).otherwise(0.0))
    return overview.select("symbol", points.alias("fundamentals"))


def trend_score(prices: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Points by first-to-last change of the last N calendar days; 12.5 below two prices."""
    ends = prices.where(F.col("date") >= F.date_sub(as_of, days)).groupBy("symbol").agg(
        F.min_by("adj_close", "date").alias("first"), F.max_by("adj_close", "date").alias("last"),
        F.count(F.lit(1)).alias("n"))
    change = F.when(F.col("first") > 0, F.col("last") / F.col("first") - 1).otherwise(0.0)
    return ends.select("symbol", F.when(F.col("n") < 2, 12.5).when(change > 0.10, 20.0).when(change > 0, 15.0)
                       .when(change > -0.10, 10.0).otherwise(5.0).alias("price_trend"))


def sentiment_score(news: DataFrame, newest: int = 10) -> DataFrame:
    """12.5 plus 12.5 times the mean overall score of the newest articles."""
    order = W.partitionBy("symbol").orderBy(F.desc("published_at"), "article_id")
    return news.withColumn("place", F.row_number().over(order)).where(F.col("place") <= newest).groupBy("symbol").agg(
        (12.5 + 12.5 * F.avg("overall_sentiment_score")).alias("sentiment"))


def health_scores(context: DataFrame, overview: DataFrame, trend: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Four parts of at most 25 points per holding; missing parts count 12.5."""
    neutral = F.lit(12.5)
    impact = (neutral + F.when(F.col("contribution") > 0.05, 7.5).when(F.col("contribution") > 0, 3.5).otherwise(0.0)
              + F.when(F.col("weight").between(0.05, 0.15), 5.0).otherwise(0.0))
    rows = context.join(fundamentals_score(overview), "symbol", "left").join(trend, "symbol", "left").join(
        sentiment, "symbol", "left")
    parts = {c: F.coalesce(c, neutral) for c in ("fundamentals", "price_trend", "sentiment")}
    parts["portfolio_impact"] = F.least(F.greatest(impact, F.lit(0.0)), F.lit(25.0))
    scored = rows.select("portfolio_id", "symbol", *[v.alias(k) for k, v in parts.items()])
    return scored.withColumn("total", F.col("fundamentals") + F.col("price_trend") + F.col("sentiment")
                             + F.col("portfolio_impact"))


def profitability(overview: DataFrame) -> DataFrame:
    margin = safe_double(F.col("profit_margin"))
    return overview.select(
        "symbol", margin.alias("margin"),
        F.when(margin > 0.15, "improving").when(margin > 0.05, "stable").when(margin.isNotNull(), "declining")
        .alias("profitability"), F.lit("moderate").alias("leverage_risk"), F.lit("low").alias("dilution_risk"))


def company_header(overview: DataFrame, prices: DataFrame, spark_rows: DataFrame, context: DataFrame) -> DataFrame:
    """Latest quote with its change, overview, sparkline and portfolio context."""
    order = W.partitionBy("symbol").orderBy(F.desc("date"))
    recent = prices.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2).groupBy("symbol").agg(
        F.max(F.when(F.col("place") == 1, F.col("adj_close"))).alias("price"),
        F.max(F.when(F.col("place") == 2, F.col("adj_close"))).alias("previous_price"))
    held = context.select("symbol", "portfolio_id", "weight", "contribution")
    return overview.select("symbol", "name", "sector").join(recent, "symbol", "left").join(
        spark_rows, "symbol", "left").join(held, "symbol", "left").withColumn(
        "change_pct", (F.try_divide(F.col("price"), F.col("previous_price")) - 1) * 100)
