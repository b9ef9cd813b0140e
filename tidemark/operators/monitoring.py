"""Monitoring over request and API logs: period summaries, anomalies, trends.

Roles: requests(ts, total_articles, *_articles, premium_sources, analysis_quality,
response_time_seconds, ...) and calls(ts, api_source, success, response_time_ms, rate_limited).
Every summary is one aggregation with map-side partials; `as_of` replaces the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(days: int, as_of: Column) -> Column:
    return F.col("ts") > as_of - F.make_dt_interval(F.lit(days))


def period_summaries(requests: DataFrame, as_of: Column, periods: list[int]) -> DataFrame:
    """Counts and averages of several look-back periods in one pass."""
    longest = requests.where(within(max(periods), as_of))
    spread = longest.withColumn("period_days", F.explode(F.array(*[F.lit(d) for d in periods]))).where(
        F.col("ts") > as_of - F.make_dt_interval(F.col("period_days")))
    premium = F.try_divide(F.col("premium_sources").cast("double"), F.col("total_articles")) * 100
    return spread.groupBy("period_days").agg(
        F.count(F.lit(1)).alias("total_analyses"), F.round(F.avg("total_articles"), 1).alias("avg_articles"),
        F.round(F.avg("alphavantage_articles"), 1).alias("avg_alphavantage"),
        F.round(F.avg("nyt_articles"), 1).alias("avg_nyt"), F.round(F.avg("rss_articles"), 1).alias("avg_rss"),
        F.round(F.avg("response_time_seconds"), 2).alias("avg_response_time"),
        F.round(F.avg(premium), 1).alias("avg_premium_percentage"))


def quality_distribution(requests: DataFrame, as_of: Column, days: int) -> DataFrame:
    return requests.where(within(days, as_of)).groupBy("analysis_quality").agg(F.count(F.lit(1)).alias("requests"))


def source_performance_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_calls"), F.count_if(F.col("success")).alias("successful_calls"),
        (F.count_if(F.col("success")) / F.count(F.lit(1)) * 100).alias("success_rate"),
        F.avg("response_time_ms").alias("avg_response_time_ms"),
        F.count_if(F.col("rate_limited")).alias("rate_limited_calls"),
    ]


def source_performance(calls: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Calls, success rate, mean latency and rate limiting per source."""
    return calls.where(within(days, as_of)).groupBy("api_source").agg(*source_performance_columns())


# fixed values: severity, message (for format_string) and recommendation of each kind of alert
ALERTS = {
    "low_article_count": ("medium", "Recent average articles (%.1f) significantly below historical average (%.1f)", "Check API keys and source availability"),
    "slow_response": ("low", "Response times increased from %.2fs to %.2fs", "Monitor API response times and network connectivity"),
    "api_failures": ("high", "%s API success rate is %.1f%% (< 80%%)", "Check %s API key and service status"),
    "rate_limiting": ("medium", "%s has %d rate-limited calls", "Consider upgrading %s API plan or reducing request frequency"),
    "no_recent_activity": ("low", "No recent analysis requests detected", "Verify application is receiving requests"),
}


def _alert(kind: str, subject: Column, value: Column, *told: Column) -> Column:
    """An alert row; told are the values of its message."""
    severity, message, advice = ALERTS[kind]
    advice = F.format_string(advice, subject) if "%s" in advice else F.lit(advice)
    return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), subject.alias("subject"), value.alias("value"),
                    (F.format_string(message, *told) if told else F.lit(message)).alias("message"), advice.alias("recommendation"))


def source_alerts() -> Column:
    """Alerts of one source performance row."""
    source = F.col("api_source")
    failing = F.when(F.col("success_rate") < 80, _alert("api_failures", source, F.col("success_rate"), source, F.col("success_rate")))
    limited = F.when(F.col("rate_limited_calls") > 0, _alert(
        "rate_limiting", source, F.col("rate_limited_calls").cast("double"), source, F.col("rate_limited_calls")))
    return F.filter(F.array(failing, limited), lambda a: a.isNotNull())


def general_alerts() -> Column:
    """Alerts on all requests of a recent day against its 30-day baseline; a day without requests has NULL averages."""
    nothing = F.lit(None).cast("string")
    few = F.when((F.col("avg_articles_30") > 0) & (F.col("avg_articles_1") < F.col("avg_articles_30") * 0.7),
                 _alert("low_article_count", nothing, F.col("avg_articles_1"), F.col("avg_articles_1"), F.col("avg_articles_30")))
    slow = F.when((F.col("avg_response_time_30") > 0)
                  & (F.col("avg_response_time_1") > F.col("avg_response_time_30") * 1.5),
                  _alert("slow_response", nothing, F.col("avg_response_time_1"), F.col("avg_response_time_30"), F.col("avg_response_time_1")))
    idle = F.when(F.coalesce("total_analyses_1", F.lit(0)) == 0,
                  _alert("no_recent_activity", nothing, F.lit(0.0)))
    return F.filter(F.array(few, slow, idle), lambda a: a.isNotNull())


def anomalies(requests: DataFrame, calls: DataFrame, as_of: Column) -> DataFrame:
    """Recent day against 30 days: fewer articles, slower answers; failing or limited sources."""
    both = period_summaries(requests, as_of, [1, 30]).agg(*[
        F.max(F.when(F.col("period_days") == d, F.col(c))).alias(f"{c}_{d}")
        for c in ("avg_articles", "avg_response_time", "total_analyses") for d in (1, 30)])
    return both.select(F.inline(general_alerts())).unionByName(source_performance(calls, as_of, 1).select(F.inline(source_alerts())))


def recent_requests(requests: DataFrame, newest: int = 100) -> DataFrame:
    """Averages and feed totals over the newest N requests (a bounded top-N)."""
    last = requests.orderBy(F.desc("ts"), F.desc("event_id")).limit(newest)
    return last.agg(
        F.count(F.lit(1)).alias("recent_requests"), F.round(F.avg("total_articles"), 1).alias("avg_articles"),
        F.round(F.avg("response_time_seconds"), 2).alias("avg_response_time"),
        F.sum("alphavantage_articles").alias("alphavantage_total"), F.sum("nyt_articles").alias("nyt_total"),
        F.sum("rss_articles").alias("rss_total"), F.sum("google_articles").alias("google_total"))


def dashboard_trends(requests: DataFrame, calls: DataFrame, as_of: Column) -> DataFrame:
    """Week against month in percent, number of anomalies and health flag."""
    both = period_summaries(requests, as_of, [7, 30]).agg(*[
        F.max(F.when(F.col("period_days") == d, F.col(c))).alias(f"{c}_{d}")
        for c in ("avg_articles", "avg_premium_percentage") for d in (7, 30)])
    found = anomalies(requests, calls, as_of).agg(F.count(F.lit(1)).alias("n")).scalar()

    def trend(name: str) -> Column:
        return (F.try_divide(F.col(f"{name}_7"), F.col(f"{name}_30")) - 1) * 100

    return both.select(
        trend("avg_articles").alias("article_trend"), trend("avg_premium_percentage").alias("quality_trend"),
        found.alias("anomaly_count"), F.when(found == 0, "healthy").otherwise("issues_detected").alias("health_status"))


def request_statistics(requests: DataFrame) -> DataFrame:
    """Escalation rate, mean latency, relevance of the newest 50, distinct companies, status."""
    newest = requests.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).agg(
        F.avg("relevance_percentage")).scalar()
    rows = requests.agg(
        F.count(F.lit(1)).alias("total_requests"), F.countDistinct(F.lower("company")).alias("unique_companies"),
        F.round(F.avg("response_time_seconds"), 2).alias("avg_response_time"),
        F.round(F.avg(F.col("escalated").cast("double")) * 100, 1).alias("escalation_rate"))
    return rows.withColumn("avg_relevance", F.round(newest, 1)).withColumn(
        "performance_status", F.when((F.col("avg_response_time") < 30) & (F.col("avg_relevance") > 50), "healthy")
        .otherwise("needs_attention"))
