"""Registered queries over request and API logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import monitoring as M
from tidemark.plans import bindings as B
from tidemark.plans.oracle_tables import sql
from tidemark.plans.portfolio_queries import _rounded
from tidemark.plans.registry import query

SUMMARY = {"summaries": """SELECT d AS period_days, count(*) AS total_analyses, round(avg(total_articles), 1) AS avg_articles, round(avg(alphavantage_articles), 1) AS avg_alphavantage,
    round(avg(nyt_articles), 1) AS avg_nyt, round(avg(rss_articles), 1) AS avg_rss, round(avg(response_time_seconds), 2) AS avg_response_time,
    round(avg(premium_sources / nullif(total_articles, 0) * 100), 1) AS avg_premium_percentage
  FROM metrics, (SELECT unnest([1, 7, 30]) AS d) WHERE ts > (SELECT max(ts) FROM metrics) - to_days(d) GROUP BY d"""}
SOURCES = {"sources": """SELECT api_source, count(*) AS total_calls, count(*) FILTER (success) AS successful_calls, count(*) FILTER (success) / count(*) * 100 AS success_rate,
    avg(response_time_ms) AS avg_response_time_ms, count(*) FILTER (rate_limited) AS rate_limited_calls, d FROM api_usage, (SELECT unnest([1, 30]) AS d)
    WHERE ts > (SELECT max(ts) FROM api_usage) - to_days(d) GROUP BY api_source, d"""}
ANOMALIES = SUMMARY | SOURCES | {"anomalies": """SELECT 'low_article_count' AS type, 'medium' AS severity, CAST(NULL AS VARCHAR) AS subject, a.avg_articles AS value,
      'Recent average articles (' || printf('%.1f', a.avg_articles) || ') significantly below historical average (' || printf('%.1f', b.avg_articles) || ')' AS message, 'Check API keys and source availability' AS recommendation FROM summaries a, summaries b
      WHERE a.period_days = 1 AND b.period_days = 30 AND b.avg_articles > 0 AND a.avg_articles < b.avg_articles * 0.7
    UNION ALL SELECT 'slow_response', 'low', NULL, a.avg_response_time, 'Response times increased from ' || printf('%.2f', b.avg_response_time) || 's to ' || printf('%.2f', a.avg_response_time) || 's', 'Monitor API response times and network connectivity' FROM summaries a, summaries b WHERE a.period_days = 1 AND b.period_days = 30 AND b.avg_response_time > 0 AND a.avg_response_time > b.avg_response_time * 1.5
    UNION ALL SELECT 'no_recent_activity', 'low', NULL, 0.0, 'No recent analysis requests detected', 'Verify application is receiving requests' WHERE NOT EXISTS (SELECT 1 FROM summaries WHERE period_days = 1)
    UNION ALL SELECT 'api_failures', 'high', api_source, success_rate, api_source || ' API success rate is ' || printf('%.1f', success_rate) || '% (< 80%)', 'Check ' || api_source || ' API key and service status' FROM sources WHERE d = 1 AND success_rate < 80
    UNION ALL SELECT 'rate_limiting', 'medium', api_source, CAST(rate_limited_calls AS DOUBLE), api_source || ' has ' || rate_limited_calls || ' rate-limited calls', 'Consider upgrading ' || api_source || ' API plan or reducing request frequency' FROM sources WHERE d = 1 AND rate_limited_calls > 0"""}


def _requests(spark, sf):
    rows = B.analysis_metrics(spark, sf)
    return rows, rows.agg(F.max("ts")).scalar()


def _calls(spark, sf):
    return B.api_usage(spark, sf)


@query("q01_period_summaries", sql("metrics", "SELECT * FROM summaries", SUMMARY))
def period_summaries(spark, sf):
    rows, as_of = _requests(spark, sf)
    return M.period_summaries(rows, as_of, [1, 7, 30])


@query("q02_quality_distribution", sql("metrics", "SELECT analysis_quality, count(*) AS requests FROM metrics WHERE ts > (SELECT max(ts) FROM metrics) - to_days(30) GROUP BY 1"))
def quality_distribution(spark, sf):
    rows, as_of = _requests(spark, sf)
    return M.quality_distribution(rows, as_of, 30)


@query("q03_source_performance", sql("api_usage", "SELECT api_source, total_calls, successful_calls, round(success_rate, 6) AS success_rate, round(avg_response_time_ms, 6) AS avg_response_time_ms, rate_limited_calls FROM sources WHERE d = 30", SOURCES))
def source_performance(spark, sf):
    rows = _calls(spark, sf)
    out = M.source_performance(rows, rows.agg(F.max("ts")).scalar(), 30)
    return _rounded(out, {"success_rate": 6, "avg_response_time_ms": 6})


@query("q04_anomalies", sql(["metrics", "api_usage"], "SELECT type, severity, coalesce(subject, '') AS subject, round(value, 6) AS value, message, recommendation FROM anomalies", ANOMALIES))
def anomalies(spark, sf):
    rows, as_of = _requests(spark, sf)
    out = M.anomalies(rows, _calls(spark, sf), as_of)
    return _rounded(out.withColumn("subject", F.coalesce("subject", F.lit(""))), {"value": 6})


@query("q05_recent_requests", sql("metrics", """SELECT count(*) AS recent_requests, round(avg(total_articles), 1) AS avg_articles, round(avg(response_time_seconds), 2) AS avg_response_time,
  CAST(sum(alphavantage_articles) AS BIGINT) AS alphavantage_total, CAST(sum(nyt_articles) AS BIGINT) AS nyt_total, CAST(sum(rss_articles) AS BIGINT) AS rss_total, CAST(sum(google_articles) AS BIGINT) AS google_total
  FROM (SELECT * FROM metrics ORDER BY ts DESC, event_id DESC LIMIT 100)"""))
def recent_requests(spark, sf):
    return M.recent_requests(_requests(spark, sf)[0], 100)


@query("q06_dashboard_trends", sql(["metrics", "api_usage"], """SELECT round((a.avg_articles / b.avg_articles - 1) * 100, 4) + 0.0 AS article_trend, round((a.avg_premium_percentage / b.avg_premium_percentage - 1) * 100, 4) + 0.0 AS quality_trend,
  (SELECT count(*) FROM anomalies) AS anomaly_count, CASE WHEN (SELECT count(*) FROM anomalies) = 0 THEN 'healthy' ELSE 'issues_detected' END AS health_status
  FROM summaries a, summaries b WHERE a.period_days = 7 AND b.period_days = 30""", ANOMALIES))
def dashboard_trends(spark, sf):
    rows, as_of = _requests(spark, sf)
    return _rounded(M.dashboard_trends(rows, _calls(spark, sf), as_of), {"article_trend": 4, "quality_trend": 4})


@query("q07_request_statistics", sql("metrics", """SELECT *, CASE WHEN avg_response_time < 30 AND avg_relevance > 50 THEN 'healthy' ELSE 'needs_attention' END AS performance_status FROM (
  SELECT count(*) AS total_requests, count(DISTINCT lower(company)) AS unique_companies, round(avg(response_time_seconds), 2) AS avg_response_time,
    round(avg(CAST(escalated AS INTEGER)) * 100, 1) AS escalation_rate,
    round((SELECT avg(relevance_percentage) FROM (SELECT * FROM metrics ORDER BY ts DESC, event_id DESC LIMIT 50)), 1) AS avg_relevance FROM metrics)"""))
def request_statistics(spark, sf):
    return M.request_statistics(_requests(spark, sf)[0])
