"""Registered streaming queries: drained once and compared with the batch form in SQL.

The last windows stay open under the watermark, so only closed windows are shown.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import bindings as B
from tidemark.plans.oracle_tables import sql
from tidemark.plans.portfolio_queries import _rounded
from tidemark.plans.registry import query
from tidemark.runtime import scratch_path
from tidemark.streaming import streams as Z

CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"
STAMP = "%Y-%m-%d %H:%M:%S"


def _events(spark, sf):
    return Z.with_event_time(Z.file_stream(spark, sf, "events.parquet"))


def _calls(spark, sf):
    return _events(spark, sf).select(*B.api_usage_columns())


def _requests(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    total = k % 9 + k % 5 + k % 7 + F.col("event_id") % 4
    return _events(spark, sf).select(
        "event_id", "ts", F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("company"), total.alias("total_articles"),
        (k % 9).alias("alphavantage_articles"), (F.col("value") / 10).alias("response_time_seconds"))


HEALTH = {"health": f"""SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, api_source, count(*) AS total_calls, count(*) FILTER (success) AS successful_calls,
    count(*) FILTER (success) / count(*) * 100 AS success_rate, avg(response_time_ms) AS avg_response_time_ms, count(*) FILTER (rate_limited) AS rate_limited_calls
  FROM (SELECT *, date_trunc('day', ts) AS w FROM api_usage) GROUP BY w, api_source HAVING w + INTERVAL 1 DAY <= {CLOSED}"""}


@query("z01_daily_source_health", sql("api_usage", f"""SELECT strftime(window_start, '{STAMP}') AS window_start, strftime(window_end, '{STAMP}') AS window_end, api_source, total_calls, successful_calls,
  round(success_rate, 6) AS success_rate, round(avg_response_time_ms, 6) AS avg_response_time_ms, rate_limited_calls FROM health""", HEALTH))
def daily_source_health(spark, sf):
    rows = Z.run_available(Z.daily_source_health(_calls(spark, sf)), "source-health")
    return _rounded(rows, {"success_rate": 6, "avg_response_time_ms": 6})


@query("z02_sliding_metrics", sql("metrics", f"""SELECT strftime(w, '{STAMP}') AS window_start, strftime(w + INTERVAL 1 HOUR, '{STAMP}') AS window_end, count(*) AS requests, round(avg(total_articles), 6) AS avg_articles,
  round(avg(response_time_seconds), 9) AS avg_response_time, CAST(sum(alphavantage_articles) AS BIGINT) AS alphavantage_total
  FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * n) AS w FROM metrics, (SELECT unnest([0, 1, 2, 3]) AS n)) GROUP BY w HAVING w + INTERVAL 1 HOUR <= {CLOSED}"""))
def sliding_metrics(spark, sf):
    rows = Z.run_available(Z.sliding_metrics(_requests(spark, sf)), "sliding")
    return _rounded(rows, {"avg_articles": 6, "avg_response_time": 9})


@query("z03_run_sessions", sql("metrics", f"""SELECT company, strftime(min(ts), '{STAMP}') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '{STAMP}') AS session_end, count(*) AS runs FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY company ORDER BY ts, event_id) AS s FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY company ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM metrics))
  GROUP BY company, s HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}"""))
def run_sessions(spark, sf):
    return Z.run_available(Z.run_sessions(_requests(spark, sf), "company"), "sessions")


@query("z04_distinct_links", "SELECT DISTINCT 'https://www.a.example/' || (event_id % 997) AS link FROM events")
def distinct_links(spark, sf):
    stream = _events(spark, sf).select("ts", F.concat(F.lit("https://www.a.example/"), (F.col("event_id") % 997).cast("string")).alias("link"))
    return Z.run_available(Z.distinct_links(stream), "links").select("link")


@query("z05_upserted_stream", """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL""")
def upserted_stream(spark, sf):
    path = scratch_path(spark, "stream-upsert")
    stream = Z.file_stream(spark, sf, "events.parquet").select("user_id", "event_type", "event_id", "value")
    Z.upsert_stream(stream, path, ["user_id", "event_type"], "event_id", "event_type")
    return spark.read.parquet(path).select("user_id", "event_type", "event_id", "value")


@query("z06_enriched_stream", """SELECT event_id, event_type, coalesce(c_mktsegment, '') AS segment FROM events LEFT JOIN customer ON user_id = c_custkey""")
def enriched_stream(spark, sf):
    dimension = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    stream = Z.file_stream(spark, sf, "events.parquet").select("event_id", "event_type", "user_id")
    rows = Z.run_available(Z.enriched(stream, dimension, "user_id"), "enriched")
    return rows.select("event_id", "event_type", F.coalesce("segment", F.lit("")).alias("segment"))


GENERAL = {
    "days": f"""SELECT date_trunc('day', ts) AS d, count(*) AS n, sum(total_articles) AS a, sum(response_time_seconds) AS s FROM metrics GROUP BY 1 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {CLOSED}""",
    "compared": """SELECT x.d, any_value(x.n) AS n, round(any_value(x.a / x.n), 1) AS a1, round(sum(y.a) / sum(y.n), 1) AS a30, round(any_value(x.s / x.n), 2) AS s1, round(sum(y.s) / sum(y.n), 2) AS s30
      FROM (SELECT d, n, a, s FROM days UNION ALL SELECT d, 0, NULL, NULL FROM (SELECT unnest(generate_series((SELECT min(d) FROM days), (SELECT max(d) FROM days), INTERVAL 1 DAY)) AS d) WHERE d NOT IN (SELECT d FROM days)) x
      JOIN days y ON y.d BETWEEN x.d - INTERVAL 29 DAY AND x.d GROUP BY x.d"""}


@query("z07_source_alerts", sql(["api_usage", "metrics"], f"""SELECT strftime(window_start, '{STAMP}') AS window_start, 'api_failures' AS type, 'high' AS severity, api_source AS subject, round(success_rate, 6) AS value,
  api_source || ' API success rate is ' || printf('%.1f', success_rate) || '% (< 80%)' AS message, 'Check ' || api_source || ' API key and service status' AS recommendation FROM health WHERE success_rate < 80
  UNION ALL SELECT strftime(window_start, '{STAMP}'), 'rate_limiting', 'medium', api_source, CAST(rate_limited_calls AS DOUBLE), api_source || ' has ' || rate_limited_calls || ' rate-limited calls', 'Consider upgrading ' || api_source || ' API plan or reducing request frequency' FROM health WHERE rate_limited_calls > 0
  UNION ALL SELECT strftime(d, '{STAMP}'), 'low_article_count', 'medium', '', a1, 'Recent average articles (' || printf('%.1f', a1) || ') significantly below historical average (' || printf('%.1f', a30) || ')', 'Check API keys and source availability' FROM compared WHERE a30 > 0 AND a1 < a30 * 0.7
  UNION ALL SELECT strftime(d, '{STAMP}'), 'slow_response', 'low', '', s1, 'Response times increased from ' || printf('%.2f', s30) || 's to ' || printf('%.2f', s1) || 's', 'Monitor API response times and network connectivity' FROM compared WHERE s30 > 0 AND s1 > s30 * 1.5
  UNION ALL SELECT strftime(d, '{STAMP}'), 'no_recent_activity', 'low', '', 0.0, 'No recent analysis requests detected', 'Verify application is receiving requests' FROM compared WHERE n = 0""", HEALTH | GENERAL))
def source_alerts(spark, sf):
    of_sources = Z.run_available(Z.source_alert_stream(Z.daily_source_health(_calls(spark, sf))), "alerts")
    general = Z.run_available(Z.general_alert_stream(_requests(spark, sf)), "general-alerts")
    rows = of_sources.unionByName(general).withColumn("subject", F.coalesce("subject", F.lit("")))
    return _rounded(rows, {"value": 6})
