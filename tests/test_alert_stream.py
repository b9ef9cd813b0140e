"""The alert stream against the batch rules on every closed day, with silent days and days that arrive one by one."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import monitoring as M
from tidemark.streaming import streams as Z

SCHEMA = "event_id long, ts timestamp, total_articles int, alphavantage_articles int, nyt_articles int, rss_articles int, response_time_seconds double, premium_sources int"
GENERAL = {"low_article_count", "slow_response", "no_recent_activity"}


def requests():
    rows, n = [], 0
    for day in (1, 2, 3, 6, 7, 12, 13, 14):  # 4, 5 and 8 to 11 are silent
        for hour in range(1, 23, 3):
            articles = 4 if day == 7 else 20 + hour % 3
            seconds = 30.0 if day in (3, 13) else 10.0 + hour / 10
            rows.append((n, dt.datetime(2024, 3, day, hour, 30), articles, 1, 1, 1, seconds, 2))
            n += 1
    return rows


def written(spark, tmp_path, rows, files):
    """The rows as Parquet files of one or several days each, in the order of time."""
    folder = str(tmp_path / "requests")
    frame = spark.createDataFrame(rows, SCHEMA)
    for i, days in enumerate(files):
        frame.where(F.dayofmonth("ts").isin(days)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def batch_alerts(spark, rows, days):
    frame = spark.createDataFrame(rows, SCHEMA)
    calls = spark.createDataFrame([], "api_source string, ts timestamp, success boolean, response_time_ms double, rate_limited boolean")
    found = set()
    for day in days:
        end = dt.datetime(2024, 3, day + 1)
        seen = frame.where(F.col("ts") < F.lit(end))
        found |= {(day, r.type, round(r.value, 6), r.message) for r in M.anomalies(seen, calls, F.lit(end)).collect()}
    return found


@pytest.mark.parametrize("files", [[[1, 2, 3, 6, 7, 12, 13, 14]], [[1], [2, 3], [6], [7], [12], [13, 14]]])
def test_stream_equals_the_batch_rules_on_closed_days(spark, tmp_path, files):
    rows = requests()
    folder = written(spark, tmp_path, rows, files)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = Z.run_available(Z.general_alert_stream(Z.with_event_time(stream)), "alerts").collect()
    got = [(r.window_start.day, r.type, round(r.value, 6), r.message) for r in out]
    assert len(got) == len(set(got))
    assert set(got) == batch_alerts(spark, rows, range(1, 14))
    assert {g[0] for g in got if g[1] == "no_recent_activity"} == {4, 5, 8, 9, 10, 11}
    assert {g[1] for g in got} == GENERAL


def test_scopes_have_states_of_their_own(spark, tmp_path):
    rows = [(0, dt.datetime(2024, 3, 1, 5), 10, 1, 1, 1, 5.0, 1), (1, dt.datetime(2024, 3, 1, 6), 10, 1, 1, 1, 5.0, 1),
            (2, dt.datetime(2024, 3, 3, 5), 10, 1, 1, 1, 5.0, 1), (4, dt.datetime(2024, 3, 5, 5), 2, 1, 1, 1, 5.0, 1)]
    folder = written(spark, tmp_path, rows, [[1, 3, 5]])
    stream = Z.with_event_time(spark.readStream.schema(SCHEMA).parquet(folder))
    out = Z.run_available(Z.daily_baseline(stream, F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd"), days=2), "baseline")
    got = {(r.scope, r.window_start.day): (r.total_analyses_1, r.avg_articles_1, r.avg_articles_30) for r in out.collect()}
    assert got[("even", 2)] == (0, None, 10.0) and got[("even", 3)] == (1, 10.0, 10.0) and got[("odd", 1)] == (1, 10.0, 10.0)
    assert got[("odd", 2)] == (0, None, 10.0) and got[("odd", 3)] == (0, None, None)
    assert max(d for s, d in got if s == "odd") <= 4
