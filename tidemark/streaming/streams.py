"""Structured Streaming forms of the log, article and upsert operators.

Every function takes a streaming DataFrame; state is bounded by watermarks. `run_available`
drains what is there and stops, which is how the queries compare a stream with its batch twin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.monitoring import general_alerts, source_alerts, source_performance_columns
from tidemark.runtime import scratch_path, with_imports
from tidemark.sources.tables import upsert
from tidemark.streaming.baseline import OUTPUT, DailyBaseline


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Stream over the Parquet files of a name in a folder; the schema comes from the files."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def with_event_time(stream: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Watermarks need a zoned timestamp; the parquet column has none and counts as session time."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Writes all available data to a Parquet table in the shared folder and returns that table."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    handle = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
              .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start())
    handle.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, name: str, write: Callable[[DataFrame, int], None]) -> None:
    """Runs a writer on every micro-batch until all available data is done."""
    checkpoint = scratch_path(stream.sparkSession, f"{name}-checkpoint")
    handle = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
              .trigger(availableNow=True).start())
    handle.awaitTermination()


def daily_source_health(calls: DataFrame) -> DataFrame:
    """Tumbling one-day performance per source; late calls are dropped."""
    return calls.groupBy(F.window("ts", "1 day").alias("span"), "api_source").agg(*source_performance_columns()).select(
        F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "api_source", "total_calls",
        "successful_calls", "success_rate", "avg_response_time_ms", "rate_limited_calls")


def sliding_metrics(requests: DataFrame) -> DataFrame:
    """Hourly averages every 15 minutes."""
    return requests.groupBy(F.window("ts", "1 hour", "15 minutes").alias("span")).agg(
        F.count(F.lit(1)).alias("requests"), F.avg("total_articles").alias("avg_articles"),
        F.avg("response_time_seconds").alias("avg_response_time"),
        F.sum("alphavantage_articles").alias("alphavantage_total")).select(
        F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "requests", "avg_articles",
        "avg_response_time", "alphavantage_total")


def run_sessions(requests: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of analysis runs per key, closed by a pause."""
    return requests.groupBy(F.session_window("ts", gap).alias("span"), key).agg(F.count(F.lit(1)).alias("runs")).select(
        key, F.col("span.start").alias("session_start"), F.col("span.end").alias("session_end"), "runs")


def distinct_links(articles: DataFrame) -> DataFrame:
    """First article of each link within the watermark."""
    return articles.dropDuplicatesWithinWatermark(["link"])


def upsert_stream(stream: DataFrame, path: str, keys: list[str], version: str, partition: str) -> None:
    """Incremental keyed upsert of every micro-batch, each one once: batches are named by the query (which its checkpoint keeps) and their number."""
    def write(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "query"
        upsert(batch, path, keys, version, partition, f"{query}-{number}")

    run_batches(stream, "upsert", write)


def enriched(stream: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Stream joined to a static dimension; rows without a match stay."""
    return stream.join(dimension, key, "left")


def source_alert_stream(health: DataFrame) -> DataFrame:
    """Alerts of each closed window of the source health stream."""
    return health.select("window_start", F.inline(source_alerts()))


def daily_baseline(requests: DataFrame, scope: Column, days: int = 30) -> DataFrame:
    """Averages of each closed day of a scope and of the days up to it; silent days have none.

    Requests are summed by day first; only those sums reach the state, which needs a store with timers (RocksDB).
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    daily = requests.groupBy(F.window("ts", "1 day").alias("span"), scope.alias("scope")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_articles").cast("double").alias("articles"), F.sum("response_time_seconds").cast("double").alias("seconds"))
    rows = with_imports(daily.select("scope", F.col("span.start").alias("window_start"), "n", "articles", "seconds", "span"))
    kept = rows.groupBy("scope").transformWithStateInPandas(DailyBaseline(days), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")

    def average(name: str, n: str, digits: int) -> Column:
        return F.round(F.try_divide(F.col(name), F.col(n)), digits)

    return kept.select(
        "scope", "window_start", F.col("n").alias("total_analyses_1"), average("articles", "n", 1).alias("avg_articles_1"), average("articles_base", "n_base", 1).alias("avg_articles_30"),
        average("seconds", "n", 2).alias("avg_response_time_1"), average("seconds_base", "n_base", 2).alias("avg_response_time_30"))


def general_alert_stream(requests: DataFrame, scope: Column | None = None, days: int = 30) -> DataFrame:
    """Alerts of each closed day against its baseline, and of each day without requests: the three rules on all requests (of a scope)."""
    return daily_baseline(requests, F.lit("all") if scope is None else scope, days).select("window_start", F.inline(general_alerts()))
