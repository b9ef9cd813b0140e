"""Technical indicators over daily bars, for every symbol and day.

Role: bars(symbol, date, high, low, close). One exchange on symbol feeds every indicator; a
symbol's history is one row per trading day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.finance import seeded_ema, trailing, when_full


def _order() -> WindowSpec:
    return W.partitionBy("symbol").orderBy("date")


def _close() -> Column:
    return F.col("close")


def sma(rows: int) -> Column:
    """Simple moving average, 2 digits, NULL while short."""
    return F.round(when_full(F.avg(_close()).over(trailing(_order(), rows)), _order(), rows), 2)


def ema(rows: int) -> Column:
    return seeded_ema(_close(), _order(), rows)


def with_rsi(bars: DataFrame, rows: int = 14) -> DataFrame:
    """RSI from simple averages of the last `rows` changes; 100 without any loss."""
    moved = bars.withColumn("move", _close() - F.lag("close").over(_order()))
    gain = F.avg(F.greatest("move", F.lit(0.0))).over(trailing(_order(), rows))
    loss = F.avg(F.greatest(-F.col("move"), F.lit(0.0))).over(trailing(_order(), rows))
    rated = moved.withColumn("gain", gain).withColumn("loss", loss)
    rsi = F.when(F.col("loss") == 0, 100.0).otherwise(
        F.round(100 - 100 / (1 + F.col("gain") / F.nullif("loss", F.lit(0.0))), 2))
    return rated.withColumn("rsi", when_full(rsi, _order(), rows + 1)).drop("move", "gain", "loss")


def with_macd(bars: DataFrame) -> DataFrame:
    """MACD line (26 bars needed), signal at 95 % of it, histogram; 4 digits."""
    line = bars.withColumn("line", when_full(ema(12) - ema(26), _order(), 26))
    return line.withColumn("macd", F.round("line", 4) + F.lit(0.0)).withColumn(
        "macd_signal", F.round(F.col("line") * 0.95, 4) + F.lit(0.0)).withColumn(
        "macd_histogram", F.round(F.col("line") - F.col("line") * 0.95, 4) + F.lit(0.0)).drop("line")


def with_bollinger(bars: DataFrame, rows: int = 20) -> DataFrame:
    """Middle, upper and lower band at two population deviations, bandwidth in percent."""
    span = trailing(_order(), rows)
    based = bars.withColumn("mean", when_full(F.avg(_close()).over(span), _order(), rows)).withColumn(
        "dev", F.stddev_pop(_close()).over(span))
    up, low = F.col("mean") + 2 * F.col("dev"), F.col("mean") - 2 * F.col("dev")
    return based.withColumn("bb_middle", F.round("mean", 2)).withColumn("bb_upper", F.round(up, 2)).withColumn(
        "bb_lower", F.round(low, 2)).withColumn(
        "bb_width", F.round(F.try_divide(up - low, F.col("mean")) * 100, 2)).drop("mean", "dev")


NEWEST = 200


def bundle(bars: DataFrame) -> DataFrame:
    """All indicators on the newest bar of every symbol with at least 50 bars.

    The two moving averages are shown only together. No indicator looks back further than NEWEST bars, so only those of
    each symbol are kept (a limit that Spark applies before the exchange).
    """
    place = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))
    bars = bars.withColumn("place_", place).where(F.col("place_") <= NEWEST).drop("place_")
    full = with_bollinger(with_macd(with_rsi(bars))).withColumn("sma_50", sma(50)).withColumn(
        "sma_200", sma(200)).withColumn("bars", F.count(F.lit(1)).over(
            W.partitionBy("symbol").orderBy("date").rowsBetween(W.unboundedPreceding, 0)))
    newest = full.withColumn("next_date", F.lead("date").over(_order())).where(F.col("next_date").isNull())
    both = F.col("sma_50").isNotNull() & F.col("sma_200").isNotNull()
    return newest.where(F.col("bars") >= 50).select(
        "symbol", "date", "close", "rsi", "macd", "macd_signal", "macd_histogram", "bb_middle", "bb_upper",
        "bb_lower", "bb_width", "sma_50", "sma_200", F.when(both, F.col("sma_50")).alias("shown_sma_50"),
        F.when(both, F.col("sma_200")).alias("shown_sma_200"))


# sentences of the signal text (fixed values)
BOTH_ABOVE = ("Price is trading above both 50-day and 200-day moving averages, indicating strong "
              "bullish momentum.")
BOTH_BELOW = "Price is trading below both key moving averages, suggesting bearish pressure."
MIXED = "Price shows mixed signals relative to moving averages."
MACD_UP = "MACD line above signal line suggests bullish momentum."
MACD_DOWN = "MACD line below signal line suggests bearish momentum."


def signals(indicators: DataFrame) -> DataFrame:
    """Classes and sentence text from the indicator bundle."""
    def side(average: str) -> Column:
        return (F.when(F.col(average).isNull(), "unknown").when(F.col("close") > F.col(average), "above")
                .otherwise("below"))

    rows = indicators.withColumn("trend_50", side("sma_50")).withColumn("trend_200", side("sma_200"))
    rsi = F.col("rsi")
    rsi_text = F.concat(F.lit("RSI at "), F.format_number(rsi, 1), F.when(rsi > 70, " indicates overbought conditions.")
                        .when(rsi < 30, " indicates oversold conditions.").otherwise(" shows balanced momentum."))
    trend_text = (F.when((F.col("trend_50") == "above") & (F.col("trend_200") == "above"), BOTH_ABOVE)
                  .when((F.col("trend_50") == "below") & (F.col("trend_200") == "below"), BOTH_BELOW).otherwise(MIXED))
    macd_text = F.when(F.col("macd") > F.col("macd_signal"), MACD_UP).when(F.col("macd").isNotNull(), MACD_DOWN)
    return rows.select(
        "symbol", "trend_50", "trend_200",
        F.when(rsi > 70, "overbought").when(rsi < 30, "oversold").otherwise("neutral").alias("rsi_state"),
        F.when(F.col("macd") > F.col("macd_signal"), "bullish").when(F.col("macd").isNotNull(), "bearish")
        .otherwise("neutral").alias("macd_state"),
        F.concat_ws(" ", trend_text, rsi_text, macd_text).alias("interpretation"))


def chart_windows(bars: DataFrame, sizes: list[int]) -> DataFrame:
    """Last n bars per symbol for every chart size, with the high and low of the whole history."""
    place = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))
    ranged = bars.groupBy("symbol").agg(F.max("high").alias("range_high"), F.min("low").alias("range_low"))
    shown = bars.withColumn("place", place).where(F.col("place") <= max(sizes)).withColumn(
        "bars", F.explode(F.array(*[F.lit(n) for n in sizes]))).where(F.col("place") <= F.col("bars"))
    cut = shown.groupBy("symbol", "bars").agg(
        F.count(F.lit(1)).alias("bar_count"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.sum("close").alias("close_sum"))
    return cut.join(ranged, "symbol")


def sparkline(prices: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Closes of the last N calendar days as an array in date order."""
    recent = prices.where(F.col("date") >= F.date_sub(as_of, days))
    ordered = F.array_sort(F.collect_list(F.struct("date", "adj_close")))
    return recent.groupBy("symbol").agg(ordered.alias("points")).select(
        "symbol", F.transform("points", lambda p: p["adj_close"]).alias("closes"))
