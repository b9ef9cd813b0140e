"""Daily portfolio metrics: calendar, version in force, NAV, return, drawdown, volatility.

Roles: prices(symbol, date, adj_close), portfolios(portfolio_id, allocation_type),
versions(portfolio_id, version_id, version_number, effective_at), positions(version_id, symbol, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.finance import trailing
from tidemark.functions.vocab import TRADING_DAYS
from tidemark.runtime import cut_lineage


def prices_between(prices: DataFrame, start: Column, end: Column) -> DataFrame:
    """Adjusted closes in an inclusive date range."""
    return prices.where(F.col("date").between(start, end)).select("symbol", "date", "adj_close")


def portfolio_symbols(versions: DataFrame, positions: DataFrame) -> DataFrame:
    """Every symbol a portfolio held in any version."""
    return positions.join(versions.select("version_id", "portfolio_id"), "version_id").select(
        "portfolio_id", "symbol").distinct()


def _held_prices(window_prices: DataFrame, versions: DataFrame, positions: DataFrame) -> DataFrame:
    return window_prices.select("symbol", "date").join(portfolio_symbols(versions, positions), "symbol")


def trading_calendar(window_prices: DataFrame, versions: DataFrame, positions: DataFrame) -> DataFrame:
    """portfolio_id, date, previous_date: the union of the dates of all its symbols."""
    return _calendar_of(_held_prices(window_prices, versions, positions))


def _calendar_of(held: DataFrame) -> DataFrame:
    order = W.partitionBy("portfolio_id").orderBy("date")
    return held.select("portfolio_id", "date").distinct().withColumn(
        "previous_date", F.lag("date").over(order))


def _carry_forward(days: DataFrame, marks: DataFrame, moment: str) -> DataFrame:
    """As-of join without a range join: versions and days in one time order per portfolio.

    The last version seen so far is carried onto each day, so the cost is one sort however many
    versions a portfolio has. Days before the first version drop out.
    """
    stream = days.withColumn("is_day", F.lit(1)).unionByName(
        marks.withColumn("is_day", F.lit(0)), allowMissingColumns=True)
    so_far = W.partitionBy("portfolio_id").orderBy(moment, "is_day").rowsBetween(W.unboundedPreceding, 0)
    return stream.withColumn("version_id", F.last("version_id", ignorenulls=True).over(so_far)).where(
        (F.col("is_day") == 1) & F.col("version_id").isNotNull()).drop("is_day")


def version_on_day(days: DataFrame, versions: DataFrame) -> DataFrame:
    """The version in force on each (portfolio_id, date): effective on that day or before.

    Several versions effective on one day: the one with the highest number counts.
    """
    marks = versions.groupBy("portfolio_id", F.to_date("effective_at").alias("date")).agg(
        F.max_by("version_id", "version_number").alias("version_id"))
    return _carry_forward(days, marks, "date")


def version_at_midnight(days: DataFrame, versions: DataFrame) -> DataFrame:
    """The stricter form: a version counts once its timestamp is at or before the day's start."""
    marks = versions.groupBy("portfolio_id", F.col("effective_at").alias("moment")).agg(
        F.max_by("version_id", "version_number").alias("version_id"))
    return _carry_forward(
        days.withColumn("moment", F.col("date").cast("timestamp_ntz")), marks, "moment").drop("moment")


def daily_nav(window_prices: DataFrame, portfolios: DataFrame, versions: DataFrame,
              positions: DataFrame) -> DataFrame:
    """portfolio_id, date, nav for all portfolios at once.

    Weight mode chains 100 * product(1 + sum(w * r)); a symbol without a price on both the day
    and the portfolio's previous trading day adds nothing. Quantity mode sums q * price.
    The chain starts at 100 on the first calendar day, if a version is in force there.
    """
    # the move of a symbol is the same in every portfolio: one small table by (symbol, date)
    by_symbol = W.partitionBy("symbol").orderBy("date")
    moved = window_prices.select("symbol", "date", "adj_close", F.lag("date").over(by_symbol).alias("quoted_before"),
                                 F.lag("adj_close").over(by_symbol).alias("price_before"))
    versions = versions.join(portfolios.select("portfolio_id"), "portfolio_id", "left_semi")
    days = version_on_day(trading_calendar(window_prices, versions, positions), versions)
    in_force = days.join(positions, "version_id")
    joined = in_force.join(moved, ["symbol", "date"], "left")
    has_both = (F.col("quoted_before") == F.col("previous_date")) & (F.col("price_before") != 0)
    move = F.when(has_both, F.col("adj_close") / F.col("price_before") - 1).otherwise(0.0)
    per_day = joined.groupBy("portfolio_id", "date", "previous_date").agg(
        F.sum(F.col("value") * F.coalesce(move, F.lit(0.0))).alias("day_return"),
        F.sum(F.coalesce(F.col("value") * F.col("adj_close"), F.lit(0.0))).alias("market_value"))
    kinds = portfolios.select("portfolio_id", "allocation_type")
    order = W.partitionBy("portfolio_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    factor = F.when(F.col("previous_date").isNull(), 1.0).otherwise(1 + F.col("day_return"))
    return per_day.join(kinds, "portfolio_id").withColumn(
        "nav", F.when(F.col("allocation_type") == "weight", 100 * F.product(factor).over(order))
        .otherwise(F.col("market_value"))
    ).select("portfolio_id", "allocation_type", "date", "nav")


def daily_metrics(nav: DataFrame) -> DataFrame:
    """Adds 1-day return, drawdown from the running peak and 30-day annualised volatility.

    In weight mode the peak starts at 100; in quantity mode at the first value.
    """
    order = W.partitionBy("portfolio_id").orderBy("date")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    floor = F.when(F.col("allocation_type") == "weight", F.lit(100.0)).otherwise(F.lit(0.0))
    before = F.lag("nav").over(order)
    rows = nav.withColumn("return_1d", F.try_divide(F.col("nav"), before) - 1).withColumn(
        "peak", F.greatest(F.max("nav").over(so_far), floor))
    rows = rows.withColumn("drawdown", F.coalesce(
        F.try_divide(F.col("peak") - F.col("nav"), F.col("peak")), F.lit(0.0)))
    last_30 = trailing(order, 30)
    volatility = F.stddev_samp("return_1d").over(last_30) * F.sqrt(F.lit(TRADING_DAYS))
    return rows.withColumn("max_drawdown", F.max("drawdown").over(so_far)).withColumn(
        "volatility_30d", F.when(F.count("return_1d").over(last_30) >= 30, volatility)
    ).select("portfolio_id", "allocation_type", "date", "nav", "return_1d", "drawdown", "max_drawdown",
             "volatility_30d")


def performance_series(metrics: DataFrame) -> DataFrame:
    """Dates, NAVs and returns of a portfolio as arrays in date order."""
    ordered = F.array_sort(F.collect_list(F.struct("date", "nav", "return_1d")))
    return metrics.groupBy("portfolio_id").agg(ordered.alias("points")).select(
        "portfolio_id", F.transform("points", lambda p: p["date"]).alias("dates"),
        F.transform("points", lambda p: p["nav"]).alias("nav_values"),
        F.transform("points", lambda p: p["return_1d"]).alias("returns"))


def latest_metrics(metrics: DataFrame, as_of: Column) -> DataFrame:
    """Newest metrics per portfolio with month- and year-to-date return."""
    month = F.col("date") >= F.trunc(as_of, "MM")
    year = F.col("date") >= F.trunc(as_of, "year")

    def first_in(flag: Column) -> Column:
        return F.min_by("nav", F.when(flag, F.col("date")))

    last = metrics.groupBy("portfolio_id").agg(
        F.max("date").alias("date"),
        *[F.max_by(c, "date").alias(c) for c in ("nav", "return_1d", "volatility_30d", "drawdown")],
        first_in(month).alias("month_first"), first_in(year).alias("year_first"))
    return last.select(
        "portfolio_id", "date", "nav", "return_1d",
        (F.try_divide(F.col("nav"), F.col("month_first")) - 1).alias("return_mtd"),
        (F.try_divide(F.col("nav"), F.col("year_first")) - 1).alias("return_ytd"),
        "volatility_30d", "drawdown")


def compare_portfolios(metrics: DataFrame, chosen: DataFrame) -> DataFrame:
    """First and last NAV of the chosen portfolios with the overall range; unknown ids vanish."""
    rows = metrics.join(chosen, "portfolio_id", "left_semi").groupBy("portfolio_id").agg(
        F.min("date").alias("start"), F.max("date").alias("end"),
        F.min_by("nav", "date").alias("first_nav"), F.max_by("nav", "date").alias("last_nav"))
    rows = cut_lineage(rows)  # one row per portfolio, read three times
    return rows.select("*", rows.agg(F.min("start")).scalar().alias("overall_start"),
                       rows.agg(F.max("end")).scalar().alias("overall_end"))


def relative_performance(metrics: DataFrame, latest: DataFrame, benchmark: int, risk_free: float) -> DataFrame:
    """Total and benchmark return in percent, alpha in points, Sharpe ratio from YTD and volatility."""
    totals = metrics.groupBy("portfolio_id").agg(
        ((F.try_divide(F.max_by("nav", "date"), F.min_by("nav", "date")) - 1) * 100).alias("total_return"))
    reference = totals.where(F.col("portfolio_id") == benchmark).agg(F.max("total_return")).scalar()
    return totals.join(latest.select("portfolio_id", "return_ytd", "volatility_30d"), "portfolio_id").select(
        "portfolio_id", "total_return", reference.alias("benchmark_return"),
        (F.col("total_return") - reference).alias("alpha"),
        F.try_divide(F.col("return_ytd") - risk_free / 100, F.col("volatility_30d")).alias("sharpe"))
