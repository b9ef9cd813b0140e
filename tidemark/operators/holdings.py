"""Holdings: contribution and attribution, valuation, scenarios, lists and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.operators.containment import containing
from tidemark.operators.nav import prices_between, version_at_midnight


def attribution_periods(as_of: Column) -> Column:
    """The four report periods ending at a date, as an array of (period, start, end)."""
    def span(name: str, start: Column) -> Column:
        return F.struct(F.lit(name).alias("period"), start.alias("start"), as_of.alias("end"))

    return F.array(span("30d", F.date_sub(as_of, 30)), span("90d", F.date_sub(as_of, 90)),
                   span("ytd", F.trunc(as_of, "year")), span("1y", F.date_sub(as_of, 365)))


def contributions(prices: DataFrame, portfolios: DataFrame, versions: DataFrame, positions: DataFrame,
                  as_of: Column) -> DataFrame:
    """Weight, return and contribution of each holding over the four periods ending at a date.

    The version in force at the end counts. Weights are the stored ones, or shares of market
    value at the last price.
    """
    periods = attribution_periods(as_of)
    ends = portfolios.select("portfolio_id", "allocation_type", F.inline(periods))
    current = version_at_midnight(ends.withColumn("date", F.col("end")), versions).drop("date")
    window = prices_between(prices, F.date_sub(as_of, 365), as_of)
    inside = window.select("symbol", "date", "adj_close", F.inline(periods)).where(F.col("date") >= F.col("start"))
    moves = inside.groupBy("period", "symbol").agg(
        F.min_by("adj_close", "date").alias("first_price"), F.max_by("adj_close", "date").alias("last_price"),
        F.count(F.lit(1)).alias("quotes"))
    held = current.join(positions, "version_id").join(moves, ["period", "symbol"])
    market = F.col("value") * F.col("last_price")
    total = F.sum(market).over(W.partitionBy("portfolio_id", "period"))
    weight = F.when(F.col("allocation_type") == "weight", F.col("value")).otherwise(
        F.coalesce(F.try_divide(market, total), F.lit(0.0)))
    change = F.coalesce(F.try_divide(F.col("last_price"), F.col("first_price")) - 1, F.lit(0.0))
    return held.withColumn("weight", weight).where(F.col("quotes") >= 2).select(
        "portfolio_id", "period", "symbol", F.col("value").alias("position"), "weight",
        change.alias("return_pct"), (F.col("weight") * change).alias("contribution"))


def attribution(holding_contributions: DataFrame) -> DataFrame:
    """Holdings ordered by contribution with the period's total."""
    group = W.partitionBy("portfolio_id", "period")
    return holding_contributions.withColumn("total_return", F.sum("contribution").over(group)).withColumn(
        "place", F.row_number().over(group.orderBy(F.desc("contribution"), "symbol")))


def key_drivers(report: DataFrame) -> DataFrame:
    """Top contributor, its share of the total, top two of each sign, sign totals, text class."""
    c = F.col("contribution")
    from_below = F.row_number().over(W.partitionBy("portfolio_id", "period").orderBy(c, F.desc("symbol")))

    def named(place: str, n: int, sign: Column) -> Column:
        return F.max(F.when((F.col(place) == n) & sign, F.col("symbol")))

    rows = report.withColumn("below_", from_below).groupBy("portfolio_id", "period").agg(
        F.max_by("symbol", F.struct(c, F.col("place") * -1)).alias("top_symbol"), F.max(c).alias("top_contribution"),
        F.max("total_return").alias("total_return"),
        F.coalesce(F.sum(F.when(c > 0, c)), F.lit(0.0)).alias("positive_total"),
        F.coalesce(F.sum(F.when(c < 0, c)), F.lit(0.0)).alias("negative_total"),
        F.concat_ws(" and ", named("place", 1, c > 0), named("place", 2, c > 0)).alias("top_positive"),
        F.concat_ws(" and ", named("below_", 1, c < 0), named("below_", 2, c < 0)).alias("top_negative"))
    share = F.try_divide(F.col("top_contribution"), F.col("total_return")) * 100
    return rows.withColumn("share_pct", share).withColumn(
        "driver_class",
        F.when(F.col("share_pct") > 100, "single driver, others detracted")
        .when(F.col("top_contribution") < 0, "all positions negative").otherwise("primary driver"))


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("portfolio_id").agg(
        F.max_by("version_id", "version_number").alias("version_id"),
        F.max("version_number").alias("version_number"))


def next_version(portfolios: DataFrame, versions: DataFrame) -> DataFrame:
    """Latest version number and the number the next snapshot would get."""
    last = versions.groupBy("portfolio_id").agg(F.max("version_number").alias("latest_number"))
    return portfolios.select("portfolio_id").join(last, "portfolio_id", "left").withColumn(
        "next_number", F.coalesce("latest_number", F.lit(0)) + 1)


def latest_prices(prices: DataFrame) -> DataFrame:
    return prices.groupBy("symbol").agg(
        F.max("date").alias("price_date"), F.max_by("adj_close", "date").alias("price"))


def valued_holdings(prices: DataFrame, portfolios: DataFrame, versions: DataFrame, positions: DataFrame) -> DataFrame:
    """Latest version at latest prices; weights are stored ones or shares of market value.

    Symbols without a price are skipped.
    """
    held = latest_version(versions).join(positions, "version_id").join(latest_prices(prices), "symbol").join(
        portfolios.select("portfolio_id", "allocation_type"), "portfolio_id")
    group = W.partitionBy("portfolio_id")
    by_share = F.col("allocation_type") == "weight"
    market = F.when(~by_share, F.col("value") * F.col("price"))
    rows = held.withColumn("market_value", market)
    weight = F.when(by_share, F.col("value")).otherwise(
        F.try_divide(F.col("market_value"), F.sum("market_value").over(group)))
    return rows.withColumn("weight", weight).select(
        "portfolio_id", "allocation_type", "symbol", F.col("value").alias("position"), "price",
        "market_value", "weight")


def portfolio_list(portfolios: DataFrame, versions: DataFrame, positions: DataFrame) -> DataFrame:
    """Portfolios with version count and the number of positions in the latest version."""
    counts = versions.groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("version_count"), F.max_by("version_id", "version_number").alias("version_id"))
    sizes = positions.groupBy("version_id").agg(F.count(F.lit(1)).alias("position_count"))
    return portfolios.join(counts, "portfolio_id", "left").join(sizes, "version_id", "left").select(
        "portfolio_id", "name", "allocation_type", F.coalesce("version_count", F.lit(0)).alias("version_count"),
        F.coalesce("position_count", F.lit(0)).alias("position_count"))


def common_start(prices: DataFrame, versions: DataFrame, positions: DataFrame) -> DataFrame:
    """First date on which every symbol of the latest version has a price history."""
    first = prices.groupBy("symbol").agg(F.min("date").alias("first_date"))
    return latest_version(versions).join(positions, "version_id").join(first, "symbol").groupBy(
        "portfolio_id").agg(F.max("first_date").alias("common_start"))


def weight_warnings(portfolios: DataFrame, versions: DataFrame, positions: DataFrame,
                    tolerance: float = 0.001) -> DataFrame:
    """Weight-mode versions whose weights do not sum to one."""
    weighted = portfolios.where(F.col("allocation_type") == "weight").select("portfolio_id")
    totals = versions.join(weighted, "portfolio_id", "left_semi").join(positions, "version_id").groupBy(
        "portfolio_id", "version_id").agg(F.sum("value").alias("total_weight"))
    return totals.where(F.abs(F.col("total_weight") - 1) > tolerance)


def active_symbols(positions: DataFrame) -> DataFrame:
    return positions.select("symbol").distinct()


def search_instruments(instruments: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Case-insensitive substring search on symbol or name, alphabetical, first `limit`."""
    hit = F.col("symbol").ilike(f"%{text}%") | F.col("name").ilike(f"%{text}%")
    return instruments.where(hit).orderBy("symbol").limit(limit)


def search_many(instruments: DataFrame, searches: DataFrame, limit: int = 20) -> DataFrame:
    """The same for a table of searches (``search``): per search its first `limit` instruments, with their ``place``.

    A search meets the names by its rarest stretch of characters; an empty one finds nothing.
    """
    texts = instruments.select("symbol", F.explode(F.array(F.lower("symbol"), F.lower("name"))).alias("text"))
    hits = containing(texts, searches.select(F.lower("search").alias("asked")), [])
    found = hits.join(texts, "text").select("asked", "symbol").distinct()
    order = W.partitionBy("asked").orderBy("symbol")
    first = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    asked = searches.select("search").distinct().withColumn("asked", F.lower("search"))
    return asked.join(first, "asked").join(instruments, "symbol").drop("asked")


def version_changes(versions: DataFrame, positions: DataFrame) -> DataFrame:
    """Every version against the one before it: added, removed and changed symbols."""
    order = W.partitionBy("portfolio_id").orderBy("version_number")
    steps = versions.select("portfolio_id", "version_id", F.lag("version_id").over(order).alias("previous_id")).where(
        F.col("previous_id").isNotNull())
    new = steps.join(positions, "version_id").select(
        "portfolio_id", "version_id", "symbol", F.col("value").alias("new_value"))
    old = steps.join(positions.withColumnRenamed("version_id", "previous_id"), "previous_id").select(
        "portfolio_id", "version_id", "symbol", F.col("value").alias("old_value"))
    both = new.join(old, ["portfolio_id", "version_id", "symbol"], "full_outer")
    return both.withColumn(
        "change", F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed")
        .when(F.col("new_value") != F.col("old_value"), "changed")).where(F.col("change").isNotNull())


def _aimed(target: Column, action: Column) -> Column:
    """The target's weight before scaling."""
    return (F.when(action == "trim_25", target * 0.75).when(action == "trim_50", target * 0.5)
            .when(action == "exit", F.lit(0.0)).otherwise(target + 0.10))


def scenarios(holdings: DataFrame, requests: DataFrame) -> DataFrame:
    """Weights after each requested action (portfolio_id, target, action).

    One row per request and symbol of its portfolio. Trims hand the freed weight to the other
    positive holdings pro rata; add_10 takes .10 from the others pro rata. Non-positive weights
    are dropped and the rest is scaled to one.
    """
    base = holdings.select("portfolio_id", "symbol", "weight")
    targets = base.select("portfolio_id", F.col("symbol").alias("target"), F.col("weight").alias("target_weight"))
    asked = requests.select("portfolio_id", "target", "action").distinct().join(targets, ["portfolio_id", "target"])
    grid = base.join(asked, "portfolio_id")
    whole = W.partitionBy("portfolio_id", "target", "action")
    is_target = F.col("symbol") == F.col("target")
    w, t = F.col("weight"), F.col("target_weight")
    adding = F.col("action") == "add_10"
    aimed = _aimed(t, F.col("action"))
    counted = ~is_target & (adding | (w > 0))
    others = F.sum(F.when(counted, w)).over(whole)
    moved = F.when(adding, F.lit(-0.10)).otherwise(t - aimed)
    raw = F.when(is_target, aimed).when(counted & (others > 0), w + moved * w / others).otherwise(w)
    kept = grid.withColumn("raw_weight", raw).where(F.col("raw_weight") > 0)
    return kept.select(
        "portfolio_id", "target", "action", "symbol", F.col("weight").alias("old_weight"),
        (F.col("raw_weight") / F.sum("raw_weight").over(whole)).alias("new_weight"))


def _extremes(holdings: DataFrame, order: Column, name: str) -> DataFrame:
    """Per portfolio its first four holdings in an order, as an array of (place, symbol, weight); four, as one may be the target."""
    place = F.row_number().over(W.partitionBy("portfolio_id").orderBy(order, "symbol"))
    return holdings.withColumn("place", place).where(F.col("place") <= 4).groupBy("portfolio_id").agg(F.array_sort(F.collect_list(F.struct("place", "symbol", "weight"))).alias(name))


def scenario_impact(holdings: DataFrame, requests: DataFrame, latest: DataFrame) -> DataFrame:
    """Estimated volatility, drawdown and top-three concentration after each requested action; one row a request, without the grid of ``scenarios``.

    All others keep their proportions: they are scaled by one factor, and only sums per portfolio and its largest (or, if the factor is
    negative, smallest) holdings are needed. Requests after which nothing is held have no row.
    """
    w = F.col("weight")
    base = holdings.select("portfolio_id", "symbol", "weight")
    sums = base.groupBy("portfolio_id").agg(*[F.coalesce(F.sum(F.when(c, w)), F.lit(0.0)).alias(f"sum_{n}") for n, c in (("pos", w > 0), ("neg", w < 0))],
                                            *[F.count(F.when(c, 1)).alias(f"count_{n}") for n, c in (("pos", w > 0), ("neg", w < 0))])
    known = sums.join(_extremes(base, F.desc("weight"), "largest"), "portfolio_id").join(_extremes(base, F.asc("weight"), "smallest"), "portfolio_id")
    targets = base.select("portfolio_id", F.col("symbol").alias("target"), w.alias("target_before"))
    rows = requests.select("portfolio_id", "target", "action").distinct().join(targets, ["portfolio_id", "target"]).join(known, "portfolio_id")
    t, adding = F.col("target_before"), F.col("action") == "add_10"
    # of the others; by counts as well, as a difference of sums need not be exactly zero
    pos = F.when(F.col("count_pos") > (t > 0).cast("int"), F.col("sum_pos") - F.greatest(t, F.lit(0.0))).otherwise(0.0)
    neg = F.when(F.col("count_neg") > (t < 0).cast("int"), F.col("sum_neg") - F.least(t, F.lit(0.0))).otherwise(0.0)
    aimed = _aimed(t, F.col("action"))
    pool, moved = F.when(adding, pos + neg).otherwise(pos), F.when(adding, F.lit(-0.10)).otherwise(t - aimed)
    rows = rows.withColumns({"pos": pos, "neg": neg, "aimed": aimed, "factor": F.when(pool > 0, 1 + moved / pool).otherwise(1.0)})
    # short holdings are scaled by add_10 only, and a negative factor makes them the long ones
    turned = adding & (F.col("factor") < 0)
    left = F.when(turned, F.col("factor") * F.col("neg")).otherwise(F.greatest(F.col("factor"), F.lit(0.0)) * F.col("pos"))
    total = left + F.greatest(F.col("aimed"), F.lit(0.0))
    others = F.slice(F.filter(F.when(turned, F.col("smallest")).otherwise(F.col("largest")), lambda h: h["symbol"] != F.col("target")), F.lit(1), F.lit(3))
    new = F.concat(F.transform(others, lambda h: F.greatest(h["weight"] * F.col("factor"), F.lit(0.0))), F.array(F.greatest(F.col("aimed"), F.lit(0.0))))
    top = F.aggregate(F.slice(F.sort_array(new, asc=False), F.lit(1), F.lit(3)), F.lit(0.0), lambda a, x: a + x)
    old_top = F.aggregate(F.slice("largest", F.lit(1), F.lit(3)), F.lit(0.0), lambda a, h: a + h["weight"])
    found = rows.withColumns({"total": total, "new_top3": top, "old_top3": old_top}).where(F.col("total") > 0).join(
        latest.select("portfolio_id", "volatility_30d", "drawdown"), "portfolio_id", "left")
    changed = F.abs(t - F.greatest(F.col("aimed"), F.lit(0.0)) / F.col("total"))
    volatility, drawdown = F.coalesce("volatility_30d", F.lit(0.0)), F.coalesce("drawdown", F.lit(0.0))
    return found.select(
        "portfolio_id", "target", "action", volatility.alias("current_volatility"), (volatility * (1 - changed * 0.5)).alias("new_volatility"),
        drawdown.alias("current_drawdown"), (drawdown * (1 - changed * 0.3)).alias("new_drawdown"),
        (F.col("new_top3") / F.col("total") - F.col("old_top3")).alias("concentration_change"))


def rank_changes(holdings: DataFrame, outcome: DataFrame) -> DataFrame:
    """Rank by weight before and after each scenario; a missing rank counts as 999."""
    keys = ["portfolio_id", "target", "action"]
    old_rank = F.row_number().over(W.partitionBy("portfolio_id").orderBy(F.desc("weight"), "symbol"))
    ranked = holdings.select("portfolio_id", "symbol", old_rank.alias("old_rank"))
    cases = outcome.select(*keys).distinct()
    old = cases.join(ranked, "portfolio_id")
    new_rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("new_weight"), "symbol"))
    new = outcome.select(*keys, "symbol", new_rank.alias("new_rank"))
    both = old.join(new, keys + ["symbol"], "full_outer")
    change = F.coalesce("new_rank", F.lit(999)) - F.coalesce("old_rank", F.lit(999))
    return both.withColumn("rank_change", change).where(F.col("rank_change") != 0)


def refresh_counters(batch: DataFrame) -> DataFrame:
    """Symbols per refresh status of an ingest batch (symbol, status)."""
    return batch.groupBy("status").agg(F.countDistinct("symbol").alias("symbols"))


def _days_since(days: DataFrame, starts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """For each start (keys, since) the number of days (keys, date) on or after it: one sort per key, newest first."""
    stream = days.select(*keys, "date", F.lit(1).alias("is_day")).unionByName(starts.select(*keys, F.col("since").alias("date"), F.lit(0).alias("is_day")))
    newest = W.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("date"), F.desc("is_day")).rowsBetween(W.unboundedPreceding, 0)
    return stream.withColumn(name, F.sum("is_day").over(newest)).where(F.col("is_day") == 0).select(*keys, F.col("date").alias("since"), name).distinct()


def missing_history(prices: DataFrame, versions: DataFrame, positions: DataFrame, as_of: Column) -> DataFrame:
    """Days since the latest version began (plus one) and market days without a quote per symbol.

    Market days are distinct dates, a few hundred a year; they alone are counted in one task.
    """
    last = versions.groupBy("portfolio_id").agg(
        F.max_by("version_id", "version_number").alias("version_id"),
        F.to_date(F.max_by("effective_at", "version_number")).alias("since"))
    needed = last.join(positions, "version_id").select("portfolio_id", "since", "symbol")
    quoted = _days_since(prices.select("symbol", "date").distinct(), needed.select("symbol", "since").distinct(), ["symbol"], "quoted_days")
    open_days = _days_since(prices.select("date").distinct(), needed.select("since").distinct(), [], "market_days")
    return needed.join(quoted, ["since", "symbol"], "left").join(open_days, "since", "left").select(
        "portfolio_id", "symbol", (F.date_diff(as_of, F.col("since")) + 1).alias("window_days"),
        (F.coalesce("market_days", F.lit(0)) - F.coalesce("quoted_days", F.lit(0))).alias("missing_days"))
