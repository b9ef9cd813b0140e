"""Registered queries over prices, portfolios and holdings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.operators import holdings as H
from tidemark.operators import nav as N
from tidemark.plans import bindings as B
from tidemark.plans.oracle_tables import sql
from tidemark.plans.registry import query
from tidemark.runtime import cut_lineage


def _roles(spark, sf):
    """Prices, portfolios, versions and positions as stored tables would be.

    The three derived ones come out of joins over the largest tables and are read several times
    by every operator, so they are written once (aggregates, far smaller than their sources).
    """
    return (cut_lineage(B.prices_daily(spark, sf)), B.portfolios(spark, sf),
            cut_lineage(B.portfolio_versions(spark, sf)), cut_lineage(B.portfolio_positions(spark, sf)))


def _window(prices):
    """Prices of the last 365 days and the newest date."""
    end = prices.agg(F.max("date")).scalar()
    return N.prices_between(prices, F.date_sub(end, 365), end), end


def _books(spark, sf):
    """Portfolios, versions and positions, for what needs no prices."""
    return B.portfolios(spark, sf), cut_lineage(B.portfolio_versions(spark, sf)), cut_lineage(B.portfolio_positions(spark, sf))


def _nav(spark, sf, kind=None):
    """NAV of all portfolios, or of one allocation type; only the window's prices are stored."""
    end = B.table(spark, sf, "lineitem").agg(F.max(F.col("l_shipdate").cast("date"))).scalar()
    window = cut_lineage(N.prices_between(B.prices_daily(spark, sf), F.date_sub(end, 365), end))
    portfolios, versions, positions = _books(spark, sf)
    if kind:
        portfolios = portfolios.where(F.col("allocation_type") == kind)
    return N.daily_nav(window, portfolios, versions, positions)


def _rounded(df, digits: dict[str, int]):
    return df.select(*[
        (F.round(c, digits[c]) + F.lit(0.0)).alias(c) if c in digits else F.col(c) for c in df.columns])


WINDOW = {"win": "SELECT symbol, date, adj_close FROM prices WHERE date BETWEEN (SELECT max(date) FROM prices) - 365 AND (SELECT max(date) FROM prices)"}
CALENDAR = WINDOW | {
    "cal": """SELECT portfolio_id, date, lag(date) OVER (PARTITION BY portfolio_id ORDER BY date) AS previous_date
      FROM (SELECT DISTINCT portfolio_id, date FROM win JOIN (SELECT DISTINCT portfolio_id, symbol FROM positions) USING (symbol))"""}
NAV = CALENDAR | {
    "vday": """SELECT c.portfolio_id, c.date, c.previous_date, v.version_id FROM cal c ASOF JOIN versions v
      ON c.portfolio_id = v.portfolio_id AND c.date >= v.effective_date""",
    "perday": """SELECT d.portfolio_id, d.date, d.previous_date,
      sum(p.value * CASE WHEN cur.adj_close IS NOT NULL AND prv.adj_close <> 0 THEN cur.adj_close / prv.adj_close - 1 ELSE 0 END) AS day_return,
      sum(coalesce(p.value * cur.adj_close, 0)) AS market_value
      FROM vday d JOIN positions p USING (version_id) LEFT JOIN win cur ON cur.symbol = p.symbol AND cur.date = d.date
      LEFT JOIN win prv ON prv.symbol = p.symbol AND prv.date = d.previous_date GROUP BY ALL""",
    "nav": """SELECT portfolio_id, allocation_type, date, CASE WHEN allocation_type = 'weight'
        THEN 100 * product(CASE WHEN previous_date IS NULL THEN 1 ELSE 1 + day_return END) OVER (PARTITION BY portfolio_id ORDER BY date)
        ELSE market_value END AS nav FROM perday JOIN portfolios USING (portfolio_id)"""}
METRICS = NAV | {
    "returns": "SELECT *, nav / nullif(lag(nav) OVER (PARTITION BY portfolio_id ORDER BY date), 0) - 1 AS return_1d FROM nav",
    "peaks": """SELECT *, greatest(max(nav) OVER (PARTITION BY portfolio_id ORDER BY date), CASE WHEN allocation_type = 'weight' THEN 100 ELSE 0 END) AS peak FROM returns""",
    "metrics": """SELECT portfolio_id, allocation_type, date, nav, return_1d, coalesce((peak - nav) / nullif(peak, 0), 0) AS drawdown,
      max(coalesce((peak - nav) / nullif(peak, 0), 0)) OVER (PARTITION BY portfolio_id ORDER BY date) AS max_drawdown,
      CASE WHEN count(return_1d) OVER w >= 30 THEN stddev_samp(return_1d) OVER w * sqrt(252) END AS volatility_30d
      FROM peaks WINDOW w AS (PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""}
ROLES = ["prices", "portfolios", "versions", "positions"]


@query("p01_price_range", sql("prices", "SELECT symbol, CAST(date AS VARCHAR) AS date, round(adj_close, 6) AS adj_close FROM win", WINDOW))
def price_range(spark, sf):
    return _rounded(_window(B.prices_daily(spark, sf))[0], {"adj_close": 6})


@query("p02_trading_calendar", sql(ROLES, "SELECT portfolio_id, CAST(date AS VARCHAR) AS date, CAST(previous_date AS VARCHAR) AS previous_date FROM cal", CALENDAR))
def trading_calendar(spark, sf):
    prices, _, versions, positions = _roles(spark, sf)
    return N.trading_calendar(_window(prices)[0], versions, positions)


@query("p03_version_on_day", sql(ROLES, "SELECT portfolio_id, CAST(date AS VARCHAR) AS date, version_id FROM vday", NAV))
def version_on_day(spark, sf):
    prices, _, versions, positions = _roles(spark, sf)
    calendar = N.trading_calendar(_window(prices)[0], versions, positions)
    return N.version_on_day(calendar.select("portfolio_id", "date"), versions)


@query("p03_version_at_midnight", sql(ROLES, """SELECT c.portfolio_id, CAST(c.date AS VARCHAR) AS date, v.version_id FROM cal c ASOF JOIN versions v
  ON c.portfolio_id = v.portfolio_id AND CAST(c.date AS TIMESTAMP) >= v.effective_at""", CALENDAR))
def version_at_midnight(spark, sf):
    prices, _, versions, positions = _roles(spark, sf)
    calendar = N.trading_calendar(_window(prices)[0], versions, positions)
    return N.version_at_midnight(calendar.select("portfolio_id", "date"), versions)


@query("p04_nav_weight_mode", sql(ROLES, "SELECT portfolio_id, CAST(date AS VARCHAR) AS date, round(nav, 6) AS nav FROM nav WHERE allocation_type = 'weight'", NAV))
def nav_weight_mode(spark, sf):
    rows = _nav(spark, sf, "weight")
    return _rounded(rows.select("portfolio_id", "date", "nav"), {"nav": 6})


@query("p05_nav_quantity_mode", sql(ROLES, "SELECT portfolio_id, CAST(date AS VARCHAR) AS date, round(nav, 4) AS nav FROM nav WHERE allocation_type = 'quantity'", NAV))
def nav_quantity_mode(spark, sf):
    rows = _nav(spark, sf, "quantity")
    return _rounded(rows.select("portfolio_id", "date", "nav"), {"nav": 4})


@query("p06_daily_returns", sql(ROLES, "SELECT portfolio_id, CAST(date AS VARCHAR) AS date, round(return_1d, 8) + 0.0 AS return_1d FROM metrics", METRICS))
def daily_returns(spark, sf):
    rows = N.daily_metrics(_nav(spark, sf)).select("portfolio_id", "date", "return_1d")
    return _rounded(rows, {"return_1d": 8})


@query("p07_drawdown", sql(ROLES, "SELECT portfolio_id, CAST(date AS VARCHAR) AS date, round(drawdown, 8) + 0.0 AS drawdown, round(max_drawdown, 8) + 0.0 AS max_drawdown FROM metrics", METRICS))
def drawdown(spark, sf):
    rows = N.daily_metrics(_nav(spark, sf)).select("portfolio_id", "date", "drawdown", "max_drawdown")
    return _rounded(rows, {"drawdown": 8, "max_drawdown": 8})


@query("p08_daily_metrics", sql(ROLES, """SELECT portfolio_id, allocation_type, CAST(date AS VARCHAR) AS date, round(nav, 4) AS nav, round(return_1d, 8) + 0.0 AS return_1d,
  round(drawdown, 8) + 0.0 AS drawdown, round(max_drawdown, 8) + 0.0 AS max_drawdown, round(volatility_30d, 8) AS volatility_30d FROM metrics""", METRICS))
def daily_metrics(spark, sf):
    return _rounded(N.daily_metrics(_nav(spark, sf)),
                    {"nav": 4, "return_1d": 8, "drawdown": 8, "max_drawdown": 8, "volatility_30d": 8})


@query("p09_performance_series", sql(ROLES, """SELECT portfolio_id, CAST(count(*) AS BIGINT) AS points, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date,
  string_agg(format('{:.4f}', nav), ',' ORDER BY date) AS nav_values FROM metrics GROUP BY portfolio_id""", METRICS))
def performance_series(spark, sf):
    series = N.performance_series(N.daily_metrics(_nav(spark, sf)))
    shown = F.transform("nav_values", lambda v: F.replace(F.format_number(v, 4), F.lit(","), F.lit("")))
    return series.select(
        "portfolio_id", F.size("dates").cast("bigint").alias("points"),
        F.array_min("dates").alias("first_date"), F.array_max("dates").alias("last_date"),
        F.array_join(shown, ",").alias("nav_values"))


LATEST = METRICS | {"latest": """SELECT portfolio_id, max(date) AS date, arg_max(nav, date) AS nav,
    arg_max(nav, date) / nullif(arg_min(nav, date) FILTER (date >= date_trunc('month', (SELECT max(date) FROM prices))), 0) - 1 AS return_mtd,
    arg_max(nav, date) / nullif(arg_min(nav, date) FILTER (date >= date_trunc('year', (SELECT max(date) FROM prices))), 0) - 1 AS return_ytd FROM metrics GROUP BY portfolio_id""",
    "latest_all": "SELECT l.*, m.return_1d, m.volatility_30d, m.drawdown FROM latest l JOIN metrics m USING (portfolio_id, date)"}


def _metrics_and_latest(spark, sf, roles=None):
    prices, portfolios, versions, positions = roles or _roles(spark, sf)
    window, end = _window(prices)
    metrics = cut_lineage(N.daily_metrics(N.daily_nav(window, portfolios, versions, positions)))
    return metrics, N.latest_metrics(metrics, end)


@query("p10_latest_metrics", sql(ROLES, """SELECT portfolio_id, CAST(date AS VARCHAR) AS date, round(nav, 4) AS nav, round(return_1d, 8) + 0.0 AS return_1d,
  round(return_mtd, 8) + 0.0 AS return_mtd, round(return_ytd, 8) + 0.0 AS return_ytd, round(volatility_30d, 8) AS volatility_30d, round(drawdown, 8) + 0.0 AS drawdown FROM latest_all""", LATEST))
def latest_metrics(spark, sf):
    _, latest = _metrics_and_latest(spark, sf)
    return _rounded(latest, {"nav": 4, "return_1d": 8, "return_mtd": 8, "return_ytd": 8, "volatility_30d": 8, "drawdown": 8})


CONTRIB = {
    "newest": "SELECT max(date) AS e FROM prices",
    "periods": """SELECT '30d' AS period, e - 30 AS s, e FROM newest UNION ALL SELECT '90d', e - 90, e FROM newest
      UNION ALL SELECT 'ytd', CAST(date_trunc('year', e) AS DATE), e FROM newest UNION ALL SELECT '1y', e - 365, e FROM newest""",
    "current": """SELECT f.portfolio_id, f.allocation_type, p.period, p.s, p.e, arg_max(v.version_id, v.version_number) AS version_id FROM portfolios f, periods p
      JOIN versions v ON v.portfolio_id = f.portfolio_id AND v.effective_at <= CAST(p.e AS TIMESTAMP) GROUP BY ALL""",
    "moves": """SELECT period, symbol, arg_min(adj_close, date) AS first_price, arg_max(adj_close, date) AS last_price, count(*) AS quotes
      FROM prices JOIN periods ON date BETWEEN s AND e GROUP BY ALL""",
    "weighted": """SELECT c.portfolio_id, c.period, p.symbol, p.value AS position, m.quotes, m.last_price / m.first_price - 1 AS return_pct,
      CASE WHEN c.allocation_type = 'weight' THEN p.value ELSE p.value * m.last_price / sum(p.value * m.last_price) OVER (PARTITION BY c.portfolio_id, c.period) END AS weight
      FROM current c JOIN positions p USING (version_id) JOIN moves m ON m.period = c.period AND m.symbol = p.symbol""",
    "contributions": "SELECT portfolio_id, period, symbol, position, weight, return_pct, weight * return_pct AS contribution FROM weighted WHERE quotes >= 2",
    "attribution": """SELECT *, sum(contribution) OVER (PARTITION BY portfolio_id, period) AS total_return,
      row_number() OVER (PARTITION BY portfolio_id, period ORDER BY contribution DESC, symbol) AS place FROM contributions"""}


def _contributions(spark, sf):
    prices, portfolios, versions, positions = _roles(spark, sf)
    end = prices.agg(F.max("date")).scalar()
    return H.contributions(prices, portfolios, versions, positions, end)


_CDIG = {"position": 8, "weight": 8, "return_pct": 8, "contribution": 8, "total_return": 8}


@query("p11_contributions", sql(ROLES, """SELECT portfolio_id, period, symbol, round(position, 8) AS position, round(weight, 8) AS weight, round(return_pct, 8) + 0.0 AS return_pct,
  round(contribution, 8) + 0.0 AS contribution FROM contributions""", CONTRIB))
def contributions(spark, sf):
    return _rounded(_contributions(spark, sf), _CDIG)


@query("p12_attribution", sql(ROLES, """SELECT portfolio_id, period, symbol, round(weight, 8) AS weight, round(return_pct, 8) + 0.0 AS return_pct,
  round(contribution, 8) + 0.0 AS contribution, round(total_return, 8) + 0.0 AS total_return, place FROM attribution""", CONTRIB))
def attribution(spark, sf):
    return _rounded(H.attribution(_contributions(spark, sf)).drop("position"), _CDIG)


@query("p13_key_drivers", sql(ROLES, """SELECT portfolio_id, period, arg_min(symbol, place) AS top_symbol, round(max(contribution), 8) + 0.0 AS top_contribution,
  round(max(total_return), 8) + 0.0 AS total_return, round(coalesce(sum(contribution) FILTER (contribution > 0), 0), 8) + 0.0 AS positive_total,
  round(coalesce(sum(contribution) FILTER (contribution < 0), 0), 8) + 0.0 AS negative_total,
  coalesce(string_agg(symbol, ' and ' ORDER BY up) FILTER (contribution > 0 AND up <= 2), '') AS top_positive,
  coalesce(string_agg(symbol, ' and ' ORDER BY down) FILTER (contribution < 0 AND down <= 2), '') AS top_negative,
  round(max(contribution) / max(total_return) * 100, 4) + 0.0 AS share_pct,
  CASE WHEN max(contribution) / max(total_return) * 100 > 100 THEN 'single driver, others detracted' WHEN max(contribution) < 0 THEN 'all positions negative' ELSE 'primary driver' END AS driver_class
  FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id, period ORDER BY contribution DESC, symbol) AS up,
    row_number() OVER (PARTITION BY portfolio_id, period ORDER BY contribution, symbol DESC) AS down FROM attribution) GROUP BY portfolio_id, period""", CONTRIB))
def key_drivers(spark, sf):
    rows = H.key_drivers(H.attribution(_contributions(spark, sf)))
    return _rounded(rows, {"top_contribution": 8, "total_return": 8, "positive_total": 8, "negative_total": 8, "share_pct": 4})


@query("p14_compare_portfolios", sql(ROLES, """SELECT portfolio_id, CAST(s AS VARCHAR) AS "start", CAST(e AS VARCHAR) AS "end", round(first_nav, 4) AS first_nav, round(last_nav, 4) AS last_nav,
  CAST(min(s) OVER () AS VARCHAR) AS overall_start, CAST(max(e) OVER () AS VARCHAR) AS overall_end FROM (
    SELECT portfolio_id, min(date) AS s, max(date) AS e, arg_min(nav, date) AS first_nav, arg_max(nav, date) AS last_nav
    FROM metrics WHERE portfolio_id IN (SELECT CAST(regexp_extract(s_name, '(\\d+)', 1) AS INTEGER) FROM supplier) GROUP BY portfolio_id)""", METRICS))
def compare_portfolios(spark, sf):
    chosen = B.table(spark, sf, "supplier").select(
        F.regexp_extract("s_name", r"(\d+)", 1).cast("int").alias("portfolio_id"))
    rows = N.compare_portfolios(N.daily_metrics(_nav(spark, sf)), chosen)
    return _rounded(rows, {"first_nav": 4, "last_nav": 4})


@query("p15_relative_performance", sql(ROLES, """SELECT t.portfolio_id, round(total_return, 6) + 0.0 AS total_return, round(b, 6) + 0.0 AS benchmark_return, round(total_return - b, 6) + 0.0 AS alpha,
  round((return_ytd - 0.045) / nullif(volatility_30d, 0), 6) + 0.0 AS sharpe FROM (
    SELECT portfolio_id, (arg_max(nav, date) / nullif(arg_min(nav, date), 0) - 1) * 100 AS total_return FROM metrics GROUP BY portfolio_id) t
  JOIN latest_all USING (portfolio_id), (SELECT (arg_max(nav, date) / nullif(arg_min(nav, date), 0) - 1) * 100 AS b FROM metrics WHERE portfolio_id = 0)""", LATEST))
def relative_performance(spark, sf):
    metrics, latest = _metrics_and_latest(spark, sf)
    rows = N.relative_performance(metrics, latest, 0, V.RISK_FREE_PCT)
    return _rounded(rows, {"total_return": 6, "benchmark_return": 6, "alpha": 6, "sharpe": 6})


HOLD = {
    "last_version": "SELECT portfolio_id, arg_max(version_id, version_number) AS version_id, max(version_number) AS version_number FROM versions GROUP BY portfolio_id",
    "last_price": "SELECT symbol, max(date) AS price_date, arg_max(adj_close, date) AS price FROM prices GROUP BY symbol",
    "holdings": """SELECT l.portfolio_id, f.allocation_type, p.symbol, p.value AS position, price,
      CASE WHEN f.allocation_type = 'quantity' THEN p.value * price END AS market_value,
      CASE WHEN f.allocation_type = 'weight' THEN p.value ELSE p.value * price / sum(p.value * price) OVER (PARTITION BY l.portfolio_id) END AS weight
      FROM last_version l JOIN positions p USING (version_id) JOIN last_price USING (symbol) JOIN portfolios f ON f.portfolio_id = l.portfolio_id"""}


def _holdings(spark, sf):
    return H.valued_holdings(*_roles(spark, sf))


@query("p16_valued_holdings", sql(ROLES, "SELECT portfolio_id, allocation_type, symbol, round(position, 8) AS position, round(price, 6) AS price, round(market_value, 4) AS market_value, round(weight, 8) AS weight FROM holdings", HOLD))
def valued_holdings(spark, sf):
    return _rounded(_holdings(spark, sf), {"position": 8, "price": 6, "market_value": 4, "weight": 8})


@query("p17_portfolio_list", sql(ROLES, """SELECT portfolio_id, name, allocation_type, coalesce(n, 0) AS version_count, coalesce(c, 0) AS position_count FROM portfolios
  LEFT JOIN (SELECT portfolio_id, count(*) AS n FROM versions GROUP BY portfolio_id) USING (portfolio_id) LEFT JOIN last_version USING (portfolio_id)
  LEFT JOIN (SELECT version_id, count(*) AS c FROM positions GROUP BY version_id) USING (version_id)""", HOLD))
def portfolio_list(spark, sf):
    portfolios, versions, positions = _books(spark, sf)
    return H.portfolio_list(portfolios, versions, positions)


@query("p18_next_version", sql(ROLES, "SELECT portfolio_id, max(version_number) AS latest_number, coalesce(max(version_number), 0) + 1 AS next_number FROM portfolios LEFT JOIN versions USING (portfolio_id) GROUP BY portfolio_id"))
def next_version(spark, sf):
    return H.next_version(B.portfolios(spark, sf), B.portfolio_versions(spark, sf))


@query("p19_common_start", sql(ROLES, """SELECT portfolio_id, CAST(max(d) AS VARCHAR) AS common_start FROM last_version l JOIN positions p ON p.version_id = l.version_id
  JOIN (SELECT symbol, min(date) AS d FROM prices GROUP BY symbol) f ON f.symbol = p.symbol GROUP BY l.portfolio_id""".replace("SELECT portfolio_id", "SELECT l.portfolio_id"), HOLD))
def common_start(spark, sf):
    prices, _, versions, positions = _roles(spark, sf)
    return H.common_start(prices, versions, positions)


@query("p20_weight_warnings", sql(ROLES, """SELECT v.portfolio_id, version_id, round(sum(value * 1.002), 8) AS total_weight FROM versions v JOIN portfolios f ON f.portfolio_id = v.portfolio_id
  JOIN positions p USING (version_id) WHERE allocation_type = 'weight' AND v.version_number % 2 = 0 GROUP BY ALL"""))
def weight_warnings(spark, sf):
    portfolios, versions, positions = _books(spark, sf)
    off = positions.join(versions.select("version_id", "version_number"), "version_id").select(
        "version_id", "symbol",
        F.when(F.col("version_number") % 2 == 0, F.col("value") * 1.002).otherwise(F.col("value")).alias("value"))
    return _rounded(H.weight_warnings(portfolios, versions, off), {"total_weight": 8})


@query("p21_active_symbols", sql(ROLES, "SELECT DISTINCT symbol FROM positions"))
def active_symbols(spark, sf):
    return H.active_symbols(B.portfolio_positions(spark, sf))


@query("p22_instrument_search", sql("instruments", "SELECT * FROM instruments WHERE symbol ILIKE '%BRAND#1%' OR name ILIKE '%BRAND#1%' ORDER BY symbol LIMIT 8"))
def instrument_search(spark, sf):
    return H.search_instruments(B.instruments(spark, sf), "BRAND#1", 8)


@query("p22_instrument_searches", sql("instruments", """SELECT search, place, symbol, name FROM (
    SELECT q.search, i.symbol, i.name, row_number() OVER (PARTITION BY q.search ORDER BY i.symbol) AS place
    FROM (SELECT DISTINCT unnest([upper(substr(p_brand, 4)), substr(p_brand, 7, 1), substr(p_brand, 7), 'y ' || substr(p_brand, 8, 1), 'none ' || p_brand]) AS search FROM part) q
    JOIN instruments i ON contains(lower(i.symbol), lower(q.search)) OR contains(lower(i.name), lower(q.search))) WHERE place <= 8"""))
def instrument_searches(spark, sf):
    brand = F.col("p_brand")
    asked = F.array(F.upper(F.substring(brand, 4, 100)), F.substring(brand, 7, 1), F.substring(brand, 7, 100), F.concat(F.lit("y "), F.substring(brand, 8, 1)), F.concat(F.lit("none "), brand))
    searches = B.table(spark, sf, "part").select(F.explode(asked).alias("search")).distinct()
    return H.search_many(B.instruments(spark, sf), searches, 8).select("search", "place", "symbol", "name")


@query("p23_version_changes", sql(ROLES, """SELECT coalesce(n.portfolio_id, o.portfolio_id) AS portfolio_id, coalesce(n.version_id, o.version_id) AS version_id, coalesce(n.symbol, o.symbol) AS symbol,
    round(new_value, 8) AS new_value, round(old_value, 8) AS old_value,
    CASE WHEN old_value IS NULL THEN 'added' WHEN new_value IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM (SELECT s.portfolio_id, s.version_id, symbol, value AS new_value FROM steps s JOIN positions p USING (version_id)) n
  FULL JOIN (SELECT s.portfolio_id, s.version_id, symbol, value AS old_value FROM steps s JOIN positions p ON p.version_id = s.previous_id) o
    ON n.version_id = o.version_id AND n.symbol = o.symbol WHERE old_value IS NULL OR new_value IS NULL OR old_value <> new_value""",
    {"steps": "SELECT * FROM (SELECT portfolio_id, version_id, lag(version_id) OVER (PARTITION BY portfolio_id ORDER BY version_number) AS previous_id FROM versions) WHERE previous_id IS NOT NULL"}))
def version_changes(spark, sf):
    rows = H.version_changes(B.portfolio_versions(spark, sf), B.portfolio_positions(spark, sf))
    return _rounded(rows, {"new_value": 8, "old_value": 8})


# each order asks about one holding of its customer's portfolio, so the requests grow with the orders and can reach every holding
ASKED = {"asked": """SELECT DISTINCT portfolio_id, symbol AS target FROM (SELECT portfolio_id, symbol, row_number() OVER (PARTITION BY portfolio_id ORDER BY symbol) AS place FROM holdings)
  JOIN (SELECT DISTINCT o_custkey % 25 AS portfolio_id, o_orderkey % 31 + 1 AS place FROM orders) USING (portfolio_id, place)"""}


def asked_holdings(spark, sf, held):
    place = F.row_number().over(W.partitionBy("portfolio_id").orderBy("symbol"))
    asked = B.table(spark, sf, "orders").select((F.col("o_custkey") % 25).alias("portfolio_id"), (F.col("o_orderkey") % 31 + 1).alias("place")).distinct()
    return held.withColumn("place", place).join(asked, ["portfolio_id", "place"]).select("portfolio_id", F.col("symbol").alias("target"))


def _asked_actions(spark, sf, held):
    return asked_holdings(spark, sf, held).select("*", F.explode(F.array(*[F.lit(a) for a in V.SCENARIO_ACTIONS])).alias("action"))


def _scenarios(spark, sf, held):
    return H.scenarios(held, _asked_actions(spark, sf, held))


SCENARIO = HOLD | ASKED | {
    "grid": """SELECT h.portfolio_id, t.symbol AS target, action, h.symbol, h.weight AS w, t.weight AS t,
      CASE action WHEN 'trim_25' THEN t.weight * 0.75 WHEN 'trim_50' THEN t.weight * 0.5 WHEN 'exit' THEN 0.0 ELSE t.weight + 0.10 END AS aimed
      FROM asked q JOIN holdings t ON t.portfolio_id = q.portfolio_id AND t.symbol = q.target JOIN holdings h ON h.portfolio_id = q.portfolio_id,
      (SELECT unnest(['trim_25', 'trim_50', 'exit', 'add_10']) AS action)""",
    "spread": """SELECT *, CASE WHEN symbol = target THEN aimed
        WHEN (action = 'add_10' OR w > 0) AND others > 0 THEN w + CASE WHEN action = 'add_10' THEN -0.10 ELSE t - aimed END * w / others ELSE w END AS raw
      FROM (SELECT *, sum(w) FILTER (symbol <> target AND (action = 'add_10' OR w > 0)) OVER (PARTITION BY portfolio_id, target, action) AS others FROM grid)""",
    "outcome": """SELECT portfolio_id, target, action, symbol, w AS old_weight, raw / sum(raw) OVER (PARTITION BY portfolio_id, target, action) AS new_weight FROM spread WHERE raw > 0"""}


@query("p24_scenarios", sql(ROLES, "SELECT portfolio_id, target, action, symbol, round(old_weight, 8) AS old_weight, round(new_weight, 8) AS new_weight FROM outcome", SCENARIO))
def scenarios(spark, sf):
    return _rounded(_scenarios(spark, sf, _holdings(spark, sf)), {"old_weight": 8, "new_weight": 8})


@query("p25_scenario_impact", sql(ROLES, """SELECT o.portfolio_id, o.target, o.action, round(vol, 8) AS current_volatility, round(vol * (1 - moved * 0.5), 8) AS new_volatility,
    round(dd, 8) + 0.0 AS current_drawdown, round(dd * (1 - moved * 0.3), 8) + 0.0 AS new_drawdown, round(new_top3 - old_top3, 8) + 0.0 AS concentration_change
  FROM (SELECT portfolio_id, target, action, sum(new_weight) FILTER (r <= 3) AS new_top3, sum(new_weight) FILTER (symbol = target) AS after FROM (
      SELECT *, row_number() OVER (PARTITION BY portfolio_id, target, action ORDER BY new_weight DESC, symbol) AS r FROM outcome) GROUP BY ALL) o
  JOIN (SELECT portfolio_id, sum(weight) AS old_top3 FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY weight DESC, symbol) AS r FROM holdings) WHERE r <= 3 GROUP BY ALL) b USING (portfolio_id)
  JOIN (SELECT portfolio_id, coalesce(volatility_30d, 0) AS vol, coalesce(drawdown, 0) AS dd FROM latest_all) l USING (portfolio_id)
  JOIN (SELECT portfolio_id, symbol AS target, weight FROM holdings) h ON h.portfolio_id = o.portfolio_id AND h.target = o.target,
  LATERAL (SELECT abs(h.weight - coalesce(o.after, 0)) AS moved)""", LATEST | SCENARIO))
def scenario_impact(spark, sf):
    roles = _roles(spark, sf)
    held = H.valued_holdings(*roles)
    _, latest = _metrics_and_latest(spark, sf, roles)
    rows = H.scenario_impact(held, _asked_actions(spark, sf, held), latest)
    return _rounded(rows, {c: 8 for c in rows.columns if c not in ("portfolio_id", "target", "action")})


@query("p26_rank_changes", sql(ROLES, """SELECT portfolio_id, target, action, symbol, CAST(old_rank AS DOUBLE) AS old_rank, CAST(new_rank AS DOUBLE) AS new_rank, coalesce(new_rank, 999) - coalesce(old_rank, 999) AS rank_change
  FROM (SELECT c.portfolio_id, target, action, symbol, old_rank FROM (SELECT DISTINCT portfolio_id, target, action FROM outcome) c
      JOIN (SELECT portfolio_id, symbol, row_number() OVER (PARTITION BY portfolio_id ORDER BY weight DESC, symbol) AS old_rank FROM holdings) USING (portfolio_id)) o
  FULL JOIN (SELECT portfolio_id, target, action, symbol, row_number() OVER (PARTITION BY portfolio_id, target, action ORDER BY new_weight DESC, symbol) AS new_rank FROM outcome) n
    USING (portfolio_id, target, action, symbol) WHERE coalesce(new_rank, 999) <> coalesce(old_rank, 999)""", SCENARIO))
def rank_changes(spark, sf):
    held = _holdings(spark, sf)
    rows = H.rank_changes(held, _scenarios(spark, sf, held))
    return rows.withColumn("old_rank", F.col("old_rank").cast("double")).withColumn(
        "new_rank", F.col("new_rank").cast("double"))


@query("p27_refresh_counters", sql("prices", """SELECT CASE WHEN d >= (SELECT max(date) FROM prices) - 3 THEN 'updated' ELSE 'failed' END AS status, count(*) AS symbols
  FROM (SELECT symbol, max(date) AS d FROM prices GROUP BY symbol) GROUP BY 1"""))
def refresh_counters(spark, sf):
    prices = B.prices_daily(spark, sf)
    newest = prices.agg(F.max("date")).scalar()
    batch = prices.groupBy("symbol").agg(F.max("date").alias("last_date")).select(
        "symbol", F.when(F.col("last_date") >= F.date_sub(newest, 3), "updated").otherwise("failed").alias("status"))
    return H.refresh_counters(batch)


@query("p28_missing_history", sql(ROLES, """SELECT portfolio_id, symbol, (SELECT max(date) FROM prices) - since + 1 AS window_days,
    (SELECT count(DISTINCT date) FROM prices WHERE date >= since) - (SELECT count(*) FROM prices q WHERE q.symbol = p.symbol AND q.date >= since) AS missing_days
  FROM (SELECT portfolio_id, arg_max(version_id, version_number) AS version_id, CAST(arg_max(effective_at, version_number) AS DATE) AS since FROM versions GROUP BY portfolio_id)
  JOIN (SELECT version_id, symbol FROM positions) p USING (version_id)"""))
def missing_history(spark, sf):
    prices, _, versions, positions = _roles(spark, sf)
    return H.missing_history(prices, versions, positions, prices.agg(F.max("date")).scalar())
