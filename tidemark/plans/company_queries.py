"""Registered queries over bars, company feeds and portfolio context."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import company as C
from tidemark.operators import holdings as H
from tidemark.operators import technicals as T
from tidemark.plans import bindings as B
from tidemark.plans.oracle_tables import quoted, sql
from tidemark.plans.portfolio_queries import ASKED, CONTRIB, HOLD, ROLES, _roles, _rounded, asked_holdings
from tidemark.plans.registry import query


def _bars(spark, sf):
    return B.prices_daily(spark, sf).select("symbol", "date", "high", "low", "close")


def _ema_sql(n: int) -> str:
    """Closed form of the seeded fold: mean * (1-m)^n + sum of m (1-m)^(n-1-k) x_k."""
    m = 2.0 / (n + 1)
    return (f"CASE WHEN len(c{n}) = {n} THEN list_avg(c{n}) * pow({1 - m!r}, {n}) + "
            f"list_sum(list_transform(range(0, {n}), lambda k: {m!r} * pow({1 - m!r}, {n} - 1 - k) * c{n}[k + 1])) END")


IND = {
    "moves": "SELECT *, adj_close AS close, adj_close - lag(adj_close) OVER (PARTITION BY symbol ORDER BY date) AS move FROM prices",
    "raw": """SELECT *, row_number() OVER w AS bars, avg(greatest(move, 0)) OVER w14 AS gain, avg(greatest(-move, 0)) OVER w14 AS loss,
      list(close) OVER w12 AS c12, list(close) OVER w26 AS c26, avg(close) OVER w20 AS mean, stddev_pop(close) OVER w20 AS dev,
      avg(close) OVER w50 AS a50, avg(close) OVER w200 AS a200, lead(date) OVER w AS next_date
      FROM moves WINDOW w AS (PARTITION BY symbol ORDER BY date), w14 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
      w12 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), w26 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW),
      w20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w50 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
      w200 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""",
    "emas": f"SELECT *, {_ema_sql(12)} AS ema12, {_ema_sql(26)} AS ema26 FROM raw",
    "ind": """SELECT symbol, date, next_date, bars, close, ema12, ema26, CASE WHEN bars >= 15 THEN CASE WHEN loss = 0 THEN 100 ELSE round(100 - 100 / (1 + gain / loss), 2) END END AS rsi,
      round(ema12 - ema26, 4) + 0.0 AS macd, round((ema12 - ema26) * 0.95, 4) + 0.0 AS macd_signal, round((ema12 - ema26) - (ema12 - ema26) * 0.95, 4) + 0.0 AS macd_histogram,
      CASE WHEN bars >= 20 THEN round(mean, 2) END AS bb_middle, CASE WHEN bars >= 20 THEN round(mean + 2 * dev, 2) END AS bb_upper,
      CASE WHEN bars >= 20 THEN round(mean - 2 * dev, 2) END AS bb_lower, CASE WHEN bars >= 20 THEN round(4 * dev / mean * 100, 2) END AS bb_width,
      CASE WHEN bars >= 50 THEN round(a50, 2) END AS sma_50, CASE WHEN bars >= 200 THEN round(a200, 2) END AS sma_200 FROM emas""",
    "bundle": """SELECT symbol, CAST(date AS VARCHAR) AS date, round(close, 6) AS close, rsi, macd, macd_signal, macd_histogram, bb_middle, bb_upper, bb_lower, bb_width, sma_50, sma_200,
      CASE WHEN sma_200 IS NOT NULL THEN sma_50 END AS shown_sma_50, CASE WHEN sma_50 IS NOT NULL THEN sma_200 END AS shown_sma_200
      FROM ind WHERE next_date IS NULL AND bars >= 50"""}
KEY = "symbol, CAST(date AS VARCHAR) AS date"


@query("c01_rsi", sql("prices", f"SELECT {KEY}, rsi FROM ind", IND))
def rsi(spark, sf):
    return T.with_rsi(_bars(spark, sf)).select("symbol", "date", "rsi")


@query("c02_seeded_ema", sql("prices", f"SELECT {KEY}, round(ema12, 4) AS ema_12, round(ema26, 4) AS ema_26 FROM ind", IND))
def seeded_ema(spark, sf):
    return _bars(spark, sf).select("symbol", "date", F.round(T.ema(12), 4).alias("ema_12"), F.round(T.ema(26), 4).alias("ema_26"))


@query("c03_macd", sql("prices", f"SELECT {KEY}, macd, macd_signal, macd_histogram FROM ind", IND))
def macd(spark, sf):
    return T.with_macd(_bars(spark, sf)).select("symbol", "date", "macd", "macd_signal", "macd_histogram")


@query("c04_sma", sql("prices", f"SELECT {KEY}, sma_50, sma_200 FROM ind", IND))
def sma(spark, sf):
    return _bars(spark, sf).select("symbol", "date", T.sma(50).alias("sma_50"), T.sma(200).alias("sma_200"))


@query("c05_bollinger", sql("prices", f"SELECT {KEY}, bb_middle, bb_upper, bb_lower, bb_width FROM ind", IND))
def bollinger(spark, sf):
    return T.with_bollinger(_bars(spark, sf)).select("symbol", "date", "bb_middle", "bb_upper", "bb_lower", "bb_width")


@query("c06_indicator_bundle", sql("prices", "SELECT * FROM bundle", IND))
def indicator_bundle(spark, sf):
    return _rounded(T.bundle(_bars(spark, sf)), {"close": 6})


@query("c07_signals", sql("prices", f"""SELECT symbol, trend_50, trend_200, CASE WHEN rsi > 70 THEN 'overbought' WHEN rsi < 30 THEN 'oversold' ELSE 'neutral' END AS rsi_state,
  CASE WHEN macd > macd_signal THEN 'bullish' WHEN macd IS NOT NULL THEN 'bearish' ELSE 'neutral' END AS macd_state,
  concat_ws(' ', CASE WHEN trend_50 = 'above' AND trend_200 = 'above' THEN {quoted(T.BOTH_ABOVE)} WHEN trend_50 = 'below' AND trend_200 = 'below' THEN {quoted(T.BOTH_BELOW)} ELSE {quoted(T.MIXED)} END,
    'RSI at ' || format('{{:.1f}}', rsi) || CASE WHEN rsi > 70 THEN ' indicates overbought conditions.' WHEN rsi < 30 THEN ' indicates oversold conditions.' ELSE ' shows balanced momentum.' END,
    CASE WHEN macd > macd_signal THEN {quoted(T.MACD_UP)} WHEN macd IS NOT NULL THEN {quoted(T.MACD_DOWN)} END) AS interpretation
  FROM (SELECT *, CASE WHEN sma_50 IS NULL THEN 'unknown' WHEN close > sma_50 THEN 'above' ELSE 'below' END AS trend_50,
    CASE WHEN sma_200 IS NULL THEN 'unknown' WHEN close > sma_200 THEN 'above' ELSE 'below' END AS trend_200 FROM bundle)""", IND))
def signals(spark, sf):
    return T.signals(T.bundle(_bars(spark, sf)))


@query("c08_chart_windows", sql("prices", """SELECT symbol, bars, count(*) AS bar_count, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date,
  round(sum(adj_close), 4) AS close_sum, round(any_value(range_high), 6) AS range_high, round(any_value(range_low), 6) AS range_low
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS place, max(high) OVER (PARTITION BY symbol) AS range_high, min(low) OVER (PARTITION BY symbol) AS range_low FROM prices),
    (SELECT unnest([30, 90, 180, 365]) AS bars) WHERE place <= bars GROUP BY symbol, bars"""))
def chart_windows(spark, sf):
    return _rounded(T.chart_windows(_bars(spark, sf), [30, 90, 180, 365]), {"close_sum": 4, "range_high": 6, "range_low": 6})


@query("c09_sparkline", sql("prices", """SELECT symbol, string_agg(format('{:.4f}', adj_close), ',' ORDER BY date) AS closes FROM prices
  WHERE date >= (SELECT max(date) FROM prices) - 90 GROUP BY symbol"""))
def sparkline(spark, sf):
    prices = B.prices_daily(spark, sf)
    rows = T.sparkline(prices, prices.agg(F.max("date")).scalar(), 90)
    shown = F.transform("closes", lambda v: F.replace(F.format_number(v, 4), F.lit(","), F.lit("")))
    return rows.select("symbol", F.array_join(shown, ",").alias("closes"))


# ---- feeds as SQL -------------------------------------------------------------------------
def _text(value: str) -> str:
    return f"CAST(CAST(round({value}, 2) AS DECIMAL(24,2)) AS VARCHAR)"


QUARTERS = {
    "quarters": """SELECT *, CAST(regexp_extract(symbol, '(\\d+)', 1) AS INTEGER) + month(fiscal_date) + year(fiscal_date) AS tag FROM (
      SELECT p_brand AS symbol, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS fiscal_date, sum(l_extendedprice) AS amount, sum(l_quantity) AS quantity,
        sum(l_extendedprice * l_discount) AS discounted FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""}
EARNINGS = QUARTERS | {
    "surprises": f"""SELECT symbol, fiscal_date, fiscal_date + 30 AS reported_date, reported, estimated, reported - estimated AS surprise,
      CASE WHEN estimated = 0 THEN 0 ELSE (reported - estimated) / estimated * 100 END AS surprise_pct,
      CASE WHEN reported > estimated THEN 'beat' WHEN reported < estimated THEN 'miss' ELSE 'meet' END AS outcome
      FROM (SELECT symbol, fiscal_date, CASE WHEN tag % 11 <> 0 THEN CAST({_text('(amount - discounted) / quantity / 100')} AS DOUBLE) END AS reported,
        CASE WHEN tag % 13 = 0 THEN 0.0 WHEN tag % 17 <> 0 THEN CAST({_text('amount / quantity / 105')} AS DOUBLE) END AS estimated FROM quarters)
      WHERE reported IS NOT NULL AND estimated IS NOT NULL"""}


@query("c10_earnings_surprises", sql([], """SELECT symbol, CAST(fiscal_date AS VARCHAR) AS fiscal_date, CAST(reported_date AS VARCHAR) AS reported_date, reported, estimated,
  round(surprise, 6) + 0.0 AS surprise, round(surprise_pct, 6) + 0.0 AS surprise_pct, outcome FROM surprises""", EARNINGS))
def earnings_surprises(spark, sf):
    return _rounded(C.earnings_surprises(B.earnings_feed(spark, sf)), {"surprise": 6, "surprise_pct": 6})


@query("c10_beat_rates", sql([], """SELECT symbol, count(*) AS quarters, count(*) FILTER (outcome = 'beat') AS beats, count(*) FILTER (outcome = 'miss') AS misses,
  count(*) FILTER (outcome = 'meet') AS meets, round(count(*) FILTER (outcome = 'beat') * 100.0 / count(*), 4) AS beat_rate FROM surprises GROUP BY symbol""", EARNINGS))
def beat_rates(spark, sf):
    return _rounded(C.beat_rates(C.earnings_surprises(B.earnings_feed(spark, sf))), {"beat_rate": 4})


STATEMENTS = QUARTERS | {
    "facts": f"""SELECT symbol, fiscal_date, tag, period, CAST({_text('amount * 1000')} AS DOUBLE) AS revenue,
      CASE WHEN tag % 11 <> 0 THEN CAST({_text('discounted * 3000 - amount * 50')} AS DOUBLE) END AS income,
      CASE WHEN tag % 7 <> 0 THEN CASE WHEN tag % 5 = 0 THEN 0.0 ELSE CAST({_text('amount * 2500')} AS DOUBLE) END END AS equity,
      CASE WHEN tag % 9 <> 0 THEN CAST({_text('amount * 200')} AS DOUBLE) END AS operating, CASE WHEN tag % 9 <> 0 THEN CAST({_text('amount * -70')} AS DOUBLE) END AS capex
      FROM quarters, (SELECT unnest(['quarterly', 'annual']) AS period) WHERE period = 'quarterly' OR month(fiscal_date) = 10"""}


@query("c11_financial_ratios", sql([], """SELECT symbol, period, CAST(fiscal_date AS VARCHAR) AS fiscal_date, round(revenue / 1e9, 6) AS revenue_bn, round(income / 1e9, 6) + 0.0 AS net_income_bn,
  round(income / nullif(revenue, 0) * 100, 6) + 0.0 AS margin_pct, round((operating + capex) / 1e9, 6) + 0.0 AS free_cash_flow_bn, round(income / nullif(equity, 0) * 100, 6) + 0.0 AS roe_pct FROM facts""", STATEMENTS))
def financial_ratios(spark, sf):
    rows = C.financial_ratios(C.statement_table(B.statement_feed(spark, sf)))
    return _rounded(rows, {c: 6 for c in rows.columns if c.endswith(("_bn", "_pct"))})


@query("c12_statement_table", sql([], """SELECT symbol, 'income' AS kind, period, CAST(fiscal_date AS VARCHAR) AS fiscal_date, revenue AS first_value FROM facts
  UNION ALL SELECT symbol, 'balance', period, CAST(fiscal_date AS VARCHAR), equity FROM facts WHERE equity IS NOT NULL
  UNION ALL SELECT symbol, 'cash', period, CAST(fiscal_date AS VARCHAR), operating FROM facts WHERE operating IS NOT NULL""", STATEMENTS))
def statement_table(spark, sf):
    rows = C.statement_table(B.statement_feed(spark, sf))
    value = F.coalesce(*[F.try_element_at("data", F.lit(n)) for n in ("totalRevenue", "totalShareholderEquity", "operatingCashflow")])
    return rows.select("symbol", "kind", "period", "fiscal_date", value.try_cast("double").alias("first_value"))


NEWS = {
    "news": """SELECT doc_id AS article_id, 'Brand#' || (doc_id % 25 + 1) AS symbol, ((doc_id * 17) % 101 - 50) / 100 AS overall_sentiment_score,
      CAST(CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS DATE) AS TIMESTAMP) + to_hours(doc_id % 24) + to_minutes(15) AS published_at,
      CAST(CASE WHEN doc_id % 8 = 0 THEN 0.0 ELSE 0.5 END AS DOUBLE) AS relevance_score, CASE WHEN doc_id % 8 = 0 THEN 0.0 ELSE ((doc_id * 29) % 201 - 100) / 100 END AS ticker_score,
      CASE WHEN doc_id % 8 = 0 THEN 'Neutral' WHEN ((doc_id * 29) % 201 - 100) / 100 > 0.15 THEN 'Bullish' WHEN ((doc_id * 29) % 201 - 100) / 100 < -0.15 THEN 'Bearish' ELSE 'Neutral' END AS ticker_label,
      lang, source FROM documents"""}


@query("c13_parsed_news", sql([], """SELECT article_id, symbol, overall_sentiment_score, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, relevance_score, ticker_score, ticker_label,
  lang || ',' || source AS topics FROM news""", NEWS))
def parsed_news(spark, sf):
    return C.parsed_news(B.news_feed(spark, sf)).withColumn("topics", F.array_join("topics", ","))


@query("c14_sentiment_trend", sql([], "SELECT symbol, CAST(CAST(published_at AS DATE) AS VARCHAR) AS date, round(avg(ticker_score), 6) + 0.0 AS score, count(*) AS article_count FROM news GROUP BY ALL", NEWS))
def sentiment_trend(spark, sf):
    return _rounded(C.sentiment_trend(C.parsed_news(B.news_feed(spark, sf))), {"score": 6})


@query("c15_topic_distribution", sql([], "SELECT symbol, topic, count(*) AS articles FROM (SELECT symbol, unnest([lang, source]) AS topic FROM news) GROUP BY ALL", NEWS))
def topic_distribution(spark, sf):
    return C.topic_distribution(C.parsed_news(B.news_feed(spark, sf)))


@query("c16_sentiment_class", sql([], """SELECT symbol, round(avg(ticker_score), 6) + 0.0 AS score, count(*) AS articles,
  CASE WHEN avg(ticker_score) > 0.15 THEN 'bullish' WHEN avg(ticker_score) < -0.15 THEN 'bearish' ELSE 'neutral' END AS class
  FROM news WHERE lang IN ('en', 'src3') OR source IN ('en', 'src3') GROUP BY symbol""", NEWS))
def sentiment_class(spark, sf):
    return _rounded(C.sentiment_class(C.parsed_news(B.news_feed(spark, sf)), ["en", "src3"]), {"score": 6})


# ---- portfolio context --------------------------------------------------------------------
OVERVIEW = {"overview": f"""SELECT symbol, 'Company ' || no AS name, CASE WHEN no % 9 = 8 THEN 'Unknown' ELSE 'S' || (no % 5) END AS sector,
    CASE WHEN no % 6 <> 0 THEN CAST({_text('mean_price / (30 + 6 * (no % 7))')} AS DOUBLE) END AS pe, CASE WHEN no % 10 <> 0 THEN CAST({_text('(no % 4) * 0.06 + mean_size / 1000')} AS DOUBLE) END AS margin
  FROM (SELECT p_brand AS symbol, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS no, avg(p_retailprice) AS mean_price, avg(p_size) AS mean_size FROM part GROUP BY ALL)"""}
CONTEXT = HOLD | CONTRIB | {
    "context": """SELECT h.portfolio_id, h.symbol, CASE WHEN c.contribution IS NOT NULL THEN h.position END AS shares_held, coalesce(c.weight, 0) AS weight,
      coalesce(c.contribution, 0) AS contribution FROM holdings h LEFT JOIN contributions c ON c.portfolio_id = h.portfolio_id AND c.symbol = h.symbol AND c.period = '90d'"""}


def _all_roles(spark, sf):
    prices, portfolios, versions, positions = _roles(spark, sf)
    end = prices.agg(F.max("date")).scalar()
    held = H.valued_holdings(prices, portfolios, versions, positions)
    return prices, held, H.contributions(prices, portfolios, versions, positions, end), end


@query("c17_portfolio_context", sql(ROLES, "SELECT portfolio_id, symbol, round(shares_held, 8) AS shares_held, round(weight, 8) AS weight, round(contribution, 8) + 0.0 AS contribution FROM context", CONTEXT))
def portfolio_context(spark, sf):
    _, held, parts, _ = _all_roles(spark, sf)
    return _rounded(C.portfolio_context(held, parts), {"shares_held": 8, "weight": 8, "contribution": 8})


@query("c18_sector_overlap", sql(ROLES, """SELECT a.portfolio_id, o.sector, a.symbol, b.symbol AS other, round(b.weight, 8) AS other_weight FROM holdings a JOIN asked q ON q.portfolio_id = a.portfolio_id AND q.target = a.symbol JOIN overview o ON o.symbol = a.symbol
  JOIN (SELECT h.*, sector FROM holdings h JOIN overview USING (symbol)) b ON b.portfolio_id = a.portfolio_id AND b.sector = o.sector AND b.symbol <> a.symbol""", HOLD | ASKED | OVERVIEW))
def sector_overlap(spark, sf):
    _, held, _, _ = _all_roles(spark, sf)
    return _rounded(C.sector_overlap(held, B.overview_feed(spark, sf), asked_holdings(spark, sf, held).withColumnRenamed("target", "symbol")), {"other_weight": 8})


@query("c19_concentration_alerts", sql(ROLES, """SELECT portfolio_id, symbol, 'position_size' AS alert_type, symbol || ' represents ' || format('{:.1f}', weight * 100) || '% of your portfolio (>20%)' AS message, round(weight, 8) AS combined_weight, symbol AS holdings_involved FROM placed WHERE weight > 0.20
  UNION ALL SELECT portfolio_id, symbol, 'sector_overlap', sector || ' sector represents ' || format('{:.1f}', sector_weight * 100) || '% of portfolio', round(sector_weight, 8), array_to_string([symbol] || list_sort(list_filter(list_distinct(peers), lambda x: x <> symbol)), ', ') FROM placed WHERE sector <> 'Unknown' AND sector_weight > 0.30 AND n > 1""",
    HOLD | OVERVIEW | {"placed": """SELECT h.*, o.sector, sum(weight) OVER w AS sector_weight, count(*) OVER w AS n, list(symbol) OVER w AS peers FROM holdings h JOIN overview o USING (symbol) WINDOW w AS (PARTITION BY portfolio_id, o.sector)"""}))
def concentration_alerts(spark, sf):
    _, held, _, _ = _all_roles(spark, sf)
    alerts = C.concentration_alerts(held, B.overview_feed(spark, sf))
    return _rounded(alerts.withColumn("holdings_involved", F.array_join("holdings_involved", ", ")), {"combined_weight": 8})


HEALTH = CONTEXT | OVERVIEW | NEWS | {
    "trend": """SELECT symbol, CASE WHEN n < 2 THEN 12.5 WHEN l / f - 1 > 0.10 THEN 20 WHEN l / f - 1 > 0 THEN 15 WHEN l / f - 1 > -0.10 THEN 10 ELSE 5 END AS price_trend
      FROM (SELECT symbol, arg_min(adj_close, date) AS f, arg_max(adj_close, date) AS l, count(*) AS n FROM prices WHERE date >= (SELECT max(date) FROM prices) - 90 GROUP BY symbol)""",
    "mood": """SELECT symbol, 12.5 + 12.5 * avg(overall_sentiment_score) AS sentiment FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published_at DESC, article_id) AS place FROM news) WHERE place <= 10 GROUP BY symbol""",
    "health": """SELECT c.portfolio_id, c.symbol, 12.5 + CASE WHEN pe BETWEEN 10 AND 25 THEN 5 ELSE 0 END + CASE WHEN margin > 0.10 THEN 5 ELSE 0 END AS fundamentals,
      coalesce(price_trend, 12.5) AS price_trend, coalesce(sentiment, 12.5) AS sentiment,
      12.5 + CASE WHEN contribution > 0.05 THEN 7.5 WHEN contribution > 0 THEN 3.5 ELSE 0 END + CASE WHEN weight BETWEEN 0.05 AND 0.15 THEN 5 ELSE 0 END AS portfolio_impact
      FROM context c LEFT JOIN overview USING (symbol) LEFT JOIN trend USING (symbol) LEFT JOIN mood USING (symbol)"""}


@query("c20_health_scores", sql(ROLES, """SELECT portfolio_id, symbol, CAST(fundamentals AS DOUBLE) AS fundamentals, CAST(price_trend AS DOUBLE) AS price_trend, round(sentiment, 6) AS sentiment,
  CAST(portfolio_impact AS DOUBLE) AS portfolio_impact, round(fundamentals + price_trend + sentiment + portfolio_impact, 6) AS total FROM health""", HEALTH))
def health_scores(spark, sf):
    prices, held, parts, end = _all_roles(spark, sf)
    context = C.portfolio_context(held, parts)
    news = C.parsed_news(B.news_feed(spark, sf))
    rows = C.health_scores(context, B.overview_feed(spark, sf), C.trend_score(prices, end), C.sentiment_score(news))
    return _rounded(rows, {"sentiment": 6, "total": 6})


@query("c21_profitability", sql([], """SELECT symbol, margin, CASE WHEN margin > 0.15 THEN 'improving' WHEN margin > 0.05 THEN 'stable' WHEN margin IS NOT NULL THEN 'declining' END AS profitability,
  'moderate' AS leverage_risk, 'low' AS dilution_risk FROM overview""", OVERVIEW))
def profitability(spark, sf):
    return C.profitability(B.overview_feed(spark, sf))


@query("c22_company_header", sql(ROLES, """SELECT o.symbol, o.name, o.sector, round(price, 6) AS price, round(previous_price, 6) AS previous_price, round((price / previous_price - 1) * 100, 6) + 0.0 AS change_pct, coalesce(points, 0) AS points,
    portfolio_id, round(weight, 8) AS weight, round(contribution, 8) + 0.0 AS contribution
  FROM overview o LEFT JOIN (SELECT symbol, max(adj_close) FILTER (place = 1) AS price, max(adj_close) FILTER (place = 2) AS previous_price FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS place FROM prices) GROUP BY symbol) q USING (symbol)
  LEFT JOIN (SELECT symbol, count(*) AS points FROM prices WHERE date >= (SELECT max(date) FROM prices) - 30 GROUP BY symbol) s USING (symbol) LEFT JOIN context c USING (symbol)""", CONTEXT | OVERVIEW))
def company_header(spark, sf):
    prices, held, parts, end = _all_roles(spark, sf)
    rows = C.company_header(B.overview_feed(spark, sf), prices, T.sparkline(prices, end, 30), C.portfolio_context(held, parts))
    rows = rows.withColumn("points", F.coalesce(F.size("closes").cast("bigint"), F.lit(0))).drop("closes")
    return _rounded(rows, {"price": 6, "previous_price": 6, "change_pct": 6, "weight": 8, "contribution": 8})
