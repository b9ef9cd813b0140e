"""Registered queries over index observations, industry ranks and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.operators import correlation as C
from tidemark.operators import index_series as X
from tidemark.operators import industry_ranks as R
from tidemark.plans import bindings as B
from tidemark.plans.oracle_tables import (
    direction, negative, pick, positive, quoted, sql, sql_list, sql_map, status)
from tidemark.plans.registry import query
from tidemark.runtime import cut_lineage

HEADLINE_SQL = "CASE report_type WHEN 'Manufacturing' THEN 'Manufacturing PMI' ELSE 'Services PMI' END"
DATE = "CAST(report_date AS VARCHAR) AS report_date"


def _mentions(spark, sf):
    """The ranked mentions as a stored table: operators read them several times."""
    return cut_lineage(B.industry_status(spark, sf).drop("raw_industry"))


# ---- X ------------------------------------------------------------------------------------
REQUEST_SQL = """SELECT report_type, CASE month(report_date) % 6 WHEN 0 THEN month_year WHEN 1 THEN lower(month_year)
  WHEN 2 THEN strftime(report_date, '%b-%y') WHEN 3 THEN strftime(report_date, '%m/%Y') WHEN 4 THEN substr(month_year, 3)
  ELSE strftime(report_date, '%B') || ' 2044' END AS month_text, month(report_date) % 6 <> 5 AS found FROM reports"""


@query("x01_report_exists", sql("reports", f"SELECT DISTINCT report_type, month_text, found FROM ({REQUEST_SQL})"))
def report_exists(spark, sf):
    reports = B.reports(spark, sf)
    kind = F.month("report_date") % 6
    asked = (F.when(kind == 0, F.col("month_year")).when(kind == 1, F.lower("month_year"))
             .when(kind == 2, F.date_format("report_date", "MMM-yy"))
             .when(kind == 3, F.date_format("report_date", "MM/yyyy"))
             .when(kind == 4, F.substring("month_year", 3, 100))
             .otherwise(F.concat(F.date_format("report_date", "MMMM"), F.lit(" 2044"))))
    requests = reports.select("report_type", asked.alias("month_text")).distinct()
    return X.report_exists(requests, reports)


@query("x02_report_list", sql("reports", f"SELECT {DATE}, report_type, month_year, file_path FROM reports"))
def report_list(spark, sf):
    return X.report_list(B.reports(spark, sf)).select("report_date", "report_type", "month_year", "file_path")


@query("x02_report_types", sql("reports", "SELECT DISTINCT report_type FROM reports"))
def report_types(spark, sf):
    return X.report_types(B.reports(spark, sf))


@query("x03_month_records", sql(["reports", "index_obs"], f"""SELECT {DATE}, report_type, month_year,
  string_agg(index_name || '=' || format('{{:.1f}}', index_value) || ' ' || {direction('index_name', 'index_value')}, '; ' ORDER BY index_name) AS indices
  FROM reports JOIN index_obs USING (report_date, report_type)
  WHERE report_date >= (SELECT max(report_date) FROM index_obs) - 30 * 24 GROUP BY ALL"""))
def month_records(spark, sf):
    obs = B.index_obs(spark, sf)
    newest = obs.agg(F.max("report_date")).scalar()
    nested = X.month_records(B.reports(spark, sf), obs, 24, newest)
    line = F.transform(F.array_sort(F.map_entries("indices")), lambda e: F.concat(
        e["key"], F.lit("="), F.format_number(e["value"]["value"], 1), F.lit(" "), e["value"]["direction"]))
    return nested.select("report_date", "report_type", "month_year", F.array_join(line, "; ").alias("indices"))


def _heatmap_sql(report_type: str) -> str:
    names = V.MANUFACTURING_INDICES if report_type == "Manufacturing" else V.SERVICES_INDICES
    short = {full: s for s, full in V.SHORT_NAMES.items()}
    cells = ", ".join(
        f"max(CASE WHEN index_name = {quoted(n)} THEN index_value END) AS \"{short.get(n, n)}\"" for n in names)
    return sql("index_obs", f"""SELECT strftime(report_date, '%m/%d/%Y') AS "Month", {cells}
      FROM index_obs WHERE report_type = '{report_type}' GROUP BY report_date""")


@query("x04_heatmap_manufacturing", _heatmap_sql("Manufacturing"))
def heatmap_manufacturing(spark, sf):
    return X.heatmap(B.index_obs(spark, sf), "Manufacturing")


@query("x04_heatmap_services", _heatmap_sql("Services"))
def heatmap_services(spark, sf):
    return X.heatmap(B.index_obs(spark, sf), "Services")


@query("x05_series_with_change", sql("index_obs", f"""SELECT report_type, index_name, {DATE}, index_value,
  {direction('index_name', 'index_value')} AS direction, round(index_value - lag(index_value) OVER
    (PARTITION BY report_type, index_name ORDER BY t.report_date), 1) + 0.0 AS change
  FROM (SELECT *, row_number() OVER (PARTITION BY report_type, index_name ORDER BY report_date DESC) AS rn FROM index_obs) t
  WHERE rn <= 36"""))
def series_with_change(spark, sf):
    return X.series_with_change(B.index_obs(spark, sf), 36)


MATRIX_SQL = {
    "months": """SELECT report_type, report_date, row_number() OVER (PARTITION BY report_type ORDER BY report_date DESC) AS month_place
      FROM (SELECT DISTINCT report_type, report_date FROM industry_status) QUALIFY month_place <= 12""",
    "seen": "SELECT DISTINCT report_type, index_name, industry_name FROM industry_status",
    "canon": f"""SELECT 'Manufacturing' AS report_type, unnest({sql_list(V.MANUFACTURING_INDUSTRIES)}) AS industry_name, unnest(range(0, 18)) AS list_position
      UNION ALL SELECT 'Services', unnest({sql_list(V.SERVICES_INDUSTRIES)}), unnest(range(0, 18))""",
    "padded": """SELECT * FROM seen UNION SELECT s.report_type, s.index_name, c.industry_name
      FROM (SELECT DISTINCT report_type, index_name FROM seen) s JOIN canon c USING (report_type)""",
}


def _matrix_body(source: str) -> str:
    return f"""SELECT CAST(m.report_date AS VARCHAR) AS report_date, g.report_type, g.index_name, g.industry_name, month_place,
      CASE WHEN category IS NULL THEN 'Neutral' ELSE {status('g.index_name', 'category')} END AS status,
      coalesce(category, 'Not Reported') AS category, coalesce(rank, 0) AS rank
      FROM {source} g JOIN months m USING (report_type) LEFT JOIN industry_status i ON i.report_date = m.report_date
        AND i.report_type = g.report_type AND i.index_name = g.index_name AND i.industry_name = g.industry_name"""


@query("x06_status_matrix", sql("industry_status", _matrix_body("seen"), MATRIX_SQL))
def status_matrix(spark, sf):
    return R.status_matrix(_mentions(spark, sf), 12)


@query("x07_padded_matrix", sql("industry_status", _matrix_body("padded"), MATRIX_SQL))
def padded_matrix(spark, sf):
    return R.status_matrix(_mentions(spark, sf), 12, padded=True)


@query("x08_latest_ranks", sql("industry_status", f"""SELECT {DATE}, report_type, index_name, industry_name, rank FROM industry_status
  QUALIFY industry_status.report_date = max(industry_status.report_date) OVER (PARTITION BY report_type)"""))
def latest_ranks(spark, sf):
    return R.latest_ranks(_mentions(spark, sf))


@query("x09_index_names", sql("index_obs", f"""SELECT report_type, index_name, row_number() OVER (PARTITION BY report_type
  ORDER BY CASE WHEN index_name = {HEADLINE_SQL} THEN 0 ELSE 1 END, index_name) AS position
  FROM (SELECT DISTINCT report_type, index_name FROM index_obs)"""))
def index_names(spark, sf):
    return X.index_names(B.index_obs(spark, sf))


_MONTH_COLS = ", ".join(f"max(CASE WHEN month_place = {i} THEN status END) AS month_{i}" for i in range(1, 7))


@query("x10_alphabetical_matrix", sql("industry_status", f"""SELECT report_type, index_name, industry_name, {_MONTH_COLS},
  row_number() OVER (PARTITION BY report_type, index_name ORDER BY industry_name) AS line FROM matrix GROUP BY report_type, index_name, industry_name""",
    MATRIX_SQL | {"matrix": _matrix_body("seen")}))
def alphabetical_matrix(spark, sf):
    return R.alphabetical_matrix(_mentions(spark, sf), 6)


SIGNED_SQL = {"canon": MATRIX_SQL["canon"], "sided": f"""SELECT *, CASE WHEN category = {positive('index_name')} THEN 1 ELSE -1 END AS side FROM industry_status""",
    "signed": """SELECT *, side * (count(*) OVER w - row_number() OVER (PARTITION BY report_date, report_type, index_name, side ORDER BY rank) + 1) AS signed_rank
      FROM sided WINDOW w AS (PARTITION BY report_date, report_type, index_name, side)""",
    "grid": """SELECT k.report_date, k.report_type, k.index_name, c.industry_name, c.list_position, CAST(coalesce(s.signed_rank, 0) AS INTEGER) AS signed_rank
      FROM (SELECT DISTINCT report_date, report_type, index_name FROM industry_status) k JOIN canon c USING (report_type)
      LEFT JOIN signed s USING (report_date, report_type, index_name, industry_name)"""}


@query("x11_signed_ranks", sql("industry_status", f"""SELECT CAST(report_date AS VARCHAR) AS report_date, report_type, index_name, industry_name, list_position, signed_rank,
  max(signed_rank) OVER w AS max_rank, min(signed_rank) OVER w AS min_rank FROM grid WINDOW w AS (PARTITION BY grid.report_date, report_type, index_name)""", SIGNED_SQL))
def signed_ranks(spark, sf):
    return R.signed_ranks(_mentions(spark, sf))


_LAYOUT_COLS = ", ".join(
    f"max(CASE WHEN month_place = {i} THEN industry_name END) AS industry_{i}, max(CASE WHEN month_place = {i} THEN signed_rank END) AS rank_{i}"
    for i in range(1, 4))


@query("x12_ranking_layout", sql("industry_status", f"""SELECT report_type, index_name, line, reference, {_LAYOUT_COLS}
  FROM (SELECT g.*, m.month_place, row_number() OVER (PARTITION BY g.report_date, g.report_type, g.index_name ORDER BY signed_rank DESC, list_position) AS line
    FROM grid g JOIN months m ON g.report_date = m.report_date AND g.report_type = m.report_type WHERE month_place <= 3)
  JOIN (SELECT report_type, industry_name AS reference, row_number() OVER (PARTITION BY report_type ORDER BY industry_name) AS line FROM canon) USING (report_type, line)
  GROUP BY report_type, index_name, line, reference""", SIGNED_SQL | {"months": MATRIX_SQL["months"]}))
def ranking_layout(spark, sf):
    return R.ranking_layout(R.signed_ranks(_mentions(spark, sf)), 3)


@query("x13_glance_rows", sql("index_obs", f"""SELECT CAST(report_date AS VARCHAR) AS report_date, report_type, index_name,
    CASE WHEN index_value IS NULL THEN 'N/A' ELSE format('{{:.1f}}', index_value) || ' (' || {direction('index_name', 'index_value')} || ')' END AS cell FROM cells
  UNION ALL SELECT CAST(report_date AS VARCHAR), report_type, unnest(['OVERALL ECONOMY', upper(report_type) || ' SECTOR']),
    CASE WHEN index_value IS NULL THEN 'N/A' WHEN index_value >= 50 THEN 'Growing' ELSE 'Contracting' END
    FROM cells WHERE index_name = {HEADLINE_SQL}""",
    {"expected": f"SELECT 'Manufacturing' AS report_type, unnest({sql_list(V.MANUFACTURING_INDICES)}) AS index_name UNION ALL SELECT 'Services', unnest({sql_list(V.SERVICES_INDICES)})",
     "cells": """SELECT m.report_date, m.report_type, e.index_name, o.index_value FROM (SELECT DISTINCT report_date, report_type FROM index_obs) m
       JOIN expected e USING (report_type) LEFT JOIN index_obs o USING (report_date, report_type, index_name)"""}))
def glance_rows(spark, sf):
    obs = B.index_obs(spark, sf)
    head = X.is_headline(F.col("report_type"), F.col("index_name"))
    fresh = obs.where(~(head & (F.month("report_date") % 3 == 0)))
    return X.glance_rows(fresh, stored=obs)


@query("x14_index_listing", sql("industry_status", f"""SELECT {DATE}, report_type, index_name, row_number() OVER (
    PARTITION BY s.report_date, report_type, index_name ORDER BY CASE WHEN category = {positive('index_name')} THEN 0 ELSE 1 END, rank) AS line,
  industry_name || ' - ' || category AS entry FROM industry_status s"""))
def index_listing(spark, sf):
    return R.index_listing(_mentions(spark, sf))


MOVERS_SQL = {"movers": f"""SELECT report_type, index_name, c.report_date, c.index_value AS current_value, p.index_value AS previous_value,
    c.index_value - p.index_value AS change, {direction('index_name', 'c.index_value')} AS direction
  FROM (SELECT * FROM index_obs QUALIFY dense_rank() OVER (PARTITION BY report_type ORDER BY report_date DESC) = 1) c
  JOIN (SELECT * FROM index_obs QUALIFY dense_rank() OVER (PARTITION BY report_type ORDER BY report_date DESC) = 2) p USING (report_type, index_name)
  WHERE abs(c.index_value - p.index_value) >= 1.0"""}


@query("x15_significant_movers", sql("index_obs", f"""SELECT {DATE}, report_type, index_name, current_value, previous_value, change, direction,
  index_name || CASE WHEN change > 0 THEN ' rose ' ELSE ' fell ' END || format('{{:.1f}}', abs(change)) || ' points to ' ||
  format('{{:.1f}}', current_value) || ' in ' || strftime(movers.report_date, '%B %Y') AS description FROM movers""", MOVERS_SQL))
def significant_movers(spark, sf):
    return X.significant_movers(B.index_obs(spark, sf))


def _templates_sql() -> str:
    def row(t: str) -> str:
        out = quoted(t)
        for mark, value in (("{n}", "index_name"), ("{l}", "lower(index_name)"), ("{d}", "move"),
                            ("{m}", "'July'"), ("{y}", "'2024'")):
            out = f"replace({out}, '{mark}', {value})"
        return out
    rows = "[" + ", ".join(row(t) for t in X.QUERY_TEMPLATES[:4]) + "]"
    return (f"SELECT report_type, index_name, unnest(range(0, 4)) AS position, unnest({rows}) AS phrase "
            "FROM (SELECT *, CASE WHEN change > 0 THEN 'increase' ELSE 'decrease' END AS move FROM movers)")


@query("x16_mover_queries", sql("index_obs", _templates_sql(), MOVERS_SQL))
def mover_queries(spark, sf):
    return X.mover_queries(X.significant_movers(B.index_obs(spark, sf)), F.lit("2024-07-15").cast("date"))


# ---- K ------------------------------------------------------------------------------------
SERIES = {"series": "SELECT * FROM index_obs QUALIFY row_number() OVER (PARTITION BY report_type, index_name ORDER BY report_date DESC) <= 60"}
# every series that stood at 60 or more in some month is asked for
ASKED = {"asked": "SELECT DISTINCT report_type, index_name FROM index_obs WHERE index_value >= 60"}
PAIRS = SERIES | ASKED | {"pairs": """SELECT a.report_type AS type_a, a.index_name AS index_a, b.report_type AS type_b, b.index_name AS index_b,
    report_date, a.index_value AS value_a, b.index_value AS value_b,
    row_number() OVER (PARTITION BY a.report_type, a.index_name, b.report_type, b.index_name ORDER BY report_date) AS position
  FROM series a JOIN series b USING (report_date) WHERE (a.report_type, a.index_name) <> (b.report_type, b.index_name)
    AND (a.report_type, a.index_name) IN (SELECT (report_type, index_name) FROM asked)"""}
EQUIV = sql_map(V.EQUIVALENT_INDICES)
CROSS = SERIES | {"pairs": f"""SELECT a.report_type AS type_a, a.index_name AS index_a, b.report_type AS type_b, b.index_name AS index_b,
    report_date, a.index_value AS value_a, b.index_value AS value_b,
    row_number() OVER (PARTITION BY a.report_type, a.index_name, b.report_type, b.index_name ORDER BY report_date) AS position
  FROM series a JOIN series b USING (report_date) WHERE a.report_type = 'Manufacturing' AND b.report_type = 'Services'
    AND (a.index_name = b.index_name OR coalesce({EQUIV}[a.index_name] = b.index_name, false) OR coalesce({EQUIV}[b.index_name] = a.index_name, false))"""}
# p-value by Simpson's rule: P = 1 - integral of cos^(df-1) over [0, asin|r|] / the same over [0, pi/2]
_STEPS = 4000


def _integral(top: str) -> str:
    return f"""(list_sum(list_transform(range(0, {_STEPS + 1}), lambda k:
      (CASE WHEN k = 0 OR k = {_STEPS} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos({top} * k / {_STEPS}.0), n - 3))) * {top} / {_STEPS * 3}.0)"""


CORR = {"correlations": f"""SELECT type_a, index_a, type_b, index_b, n, CASE WHEN n >= 3 THEN round(r, 3) + 0.0 END AS correlation,
    CASE WHEN n >= 3 THEN CASE WHEN abs(r) >= 1 THEN 0.0 ELSE round(1 - {_integral('asin(abs(r))')} / {_integral('(pi() / 2)')}, 4) END END AS p_value
  FROM (SELECT type_a, index_a, type_b, index_b, count(*) AS n, corr(value_a, value_b) AS r FROM pairs GROUP BY ALL)"""}
_LAG_ROWS = " UNION ALL ".join(
    f"""SELECT type_a, index_a, type_b, index_b, {lag} AS lag, CASE WHEN count(*) >= 3 THEN {'round(corr(value_a, other), 3) + 0.0' if lag else 'corr(value_a, other)'} END AS correlation
    FROM (SELECT p.type_a, p.index_a, p.type_b, p.index_b, p.value_a, q.value_b AS other FROM pairs p JOIN pairs q
      ON p.type_a = q.type_a AND p.index_a = q.index_a AND p.type_b = q.type_b AND p.index_b = q.index_b AND q.position = p.position + ({lag})) GROUP BY ALL"""
    for lag in range(-3, 4))
PROFILE = {"profile": _LAG_ROWS}


def _series(spark, sf):
    """The newest rows of every series, written once: both sides of the pairs read them."""
    return cut_lineage(C.newest_series(B.index_obs(spark, sf), 60))


def _pairs(spark, sf):
    asked = B.index_obs(spark, sf).where(F.col("index_value") >= 60).select("report_type", "index_name").distinct()
    return C.aligned_pairs(_series(spark, sf), asked)


def _cross(spark, sf):
    return C.cross_type_pairs(_series(spark, sf))


@query("k01_newest_series", sql("index_obs", f"SELECT {DATE}, report_type, index_name, index_value FROM series", SERIES))
def newest_series(spark, sf):
    return C.newest_series(B.index_obs(spark, sf), 60)


@query("k02_aligned_pairs", sql("index_obs", "SELECT type_a, index_a, type_b, index_b, CAST(report_date AS VARCHAR) AS report_date, value_a, value_b, position FROM pairs", PAIRS))
def aligned_pairs(spark, sf):
    return _pairs(spark, sf)


@query("k03_pair_correlation", sql("index_obs", "SELECT * FROM correlations", PAIRS | CORR))
def pair_correlation(spark, sf):
    return C.pair_correlation(_pairs(spark, sf))


@query("k04_lag_profile", sql("index_obs", "SELECT type_a, index_a, type_b, index_b, lag, round(correlation, 6) + 0.0 AS correlation FROM profile", PAIRS | PROFILE))
def lag_profile(spark, sf):
    return C.lag_profile(_pairs(spark, sf)).withColumn("correlation", F.round("correlation", 6) + F.lit(0.0))


@query("k05_cross_type_matrix", sql("index_obs", "SELECT * FROM correlations", CROSS | CORR))
def cross_type_matrix(spark, sf):
    return C.pair_correlation(_cross(spark, sf))


@query("k05_cross_type_lags", sql("index_obs", "SELECT type_a, index_a, type_b, index_b, lag, round(correlation, 6) + 0.0 AS correlation FROM profile", CROSS | PROFILE))
def cross_type_lags(spark, sf):
    return C.lag_profile(_cross(spark, sf)).withColumn("correlation", F.round("correlation", 6) + F.lit(0.0))


@query("k06_partners", sql("index_obs", """SELECT *, row_number() OVER (PARTITION BY type_a, index_a ORDER BY abs(correlation) DESC, type_b, index_b) AS place FROM correlations
  WHERE abs(correlation) >= 0.15""", PAIRS | CORR))
def partners(spark, sf):
    return C.partners(C.pair_correlation(_pairs(spark, sf)), 0.15)


@query("k07_index_names", sql("index_obs", "SELECT DISTINCT report_type, index_name FROM index_obs"))
def distinct_names(spark, sf):
    return B.index_obs(spark, sf).select("report_type", "index_name").distinct()


@query("k08_highlights", sql("index_obs", """SELECT m.*, b.best_leading, b.leading_pair FROM (
    SELECT max(correlation) FILTER (correlation > 0) AS strongest_positive,
      arg_max(index_a || ' & ' || index_b, (correlation, index_a, index_b)) FILTER (correlation > 0) AS positive_pair,
      min(correlation) FILTER (correlation < 0) AS strongest_negative,
      arg_min(index_a || ' & ' || index_b, (correlation, index_a, index_b)) FILTER (correlation < 0) AS negative_pair FROM correlations) m,
  (SELECT arg_max(correlation, (abs(correlation), index_a, index_b, lag)) AS best_leading,
      arg_max(CASE WHEN lag > 0 THEN index_a || ' leads ' || index_b || ' by ' || lag || ' month(s)'
        ELSE index_b || ' leads ' || index_a || ' by ' || (-lag) || ' month(s)' END, (abs(correlation), index_a, index_b, lag)) AS leading_pair
    FROM profile WHERE lag <> 0 AND abs(correlation) > 0.7) b""", CROSS | CORR | PROFILE))
def highlights(spark, sf):
    pairs = _cross(spark, sf)
    return C.highlights(C.pair_correlation(pairs), C.lag_profile(pairs))


@query("k09_interpretation", sql("index_obs", """SELECT c.type_a, c.index_a, c.type_b, c.index_b, correlation, p_value,
    CASE WHEN correlation IS NULL THEN 'insufficient data' WHEN abs(correlation) > 0.8 THEN 'very strong' WHEN abs(correlation) > 0.6 THEN 'strong'
      WHEN abs(correlation) > 0.4 THEN 'moderate' WHEN abs(correlation) > 0.2 THEN 'weak' ELSE 'very weak or no' END AS strength,
    CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS direction,
    CASE WHEN p_value < 0.01 THEN 'highly statistically significant' WHEN p_value < 0.05 THEN 'statistically significant'
      WHEN p_value < 0.1 THEN 'marginally significant' ELSE 'not statistically significant' END AS significance,
    CASE WHEN best_size > abs(correlation) THEN best_lag ELSE 0 END AS best_lag
  FROM correlations c LEFT JOIN (SELECT type_a, index_a, type_b, index_b, arg_max(lag, (abs(correlation), -lag)) AS best_lag, max(abs(correlation)) AS best_size
    FROM profile WHERE lag <> 0 AND correlation IS NOT NULL GROUP BY ALL) l USING (type_a, index_a, type_b, index_b)""", PAIRS | CORR | PROFILE))
def interpretation(spark, sf):
    pairs = _pairs(spark, sf)
    return C.interpretation(C.pair_correlation(pairs), C.lag_profile(pairs))


@query("k10_ranked_matrix", sql("index_obs", "SELECT * FROM correlations WHERE correlation IS NOT NULL", CROSS | CORR))
def ranked_matrix(spark, sf):
    return C.ranked_matrix(C.pair_correlation(_cross(spark, sf)))
