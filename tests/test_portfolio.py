"""NAV and scenario rules on literal portfolios, against plain loops."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tidemark.operators import holdings as H
from tidemark.operators import nav as N
from tidemark.operators import technicals as T

D = dt.date
PRICES = [("A", D(2024, 1, d), p) for d, p in [(1, 10.0), (2, 11.0), (3, 12.0), (4, 11.5), (5, 13.0)]] + [
    ("B", D(2024, 1, d), p) for d, p in [(1, 20.0), (2, 19.0), (4, 21.0), (5, 20.0)]]
VERSIONS = [(1, "w1", 1, dt.datetime(2024, 1, 1, 0, 0)), (1, "w2", 2, dt.datetime(2024, 1, 4, 15, 0)),
            (2, "q1", 1, dt.datetime(2024, 1, 2, 9, 0))]
POSITIONS = [("w1", "A", 0.6), ("w1", "B", 0.4), ("w2", "A", 0.3), ("w2", "B", 0.7), ("q1", "A", 10.0), ("q1", "B", 5.0)]


def roles(spark):
    prices = spark.createDataFrame(PRICES, "symbol string, date date, adj_close double")
    portfolios = spark.createDataFrame([(1, "weight"), (2, "quantity")], "portfolio_id int, allocation_type string")
    versions = spark.createDataFrame(
        VERSIONS, "portfolio_id int, version_id string, version_number int, effective_at timestamp_ntz")
    positions = spark.createDataFrame(POSITIONS, "version_id string, symbol string, value double")
    return prices, portfolios, versions, positions


def expected_weight_nav():
    price = {(s, d): p for s, d, p in PRICES}
    nav, out, days = 100.0, [], [D(2024, 1, d) for d in range(1, 6)]
    for i, day in enumerate(days):
        version = "w2" if day >= D(2024, 1, 4) else "w1"
        if i:
            move = 0.0
            for v, s, w in POSITIONS:
                a, b = price.get((s, days[i - 1])), price.get((s, day))
                if v == version and a and b:
                    move += w * (b - a) / a
            nav *= 1 + move
        out.append(nav)
    return out


def test_weight_chain_equals_loop(spark):
    rows = N.daily_nav(*roles(spark)).where("portfolio_id = 1").orderBy("date").collect()
    for row, want in zip(rows, expected_weight_nav(), strict=True):
        assert math.isclose(row.nav, want, rel_tol=1e-12)


def test_quantity_mode_and_returns(spark):
    rows = N.daily_metrics(N.daily_nav(*roles(spark))).where("portfolio_id = 2").orderBy("date").collect()
    assert [r.nav for r in rows] == [10 * 11 + 5 * 19, 120.0, 115 + 105, 130 + 100]  # day 3: no price for B
    assert rows[0].return_1d is None
    assert math.isclose(rows[1].drawdown, 1 - 120 / 205)
    assert all(r.volatility_30d is None for r in rows)


def test_midnight_version_excludes_same_day(spark):
    _, _, versions, _ = roles(spark)
    days = spark.createDataFrame([(1, D(2024, 1, d)) for d in (3, 4, 5)], "portfolio_id int, date date")
    at_day = {r.date.day: r.version_id for r in N.version_on_day(days, versions).collect()}
    midnight = {r.date.day: r.version_id for r in N.version_at_midnight(days, versions).collect()}
    assert at_day == {3: "w1", 4: "w2", 5: "w2"}
    assert midnight == {3: "w1", 4: "w1", 5: "w2"}


def test_scenario_weights_sum_to_one(spark):
    held = spark.createDataFrame([(1, "A", 0.25), (1, "B", 0.45), (1, "C", 0.30)], "portfolio_id int, symbol string, weight double")
    asked = held.selectExpr("portfolio_id", "symbol AS target", "explode(array('trim_25', 'trim_50', 'exit', 'add_10')) AS action")
    outcome = H.scenarios(held, asked)
    sums = outcome.groupBy("target", "action").agg(F.sum("new_weight").alias("s")).collect()
    assert len(sums) == 12 and all(math.isclose(r.s, 1.0) for r in sums)
    gone = outcome.where("action = 'exit'").where("symbol = target").count()
    assert gone == 0
    row = outcome.where("action = 'trim_50' and target = 'A' and symbol = 'B'").first()
    assert math.isclose(row.new_weight, 0.45 + 0.125 * 0.45 / 0.75)


def test_volatility_needs_thirty_returns(spark):
    start = D(2024, 1, 1)
    nav = [(1, "weight", start + dt.timedelta(days=i), 100.0 + (i % 3)) for i in range(32)]
    frame = spark.createDataFrame(nav, "portfolio_id int, allocation_type string, date date, nav double")
    rows = N.daily_metrics(frame).orderBy("date").collect()
    assert rows[29].volatility_30d is None and rows[30].volatility_30d is not None


def test_indicators_need_enough_bars(spark):
    bars = [("A", D(2024, 1, 1) + dt.timedelta(days=i), 10.0 + i, 9.0 + i, 9.5 + i) for i in range(49)]
    frame = spark.createDataFrame(bars, "symbol string, date date, high double, low double, close double")
    assert T.bundle(frame).count() == 0
    last = T.with_rsi(frame).orderBy(F.desc("date")).first()
    assert last.rsi == 100.0  # no losses
    assert T.with_rsi(frame).orderBy("date").collect()[13].rsi is None
