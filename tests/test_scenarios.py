"""The closed form of a scenario's impact against the grid of all weights."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.operators import holdings as H


def from_grid(weights, target, outcome, latest):
    """Impact of one request by its rows in the grid."""
    after = {s: n for s, n in outcome}
    old = sum(w for _, w in sorted(((-w, s), w) for s, w in weights.items())[:3])
    new = sum(n for _, n in sorted(((-n, s), n) for s, n in after.items())[:3])
    moved = abs(weights[target] - after.get(target, 0.0))
    v, d = (latest[0] or 0.0), (latest[1] or 0.0)
    return v, v * (1 - moved * 0.5), d, d * (1 - moved * 0.3), new - old


@pytest.mark.parametrize("seed,low", [(1, 0.0), (2, -0.4), (3, -1.0)])
def test_closed_form_equals_the_grid(spark, seed, low):
    rng = random.Random(seed)
    held = {p: {f"S{i}": round(rng.uniform(low, 1.0), rng.choice([2, 6])) for i in range(rng.randint(1, 9))} for p in range(40)}
    held[100], held[101], held[102], held[103] = {"A": 1.0}, {"A": 0.05, "B": -0.02, "C": 0.04}, {"A": -0.5, "B": -0.1}, {"A": 0.0, "B": 0.07, "C": -0.01, "D": -0.005, "E": 0.0}
    rows = [(p, s, float(w)) for p, own in held.items() for s, w in own.items()]
    holdings = spark.createDataFrame(rows, "portfolio_id int, symbol string, weight double")
    requests = holdings.select("portfolio_id", F.col("symbol").alias("target"), F.explode(F.array(*[F.lit(a) for a in V.SCENARIO_ACTIONS])).alias("action"))
    requests = requests.unionByName(requests.limit(7)).unionByName(spark.createDataFrame([(0, "unknown", "exit"), (999, "A", "exit")], "portfolio_id int, target string, action string"))
    latest_rows = [(p, 0.2 + p / 1000, -0.1 if p % 3 else None) for p in held if p % 4]
    latest = spark.createDataFrame(latest_rows, "portfolio_id int, volatility_30d double, drawdown double")
    grid = {}
    for r in H.scenarios(holdings, requests).collect():
        grid.setdefault((r.portfolio_id, r.target, r.action), []).append((r.symbol, r.new_weight))
    known = {p: (v, d) for p, v, d in latest_rows}
    want = {k: from_grid(held[k[0]], k[1], own, known.get(k[0], (None, None))) for k, own in grid.items()}
    got = {(r.portfolio_id, r.target, r.action): tuple(r)[3:] for r in H.scenario_impact(holdings, requests, latest).collect()}
    assert set(got) == set(want)
    for k, values in want.items():
        if 0 < abs(sum(w for s, w in held[k[0]].items() if s != k[1])) < 1e-9:
            continue  # the others cancel out but for rounding, so their factor is noise in either form
        assert got[k] == pytest.approx(values, abs=1e-9), k
