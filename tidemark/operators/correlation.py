"""Correlation of index series: pairs, lag profiles, cross-type matrix, highlights.

Pairs come from requests: each requested series meets every other one, so the rows grow with the requests.
A pair holds one row per common month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.stats import correlation_p_value
from tidemark.functions.text import lookup

PAIR = ["type_a", "index_a", "type_b", "index_b"]
LAGS = range(-3, 4)


def newest_series(observations: DataFrame, newest: int) -> DataFrame:
    """The newest N rows of every (type, index)."""
    recent = W.partitionBy("report_type", "index_name").orderBy(F.desc("report_date"))
    return observations.withColumn("place", F.row_number().over(recent)).where(
        F.col("place") <= newest).drop("place")


def _side(series: DataFrame, tag: str, *more: str) -> DataFrame:
    return series.select(F.col("report_date"), *more, F.col("report_type").alias(f"type_{tag}"),
                         F.col("index_name").alias(f"index_{tag}"), F.col("index_value").alias(f"value_{tag}"))


def aligned_pairs(series: DataFrame, requests: DataFrame) -> DataFrame:
    """Each requested series (report_type, index_name) with every other one on their common dates, numbered in date order."""
    a = _side(series.join(requests.select("report_type", "index_name").distinct(), ["report_type", "index_name"], "left_semi"), "a")
    b = _side(series, "b")
    joined = a.join(b, "report_date").where(F.struct("type_a", "index_a") != F.struct("type_b", "index_b"))
    return joined.withColumn(
        "position", F.row_number().over(W.partitionBy(*PAIR).orderBy("report_date")))


def cross_type_pairs(series: DataFrame) -> DataFrame:
    """Manufacturing against Services series of comparable names on common dates.

    Joined on the date and the name that a quantity has in both types.
    """
    named = series.withColumn("quantity", F.coalesce(lookup(F.col("index_name"), V.EQUIVALENT_INDICES), F.col("index_name")))
    sides = [_side(rows, tag, "quantity") for rows, tag in (
        (named.where(F.col("report_type") == "Manufacturing"), "a"), (named.where(F.col("report_type") == "Services"), "b"))]
    joined = sides[0].join(sides[1], ["report_date", "quantity"]).drop("quantity")
    return joined.withColumn(
        "position", F.row_number().over(W.partitionBy(*PAIR).orderBy("report_date")))


def pair_correlation(pairs: DataFrame) -> DataFrame:
    """Pearson r (3 digits), two-sided p (4 digits) and n per pair; NULL below three points."""
    raw = pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.corr("value_a", "value_b").alias("r"))
    r = F.when((F.col("n") >= 3) & ~F.isnan("r"), F.col("r"))
    return raw.select(*PAIR, "n", (F.round(r, 3) + F.lit(0.0)).alias("correlation"),
                      F.round(correlation_p_value(r, F.col("n")), 4).alias("p_value"))


def lag_profile(pairs: DataFrame) -> DataFrame:
    """Correlation at lags -3 ... 3 of positions; lag L > 0 means series a leads by L."""
    order = W.partitionBy(*PAIR).orderBy("position")
    shifted = pairs.select(
        *PAIR, "value_a", "value_b",
        *[F.lead("value_b", k).over(order).alias(f"b_{k}") for k in (1, 2, 3)],
        *[F.lead("value_a", k).over(order).alias(f"a_{k}") for k in (1, 2, 3)])

    def one(lag: int) -> Column:
        left = "value_a" if lag >= 0 else f"a_{-lag}"
        right = f"b_{lag}" if lag > 0 else "value_b"
        both = F.col(left).isNotNull() & F.col(right).isNotNull()
        r = F.corr(F.when(both, F.col(left)), F.when(both, F.col(right)))
        r = F.when((F.sum(both.cast("int")) >= 3) & ~F.isnan(r), r)
        return r if lag == 0 else F.round(r, 3) + F.lit(0.0)

    wide = shifted.groupBy(*PAIR).agg(*[one(lag).alias(f"lag_{lag + 3}") for lag in LAGS])
    entries = F.array(*[F.struct(F.lit(lag).alias("lag"), F.col(f"lag_{lag + 3}").alias("correlation"))
                        for lag in LAGS])
    return wide.select(*PAIR, F.inline(entries))


def partners(correlations: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The partners of each requested series with |r| at or above the threshold, strongest first."""
    strong = correlations.select(*PAIR, "n", "correlation", "p_value").where(F.abs("correlation") >= threshold)
    order = W.partitionBy("type_a", "index_a").orderBy(F.desc(F.abs("correlation")), "type_b", "index_b")
    return strong.withColumn("place", F.row_number().over(order))


def highlights(correlations: DataFrame, profile: DataFrame) -> DataFrame:
    """One row: strongest positive, strongest negative and best leading pair."""
    label = F.concat_ws(" & ", "index_a", "index_b")
    r = F.col("correlation")
    key = F.struct(r, F.col("index_a"), F.col("index_b"))
    main = correlations.agg(
        F.max(F.when(r > 0, r)).alias("strongest_positive"),
        F.max_by(label, F.when(r > 0, key)).alias("positive_pair"),
        F.min(F.when(r < 0, r)).alias("strongest_negative"),
        F.min_by(label, F.when(r < 0, key)).alias("negative_pair"))
    lag = F.col("lag")
    text = F.when(lag > 0, F.concat(F.col("index_a"), F.lit(" leads "), F.col("index_b"), F.lit(" by "),
                                    lag.cast("string"), F.lit(" month(s)"))).otherwise(
        F.concat(F.col("index_b"), F.lit(" leads "), F.col("index_a"), F.lit(" by "),
                 F.abs(lag).cast("string"), F.lit(" month(s)")))
    leading = (lag != 0) & (F.abs(r) > 0.7)
    strength = F.when(leading, F.struct(F.abs(r), F.col("index_a"), F.col("index_b"), lag))
    best = profile.agg(F.max_by(r, strength).alias("best_leading"), F.max_by(text, strength).alias("leading_pair"))
    both = main.unionByName(best, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def interpretation(correlations: DataFrame, profile: DataFrame) -> DataFrame:
    """Strength and significance words, and the best lag where it beats lag 0."""
    size = F.abs("correlation")
    lagged = profile.where((F.col("lag") != 0) & F.col("correlation").isNotNull()).groupBy(*PAIR).agg(
        F.max_by("lag", F.struct(F.abs("correlation"), -F.col("lag"))).alias("best_lag"),
        F.max(F.abs("correlation")).alias("best_size"))
    joined = correlations.join(lagged, PAIR, "left")
    return joined.select(
        *PAIR, "correlation", "p_value",
        F.when(F.col("correlation").isNull(), "insufficient data").when(size > 0.8, "very strong")
        .when(size > 0.6, "strong").when(size > 0.4, "moderate").when(size > 0.2, "weak")
        .otherwise("very weak or no").alias("strength"),
        F.when(F.col("correlation") > 0, "positive").otherwise("negative").alias("direction"),
        F.when(F.col("p_value") < 0.01, "highly statistically significant")
        .when(F.col("p_value") < 0.05, "statistically significant")
        .when(F.col("p_value") < 0.1, "marginally significant")
        .otherwise("not statistically significant").alias("significance"),
        F.when(F.col("best_size") > size, F.col("best_lag")).otherwise(0).alias("best_lag"))


def ranked_matrix(correlations: DataFrame) -> DataFrame:
    """Pairs by |r|, NULLs dropped."""
    return correlations.where(F.col("correlation").isNotNull()).orderBy(F.desc(F.abs("correlation")))
