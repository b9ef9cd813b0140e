"""Statistics that Spark has no built-in for."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a Pearson r over n pairs (Student t with n - 2 degrees of freedom).

    For whole degrees of freedom the distribution has a finite series (Abramowitz & Stegun
    26.7.3 and 26.7.4); with theta = asin|r| it is folded over its terms inside the JVM.
    """
    df = (n - 2).cast("int")
    odd = df % 2 == 1
    size = F.least(F.abs(r), F.lit(1.0))
    cos2 = F.lit(1.0) - size * size
    terms = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))

    def fold(acc: Column, k: Column) -> Column:
        first = F.when(odd, F.sqrt(cos2)).otherwise(F.lit(1.0))
        ratio = F.when(odd, (2 * k - 2) / (2 * k - 1)).otherwise((2 * k - 3) / (2 * k - 2))
        term = F.when(k == 1, first).otherwise(acc["term"] * ratio * cos2)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    zero = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("total"))
    total = F.aggregate(steps, zero, fold, lambda acc: acc["total"])
    inside = F.when(odd, F.lit(2 / math.pi) * (F.asin(size) + size * total)).otherwise(size * total)
    return (
        F.when(r.isNull() | (n < 3), F.lit(None).cast("double"))
        .when(size >= 1.0, F.lit(0.0))
        .otherwise(F.greatest(F.lit(1.0) - inside, F.lit(0.0)))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 when either has no length or is missing."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))
