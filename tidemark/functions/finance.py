"""Window expressions for price series."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def trailing(window: WindowSpec, rows: int) -> WindowSpec:
    """The last `rows` rows up to the current one."""
    return window.rowsBetween(-(rows - 1), 0)


def when_full(value: Column, window: WindowSpec, rows: int) -> Column:
    """The value once `rows` rows exist, NULL before."""
    return F.when(F.count(F.lit(1)).over(trailing(window, rows)) >= rows, value)


def seeded_ema(value: Column, window: WindowSpec, rows: int) -> Column:
    """EMA that starts from the mean of the last `rows` values and then folds the same values.

    Its last value is linear in the inputs, so the fold is done over the short trailing array.
    """
    last = F.collect_list(value).over(trailing(window, rows))
    mean = F.avg(value).over(trailing(window, rows))
    weight = 2.0 / (rows + 1)
    folded = F.aggregate(last, mean, lambda acc, x: (x - acc) * F.lit(weight) + acc)
    return when_full(folded, window, rows)
