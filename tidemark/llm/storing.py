"""Written tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to a fresh folder below the session's shared folder and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """Marked for a sort-merge join, so that neither side of it is gathered in the driver.

    Left to itself, Spark takes the size of compressed files times a guess of its columns' widths, which may be a fiftieth of the truth, as after an
    explode; and a broadcast that is planned by it stays planned, whatever the stages below turn out to hold.
    """
    return df.hint("merge")


def small_or_shuffled(df: DataFrame, rows: int, known: int | None = None) -> DataFrame:
    """Marked for broadcast if it holds at most so many rows, by a count or by a bound that is known; else for a sort-merge join."""
    if known is None:
        known = df.limit(rows + 1).count()
    return F.broadcast(df) if known <= rows else shuffled(df)
