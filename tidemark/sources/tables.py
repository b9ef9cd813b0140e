"""Keyed tables on shared storage: upserts, logs, exports, deletions, schema evolution."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def last_write_wins(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the highest version of every key.

    A max_by aggregation combines map-side, so a key rewritten very often is not a hot task.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("row_"))
    return best.select(*keys, "row_.*").select(*rows.columns)


def merged(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    return last_write_wins(old.unionByName(new), keys, version)


def _batch_mark(spark: SparkSession, path: str, batch: str) -> tuple[Any, Any]:
    """The file system of a table and the empty file beside its rows that says that a batch is in; Spark's readers pass over such names."""
    context = spark.sparkContext
    mark = context._jvm.org.apache.hadoop.fs.Path(f"{path}/_batches/{batch}")
    return mark.getFileSystem(context._jsc.hadoopConfiguration()), mark


def upsert(new: DataFrame, path: str, keys: list[str], version: str, partition: str, batch: str | None = None) -> None:
    """Merges rows into a partitioned Parquet table; only touched partitions are read and rewritten.

    A batch that is named is marked once its rows are in, and skipped when it is replayed. One that failed before its mark is merged again, which gives
    the same rows.
    """
    spark = new.sparkSession
    if batch is not None:
        files, mark = _batch_mark(spark, path, batch)
        if files.exists(mark):
            return
    try:
        old = spark.read.parquet(path)
    except Exception as error:  # an absent table is an empty one, anything else is a failure
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        old = None
    rows = last_write_wins(new, keys, version)
    if old is not None:
        touched = new.select(partition).distinct()
        kept = old.join(touched, partition, "left_semi").select(*new.columns)
        rows = merged(kept, new, keys, version)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    if batch is not None:
        files.create(mark, True).close()


def missing_dimension_rows(new: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Keys (upper-cased) that the dimension does not know yet."""
    wanted = new.select(F.upper(key).alias(key)).distinct()
    return wanted.join(dimension.select(F.upper(key).alias(key)).distinct(), key, "left_anti")


def append_log(rows: DataFrame, path: str, moment: str) -> None:
    """Append-only log partitioned by day."""
    rows.withColumn("log_date", F.to_date(moment)).write.mode("append").partitionBy("log_date").parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def export_report(rows: DataFrame, path: str, moment: str, as_of: Column, days: int, summary: DataFrame) -> None:
    """JSON export of the last days: ``path/metrics`` holds the rows, newest first over its files in name order, ``path/header`` one
    document with the export's time, period, number of records and summary (one row)."""
    recent = rows.where(F.col(moment) > as_of - F.make_dt_interval(F.lit(days)))
    recent.orderBy(F.desc(moment)).write.mode("overwrite").json(f"{path}/metrics")
    counted = recent.agg(F.count(F.lit(1)).alias("total_records"))
    header = counted.join(summary.select(F.struct(*summary.columns).alias("summary")), F.lit(True), "left")  # one row each
    header.select(as_of.alias("export_timestamp"), F.lit(days).alias("period_days"), "total_records", "summary").write.mode("overwrite").json(f"{path}/header")


def decoded_column(rows: DataFrame, column: str, schema: str, numbers: list[str]) -> DataFrame:
    """A JSON text column as a struct; its numeric fields are 0 where missing or not a number."""
    value = F.from_json(column, schema)
    fields = [F.coalesce(F.col("json_")[n].try_cast("double"), F.lit(0.0)).alias(n) for n in numbers]
    return rows.withColumn("json_", value).select(*[c for c in rows.columns if c != column], *fields)


def newest(rows: DataFrame, order: str, limit: int) -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(limit)


def inserted(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with the new rows whose key it does not hold yet (of repeated keys any one)."""
    return table.unionByName(new.dropDuplicates([key]).join(table.select(key).distinct(), key, "left_anti").select(*table.columns))


def without_keys(parent: DataFrame, children: list[DataFrame], gone: DataFrame, key: str) -> list[DataFrame]:
    """Parent and child tables without the deleted keys."""
    return [t.join(gone.select(key).distinct(), key, "left_anti") for t in [parent, *children]]


def rewritten_without(paths: list[str], gone: DataFrame, key: str, to: list[str]) -> None:
    """Cascaded delete: each table (parent and children) is written anew, to its own new folder, without the deleted keys.

    Readers of the old folders are not disturbed; the catalogue is pointed to the new ones afterwards.
    """
    spark = gone.sparkSession
    tables = [spark.read.parquet(p) for p in paths]
    for rows, path in zip(without_keys(tables[0], tables[1:], gone, key), to, strict=True):
        rows.write.parquet(path)


def evolved(rows: DataFrame, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds columns (type, default) that are missing and fills NULLs of those present."""
    out = rows
    for name, (kind, default) in columns.items():
        base = F.col(name) if name in rows.columns else F.lit(None).cast(kind)
        out = out.withColumn(name, F.coalesce(base, default.cast(kind)))
    return out

