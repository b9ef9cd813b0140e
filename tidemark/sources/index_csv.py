"""Wide monthly CSV files and report configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.dates import parse_month
from tidemark.functions.text import lookup
from tidemark.operators.index_series import direction_by_level
from tidemark.sources.yaml_config import read_yaml


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, header names trimmed; a byte order mark is skipped by the reader."""
    raw = spark.read.option("header", True).csv(path)
    return raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])


def has_row_numbers(spark: SparkSession, path: str) -> bool:
    """Is the first column a running row number?

    All values are digits and over 90 % of consecutive differences, in file order, are one. The
    differences are taken inside each file split; only one row per split meets its neighbour.
    """
    raw = spark.read.option("header", True).csv(path)
    first = raw.columns[0]
    cells = raw.select(F.trim(F.col(f"`{first}`")).alias("cell"), F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("line")).where(F.coalesce("cell", F.lit("")) != "")
    cells = cells.withColumn("value", F.col("cell").try_cast("bigint"))
    split = W.partitionBy("file", "block").orderBy("line")
    steps = cells.withColumn("step", F.col("value") - F.lag("value").over(split))
    per_split = steps.groupBy("file", "block").agg(
        F.min(F.col("cell").rlike(r"^\d+$")).alias("digits"), F.count("step").alias("pairs"),
        F.count_if(F.col("step") == 1).alias("ones"), F.min_by("value", "line").alias("first_value"),
        F.max_by("value", "line").alias("last_value"))
    edge = F.col("first_value") - F.lag("last_value").over(W.partitionBy(F.lit(1)).orderBy("file", "block"))
    summary = per_split.withColumn("edge", edge).agg(
        F.min("digits").alias("digits"), (F.sum("pairs") + F.count("edge")).alias("pairs"),
        (F.sum("ones") + F.count_if(F.col("edge") == 1)).alias("ones")).first()
    return bool(summary["digits"]) and bool(summary["pairs"]) and summary["ones"] / summary["pairs"] > 0.9


def index_observations(wide: DataFrame, report_type: str = "Manufacturing") -> DataFrame:
    """Long observations of a wide table: known columns only, bad months and blank cells skipped."""
    known = [c for c in wide.columns if c in V.SHORT_NAMES]
    if "Month" not in wide.columns:
        raise ValueError(f"no Month column among {wide.columns}")
    long = wide.select("Month", *[f"`{c}`" for c in known]).unpivot(["Month"], known, "short_name", "cell")
    value = F.trim("cell").try_cast("double")
    rows = long.select(parse_month(F.col("Month")).alias("report_date"), F.lit(report_type).alias("report_type"),
                       lookup(F.col("short_name"), V.SHORT_NAMES).alias("index_name"), value.alias("index_value"))
    rows = rows.where(F.col("report_date").isNotNull() & F.col("index_value").isNotNull())
    return rows.withColumn("direction", direction_by_level(F.col("index_name"), F.col("index_value")))


def read_index_csv(spark: SparkSession, path: str, report_type: str = "Manufacturing") -> DataFrame:
    """The CSV source as a whole; a leading row-number column is dropped."""
    wide = read_wide_csv(spark, path)
    if wide.columns[0] != "Month" and has_row_numbers(spark, path):
        wide = wide.drop(wide.columns[0])
    return index_observations(wide, report_type)


CONFIG_SCHEMA = ("indices array<string>, index_categories map<string,array<string>>, "
                 "canonical_industries array<string>, _broken string")


def _read_configs(spark: SparkSession, folder: str) -> DataFrame:
    """All <type>_config files below a folder, JSON or YAML, with the reason why one can't be used."""
    raw = (spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", True).json(folder))
    columns = ["indices", "index_categories", "canonical_industries"]
    reason = F.when(F.col("_broken").isNotNull(), "no JSON").when(F.col("indices").isNull(), "no indices")
    json = raw.select(F.col("_metadata.file_path").alias("path"), *columns, reason.alias("reason")).where(F.col("path").rlike(r"\.json(/|$)"))
    stem = F.regexp_extract(F.col("path"), r"/([A-Za-z]+)_config\.(?:json|yaml|yml)(?:/|$)", 1)
    return json.unionByName(read_yaml(spark, folder)).withColumn("report_type", F.initcap(stem)).where(F.col("report_type") != "")


def read_report_configs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per valid <type>_config.json, .yaml or .yml below a folder; broken files are in ``rejected_configs``."""
    return _read_configs(spark, folder).where(F.col("reason").isNull()).select("report_type", "indices", "index_categories", "canonical_industries")


def rejected_configs(spark: SparkSession, folder: str) -> DataFrame:
    """The config files below a folder that can't be used, and why."""
    return _read_configs(spark, folder).where(F.col("reason").isNotNull()).select("path", "report_type", "reason")


def categories_of(configs: DataFrame, indices: DataFrame) -> DataFrame:
    """Category pair per (report_type, index_name): configured, else the default rule."""
    name = F.col("index_name")
    pair = F.coalesce(
        lookup(name, {k: f"{a}|{b}" for k, (a, b) in V.CATEGORIES.items()}), F.lit("|".join(V.DEFAULT_CATEGORIES)))
    known = configs.select("report_type", F.explode("index_categories").alias("index_name", "configured"))
    return indices.join(known, ["report_type", "index_name"], "left").withColumn(
        "categories", F.coalesce("configured", F.split(pair, r"\|"))).drop("configured")
