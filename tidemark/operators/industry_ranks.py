"""Queries over ranked industry mentions: status matrices, signed ranks, layouts.

Input role: mentions(report_date, report_type, index_name, industry_name, category, rank).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.text import lookup
from tidemark.runtime import small_dimension

KEYS = ["report_date", "report_type", "index_name"]


def canonical_industries(spark: SparkSession) -> DataFrame:
    """report_type, industry_name, list_position: the fixed lists of both report types."""
    return small_dimension(
        spark, ["report_type", "industry_name", "list_position"],
        [("Manufacturing", n, i) for i, n in enumerate(V.MANUFACTURING_INDUSTRIES)]
        + [("Services", n, i) for i, n in enumerate(V.SERVICES_INDUSTRIES)])


def positive_category(name: Column) -> Column:
    return F.coalesce(lookup(name, {k: v[0] for k, v in V.CATEGORIES.items()}),
                      F.lit(V.DEFAULT_CATEGORIES[0]))


def negative_category(name: Column) -> Column:
    return F.coalesce(lookup(name, {k: v[1] for k, v in V.CATEGORIES.items()}),
                      F.lit(V.DEFAULT_CATEGORIES[1]))


def status_of(name: Column, category: Column) -> Column:
    """Status word of a category."""
    return (
        F.when(name == "Supplier Deliveries", F.when(category == "Slower", "Slowing").otherwise("Faster"))
        .when(name == "Inventories", F.when(category == "Higher", "Higher").otherwise("Lower"))
        .when(name.isin("Customers' Inventories", "Inventory Sentiment"), category)
        .when(name == "Prices", F.when(category == "Increasing", "Increasing").otherwise("Decreasing"))
        .otherwise(F.when(category == "Growing", "Growing").otherwise("Contracting")))


def latest_months(mentions: DataFrame, newest: int) -> DataFrame:
    """The newest N report dates of every type, numbered from the newest."""
    recent = W.partitionBy("report_type").orderBy(F.desc("report_date"))
    return (mentions.select("report_type", "report_date").distinct()
            .withColumn("month_place", F.row_number().over(recent)).where(F.col("month_place") <= newest))


def status_matrix(mentions: DataFrame, newest: int, padded: bool = False) -> DataFrame:
    """Every industry ever listed for an index against the newest N months; gaps are Neutral.

    With `padded`, canonical industries that never appeared are rows as well.
    """
    months = latest_months(mentions, newest)
    industries = mentions.select("report_type", "index_name", "industry_name").distinct()
    if padded:
        names = mentions.select("report_type", "index_name").distinct()
        canon = canonical_industries(mentions.sparkSession).drop("list_position")
        industries = industries.unionByName(names.join(canon, "report_type")).distinct()
    grid = industries.join(months, "report_type")
    filled = grid.join(
        mentions.select(*KEYS, "industry_name", "category", "rank"), KEYS + ["industry_name"], "left")
    status = status_of(F.col("index_name"), F.col("category"))
    return filled.select(
        *KEYS, "industry_name", "month_place",
        F.when(F.col("category").isNull(), "Neutral").otherwise(status).alias("status"),
        F.coalesce("category", F.lit("Not Reported")).alias("category"),
        F.coalesce("rank", F.lit(0)).alias("rank"))


def latest_ranks(mentions: DataFrame) -> DataFrame:
    """Rank of every industry in the newest report of its type."""
    newest = mentions.groupBy("report_type").agg(F.max("report_date").alias("report_date"))
    return mentions.join(newest, ["report_type", "report_date"], "left_semi").select(
        *KEYS, "industry_name", "rank")


def alphabetical_matrix(mentions: DataFrame, newest: int) -> DataFrame:
    """Status per industry (alphabetical) with one column per month, newest month first."""
    matrix = status_matrix(mentions, newest)
    order = W.partitionBy("report_type", "index_name").orderBy("industry_name")
    wide = matrix.groupBy("report_type", "index_name", "industry_name").pivot(
        "month_place", list(range(1, newest + 1))).agg(F.first("status"))
    renamed = wide.select("report_type", "index_name", "industry_name",
                          *[F.col(f"`{i}`").alias(f"month_{i}") for i in range(1, newest + 1)])
    return renamed.withColumn("line", F.row_number().over(order))


def signed_ranks(mentions: DataFrame) -> DataFrame:
    """Signed rank of every canonical industry per month and index.

    Positive-side industries get n ... 1 in listed order, negative-side ones -n ... -1, all
    others 0. Each canonical name counts once, at its first mention.
    """
    side = (F.when(F.col("category") == positive_category(F.col("index_name")), F.lit(1))
            .when(F.col("category") == negative_category(F.col("index_name")), F.lit(-1)))
    first = mentions.groupBy(*KEYS, "industry_name").agg(
        F.min("rank").alias("rank"), F.min_by(side, "rank").alias("side"))
    ordered = W.partitionBy(*KEYS, "side").orderBy("rank", "industry_name")
    whole = W.partitionBy(*KEYS, "side")
    place = F.row_number().over(ordered) - 1
    size = F.count(F.lit(1)).over(whole)
    ranked = first.where(F.col("side").isNotNull()).select(
        *KEYS, "industry_name", ((size - place) * F.col("side")).cast("int").alias("signed_rank"))
    canon = canonical_industries(mentions.sparkSession)
    grid = mentions.select(*KEYS).distinct().join(canon, "report_type")
    month = W.partitionBy(*KEYS)
    filled = grid.join(ranked, KEYS + ["industry_name"], "left").withColumn(
        "signed_rank", F.coalesce("signed_rank", F.lit(0)))
    return filled.withColumn("max_rank", F.max("signed_rank").over(month)).withColumn(
        "min_rank", F.min("signed_rank").over(month))


def ranking_layout(ranks: DataFrame, newest: int) -> DataFrame:
    """Side-by-side lines: alphabetical reference, then per month the industry at that place."""
    months = latest_months(ranks, newest)
    placed = ranks.join(months, ["report_type", "report_date"]).withColumn(
        "line", F.row_number().over(
            W.partitionBy(*KEYS).orderBy(F.desc("signed_rank"), "list_position")))
    wide = placed.groupBy("report_type", "index_name", "line").pivot(
        "month_place", list(range(1, newest + 1))).agg(
        F.first("industry_name").alias("industry"), F.first("signed_rank").alias("rank"))
    canon = canonical_industries(ranks.sparkSession).withColumn(
        "line", F.row_number().over(W.partitionBy("report_type").orderBy("industry_name")))
    months_out = [c for i in range(1, newest + 1) for c in (
        F.col(f"`{i}_industry`").alias(f"industry_{i}"), F.col(f"`{i}_rank`").alias(f"rank_{i}"))]
    return wide.join(canon.select("report_type", "line", F.col("industry_name").alias("reference")),
                     ["report_type", "line"]).select("report_type", "index_name", "line", "reference", *months_out)


ARTEFACT = r"(?i)following order|are:|^[,:;.]"


def valid_industry(name: Column) -> Column:
    return F.coalesce((F.length(F.trim(name)) >= 3) & ~name.rlike(ARTEFACT), F.lit(False))


def index_listing(mentions: DataFrame) -> DataFrame:
    """Lines of the per-index listing: primary category first, then secondary, then the rest."""
    name, category = F.col("index_name"), F.col("category")
    block = F.when(category == positive_category(name), 0).when(category == negative_category(name), 1).otherwise(2)
    shown = F.when(block < 2, F.concat_ws(" - ", "industry_name", "category")).otherwise(F.col("industry_name"))
    order = W.partitionBy(*KEYS).orderBy(block, category, "rank", "industry_name")
    return mentions.where(valid_industry(F.col("industry_name"))).select(
        *KEYS, F.row_number().over(order).alias("line"), shown.alias("entry"))
