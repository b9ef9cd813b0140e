"""Queries over index observations: lists, series with change, wide tables, movers.

Input role: observations(report_date, report_type, index_name, index_value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.dates import month_name, parse_month
from tidemark.functions.text import lookup
from tidemark.operators.containment import containing
from tidemark.runtime import small_dimension


def direction_by_level(name: Column, value: Column) -> Column:
    """Direction word of a level: 50 divides; three indices have words of their own."""
    high = value >= 50
    return (
        F.when(name == "Supplier Deliveries", F.when(high, "Slowing").otherwise("Faster"))
        .when(name.isin("Customers' Inventories", "Inventory Sentiment"),
              F.when(high, "Too High").otherwise("Too Low"))
        .when(name == "Prices", F.when(high, "Increasing").otherwise("Decreasing"))
        .otherwise(F.when(high, "Growing").otherwise("Contracting")))


def is_headline(report_type: Column, name: Column) -> Column:
    return name == lookup(report_type, V.HEADLINE)


def report_exists(requests: DataFrame, reports: DataFrame) -> DataFrame:
    """For each request (month_text, report_type): is there a report?

    Four probes: same text, same text ignoring case, same month after parsing, text contained.
    The first three are equality joins on a key; only texts still unanswered reach the
    containment probe, by their rarest stretch of characters among the known texts.
    """
    known = reports.select("report_type", "month_year", "report_date").distinct()
    asked = requests.select("month_text", "report_type").distinct().withColumn(
        "asked_date", parse_month(F.col("month_text")))
    texts = known.select("report_type", F.lower("month_year").alias("known_text")).distinct()
    by_text = asked.join(
        texts.withColumn("text_hit", F.lit(True)),
        (asked.report_type == texts.report_type) & (F.lower("month_text") == texts.known_text), "left"
    ).select(asked["*"], "text_hit")
    dates = known.select("report_type", F.col("report_date").alias("known_date")).distinct()
    by_date = by_text.join(
        dates.withColumn("date_hit", F.lit(True)),
        (by_text.report_type == dates.report_type) & (by_text.asked_date == dates.known_date), "left"
    ).select(by_text["*"], "date_hit").withColumn(
        "hit", F.coalesce("text_hit", "date_hit", F.lit(False)))
    part = by_date.where(~F.col("hit")).select("month_text", F.col("report_type"))
    hits = containing(texts.withColumnRenamed("known_text", "text"), part.select("report_type", F.lower("month_text").alias("asked")), ["report_type"])
    anywhere = texts.select("report_type", F.lit("").alias("asked")).distinct()  # the empty text is contained in any
    contained = part.withColumn("asked", F.lower("month_text")).join(
        hits.select("report_type", "asked").distinct().unionByName(anywhere), ["report_type", "asked"], "left_semi").drop("asked").withColumn("part_hit", F.lit(True))
    answered = by_date.join(contained, ["month_text", "report_type"], "left").select(
        "month_text", "report_type", (F.col("hit") | F.coalesce("part_hit", F.lit(False))).alias("found"))
    return requests.join(answered, ["month_text", "report_type"])


def report_list(reports: DataFrame, report_type: str | None = None) -> DataFrame:
    """Reports newest first, optionally of one type."""
    rows = reports if report_type is None else reports.where(F.col("report_type") == report_type)
    return rows.orderBy(F.desc("report_date"), "report_type")


def report_types(reports: DataFrame) -> DataFrame:
    return reports.select("report_type").distinct()


def month_records(reports: DataFrame, observations: DataFrame, months: int | None = None,
                  as_of: Column | None = None) -> DataFrame:
    """One row per (month, type) with the nested map index -> (value, direction)."""
    rows = observations if months is None else observations.where(
        F.col("report_date") >= F.date_sub(as_of, 30 * months))
    entry = F.struct("index_name", F.struct(
        F.col("index_value").alias("value"),
        direction_by_level(F.col("index_name"), F.col("index_value")).alias("direction")))
    nested = rows.groupBy("report_date", "report_type").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("indices"))
    return reports.join(nested, ["report_date", "report_type"])


def heatmap(observations: DataFrame, report_type: str) -> DataFrame:
    """Wide table, one row per month: headline first, the other indices alphabetical, short names."""
    names = V.MANUFACTURING_INDICES if report_type == "Manufacturing" else V.SERVICES_INDICES
    head = V.HEADLINE[report_type]
    ordered = [head] + sorted(n for n in names if n != head)
    short = {full: s for s, full in V.SHORT_NAMES.items()}
    wide = observations.where(F.col("report_type") == report_type).groupBy("report_date").pivot(
        "index_name", ordered).agg(F.first("index_value"))
    return wide.select(
        F.date_format("report_date", "MM/dd/yyyy").alias("Month"),
        *[F.col(f"`{n}`").alias(short.get(n, n)) for n in ordered],
    ).orderBy(F.to_date("Month", "MM/dd/yyyy"))


def series_with_change(observations: DataFrame, newest: int) -> DataFrame:
    """The newest N rows of every (type, index) with the change against the month before.

    The cut comes first: the oldest row kept has no change.
    """
    backwards = W.partitionBy("report_type", "index_name").orderBy(F.desc("report_date"))
    numbered = observations.withColumn("place", F.row_number().over(backwards)).withColumn(
        "before", F.lead("index_value").over(backwards))
    kept = numbered.where(F.col("place") <= newest)
    change = F.when(F.col("place") < newest, F.round(F.col("index_value") - F.col("before"), 1) + F.lit(0.0))
    return kept.select("report_type", "index_name", "report_date", "index_value",
                       direction_by_level(F.col("index_name"), F.col("index_value")).alias("direction"),
                       change.alias("change"))


def index_names(observations: DataFrame) -> DataFrame:
    """Distinct index names per type, the headline first, then alphabetical."""
    names = observations.select("report_type", "index_name").distinct()
    order = W.partitionBy("report_type").orderBy(
        is_headline(F.col("report_type"), F.col("index_name")).desc(), "index_name")
    return names.withColumn("position", F.row_number().over(order))


def glance_rows(observations: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Long form of the glance row: 'value (direction)' or 'N/A' for every expected index.

    Missing headlines are looked up in the stored observations. Two more cells follow: overall
    economy and sector, both by the 50 threshold of the headline.
    """
    spark = observations.sparkSession
    expected = small_dimension(
        spark, ["report_type", "index_name"],
        [("Manufacturing", n) for n in V.MANUFACTURING_INDICES]
        + [("Services", n) for n in V.SERVICES_INDICES])
    months = observations.select("report_date", "report_type").distinct()
    grid = months.join(expected, "report_type")
    keys = ["report_date", "report_type", "index_name"]
    cells = grid.join(observations.select(*keys, "index_value"), keys, "left")
    if stored is not None:
        backup = stored.where(is_headline(F.col("report_type"), F.col("index_name"))).select(
            *keys, F.col("index_value").alias("stored_value"))
        cells = cells.join(backup, keys, "left").withColumn(
            "index_value", F.coalesce("index_value", "stored_value")).drop("stored_value")
    shown = F.coalesce(F.format_string(
        "%s (%s)", F.format_number("index_value", 1),
        direction_by_level(F.col("index_name"), F.col("index_value"))), F.lit("N/A"))
    shown = F.when(F.col("index_value").isNotNull(), shown).otherwise("N/A")
    indices = cells.select(*keys, shown.alias("cell"))
    head = cells.where(is_headline(F.col("report_type"), F.col("index_name")))
    level = F.when(F.col("index_value").isNull(), "N/A").when(
        F.col("index_value") >= 50, "Growing").otherwise("Contracting")
    extra = head.select(
        "report_date", "report_type",
        F.explode(F.array(F.lit("OVERALL ECONOMY"), F.concat(F.upper("report_type"), F.lit(" SECTOR")))).alias(
            "index_name"), level.alias("cell"))
    return indices.unionByName(extra)


def significant_movers(observations: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Latest against previous report of the same type; moves of at least the threshold."""
    recent = W.partitionBy("report_type").orderBy(F.desc("report_date"))
    last_two = (
        observations.select("report_type", "report_date").distinct()
        .withColumn("place", F.row_number().over(recent)).where(F.col("place") <= 2))
    compared = observations.join(last_two, ["report_type", "report_date"]).groupBy(
        "report_type", "index_name").agg(
        F.max(F.when(F.col("place") == 1, F.col("index_value"))).alias("current_value"),
        F.max(F.when(F.col("place") == 2, F.col("index_value"))).alias("previous_value"),
        F.max(F.when(F.col("place") == 1, F.col("report_date"))).alias("report_date"))
    change = F.col("current_value") - F.col("previous_value")
    verb = F.when(change > 0, "rose").otherwise("fell")
    return compared.where(F.abs(change) >= threshold).select(
        "report_type", "index_name", "report_date", "current_value", "previous_value",
        change.alias("change"),
        direction_by_level(F.col("index_name"), F.col("current_value")).alias("direction"),
        F.concat(F.col("index_name"), F.lit(" "), verb, F.lit(" "), F.format_number(F.abs(change), 1),
                 F.lit(" points to "), F.format_number("current_value", 1), F.lit(" in "),
                 month_name(F.col("report_date"))).alias("description"),
    ).orderBy(F.desc(F.abs("change")))


# search phrase templates (fixed values): {n} name, {l} lower-case name, {d} move, {m} month, {y} year
QUERY_TEMPLATES = [
    "manufacturing {l} {d} impact {m} {y}",
    "economic impact of {d} in manufacturing {l} today",
    "{n} {d} manufacturing sector implications {m}",
    "why {l} {d}d in manufacturing this month",
    "recent {d} in manufacturing {l} analysis",
    "manufacturing {l} trends this week",
]
EXTRA_TEMPLATES = {
    "New Orders": ["manufacturing demand {d} {m} impact",
                   "factory orders {d} economic implications this week"],
    "Production": ["manufacturing output {d} {m} implications", "factory production {d} impact today"],
    "Employment": ["manufacturing jobs {d} {m} analysis", "factory workforce changes {m} {y}"],
    "Prices": ["manufacturing inflation {d} {m} impact", "raw material prices {d} manufacturing {m}"],
    "Manufacturing PMI": ["manufacturing PMI {d} economic outlook {m}",
                          "PMI {d} impact on economy this week"],
}


def mover_queries(movers: DataFrame, as_of: Column, count: int = 4) -> DataFrame:
    """Search phrases of every mover, numbered, the first `count` kept."""
    move = F.when(F.col("change") > 0, "increase").otherwise("decrease")

    def fill(template: str) -> Column:
        out: Column = F.lit(template)
        for mark, value in (("{n}", F.col("index_name")), ("{l}", F.lower("index_name")), ("{d}", move),
                            ("{m}", F.date_format(as_of, "MMMM")), ("{y}", F.date_format(as_of, "yyyy"))):
            out = F.replace(out, F.lit(mark), value)
        return out

    base = F.array(*[fill(t) for t in QUERY_TEMPLATES])
    extra = F.array().cast("array<string>")
    for name, templates in EXTRA_TEMPLATES.items():
        extra = F.when(F.col("index_name") == name, F.array(*[fill(t) for t in templates])).otherwise(extra)
    phrases = F.slice(F.concat(base, extra), 1, count)
    return movers.select("report_type", "index_name", F.posexplode(phrases).alias("position", "phrase"))
