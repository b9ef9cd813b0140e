"""Registered cleaning and validation queries over extracted facts derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.dates import parse_month
from tidemark.functions.numbers import clean_number
from tidemark.operators import cleaning as C
from tidemark.operators import index_series as X
from tidemark.operators import industry_ranks as R
from tidemark.operators.containment import canonical_names, names_by_overlap
from tidemark.plans import bindings as B
from tidemark.plans.index_queries import MATRIX_SQL
from tidemark.plans.oracle_tables import direction, negative, positive, sql, sql_list, status
from tidemark.plans.portfolio_queries import _rounded
from tidemark.plans.registry import query
from tidemark.runtime import cut_lineage, inline_table

DATE = "CAST(report_date AS VARCHAR) AS report_date"
ID = "CAST(report_date AS VARCHAR) || '/' || report_type AS report_id"


def _id():
    return F.concat_ws("/", F.date_format("report_date", "yyyy-MM-dd"), "report_type").alias("report_id")


def _facts(spark, sf):
    """Index facts per report with names of the other report type mixed in."""
    return B.index_obs(spark, sf).select(_id(), "report_date", "report_type", "index_name", F.col("index_value").alias("value"))


def _mentions(spark, sf):
    return B.industry_status(spark, sf).select(_id(), "report_date", "report_type", "index_name", "industry_name",
                                               "category", "rank", "raw_industry")


@query("v01_parsed_months", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) END AS report_date FROM orders""")
def parsed_months(spark, sf):
    kind, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = (F.when(kind == 0, F.date_format(d, "MMMM yyyy")).when(kind == 1, F.date_format(d, "MMM-yy"))
            .when(kind == 2, F.date_format(d, "MM/yyyy")).when(kind == 3, F.lower(F.date_format(d, "MMM yyyy")))
            .otherwise(F.concat(F.lit("Q"), F.date_format(d, "yyyy"))))
    rows = B.table(spark, sf, "orders").select("o_orderkey", text.alias("month_text"))
    good, bad = C.split_unparsed(rows, "month_text")
    return good.select("o_orderkey", F.date_format("report_date", "yyyy-MM-dd").alias("report_date")).unionByName(
        bad.select("o_orderkey", F.lit("").alias("report_date")))


@query("v02_cleaned_numbers", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_totalprice END AS value, CASE WHEN o_orderkey % 4 = 2 THEN 0.5 WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_totalprice END::DOUBLE AS level FROM orders""")
def cleaned_numbers(spark, sf):
    kind, amount = F.col("o_orderkey") % 4, F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    text = (F.when(kind == 0, F.concat(amount, F.lit("%"))).when(kind == 1, F.concat(F.lit("$ "), amount))
            .when(kind == 2, amount).otherwise("n/a"))
    rows = B.table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), text.alias("t"))
    level = C.pick_level(F.when(F.col("kind") == 2, F.concat(F.lit("+"), F.col("t"))),
                         F.when(F.col("kind") == 2, "0.5"), F.col("t"))
    return rows.select("o_orderkey", clean_number(F.col("t")).alias("value"), level.alias("level"))


_WORDS = list(V.DIRECTION_WORDS) + ["STEADY", "", "Growth "]


@query("v03_standard_directions", f"""SELECT event_id, CASE w WHEN 'STEADY' THEN 'Steady' WHEN '' THEN 'Unknown' WHEN 'Growth ' THEN 'Growing'
  ELSE {'MAP {' + ', '.join(f"'{k}': '{v}'" for k, v in V.DIRECTION_WORDS.items()) + '}'}[w] END AS direction FROM (SELECT event_id, {sql_list(_WORDS)}[event_id % {len(_WORDS)} + 1] AS w FROM events)""")
def standard_directions(spark, sf):
    return B.table(spark, sf, "events").select(
        "event_id", C.standard_direction(B.pick(_WORDS, F.col("event_id"))).alias("direction"))


@query("v04_direction_by_level", sql("index_obs", f"SELECT {DATE}, report_type, index_name, {direction('index_name', 'index_value')} AS direction FROM index_obs"))
def direction_by_level(spark, sf):
    return B.index_obs(spark, sf).select("report_date", "report_type", "index_name", X.direction_by_level(
        F.col("index_name"), F.col("index_value")).alias("direction"))


@query("v05_category_status", sql("industry_status", f"SELECT {DATE}, report_type, index_name, industry_name, {status('index_name', 'category')} AS status FROM industry_status"))
def category_status(spark, sf):
    return _mentions(spark, sf).select("report_date", "report_type", "index_name", "industry_name", R.status_of(
        F.col("index_name"), F.col("category")).alias("status"))


def _dirty(spark, sf):
    name, kind = F.col("industry_name"), (F.col("rank") + F.month("report_date")) % 7
    return _mentions(spark, sf).withColumn("raw", (
        F.when(kind == 0, F.concat(F.lit("1. "), name)).when(kind == 1, F.concat(F.lit("and "), name))
        .when(kind == 2, F.concat(F.lit("  "), F.replace(name, F.lit(" "), F.lit("   ")))).when(kind == 3, F.lit("in the following order:"))
        .when(kind == 4, F.lit("None")).when(kind == 5, F.concat(F.lit("s "), name)).otherwise(name)))


_KIND = "(rank + month(s.report_date)) % 7"


@query("v06_cleaned_industries", sql("industry_status", f"""SELECT {DATE}, report_type, index_name, rank, CASE WHEN {_KIND} IN (0, 3, 4) THEN '' ELSE industry_name END AS clean FROM industry_status s"""))
def cleaned_industries(spark, sf):
    return _dirty(spark, sf).select("report_date", "report_type", "index_name", "rank",
                                    F.coalesce(C.clean_industry(F.col("raw")), F.lit("")).alias("clean"))


@query("v07_cleaned_industries_old", sql("industry_status", f"""SELECT {DATE}, report_type, index_name, rank, CASE {_KIND} WHEN 0 THEN '1. ' || regexp_replace(industry_name, ' Products$', '')
  WHEN 3 THEN '' WHEN 4 THEN 'None' ELSE regexp_replace(industry_name, ' Products$', '') END AS clean FROM industry_status s"""))
def cleaned_industries_old(spark, sf):
    return _dirty(spark, sf).select("report_date", "report_type", "index_name", "rank",
                                    F.coalesce(C.clean_industry_old(F.col("raw")), F.lit("")).alias("clean"))


@query("v08_cleaned_lists", sql("industry_status", f"SELECT {DATE}, report_type, index_name, category, industry_name, rank * 3 AS rank FROM industry_status"))
def cleaned_lists(spark, sf):
    rows = _mentions(spark, sf).select("report_date", "report_type", "index_name", "category", F.explode(F.array(
        F.struct((F.col("rank") * 3).alias("rank"), F.concat(F.lit(" "), "industry_name").alias("industry_name")),
        F.struct((F.col("rank") * 3 + 1).alias("rank"), F.upper("industry_name").alias("industry_name")),
        F.struct((F.col("rank") * 3 + 2).alias("rank"), F.lit("are:").alias("industry_name")))).alias("x"))
    flat = rows.select("report_date", "report_type", "index_name", "category", "x.rank", "x.industry_name")
    return C.clean_lists(flat, ["report_date", "report_type", "index_name", "category"])


@query("v09_canonical_industries", sql("industry_status", f"SELECT {DATE}, report_type, index_name, category, industry_name, rank FROM industry_status"))
def canonical_industries(spark, sf):
    return C.standardised_mentions(_mentions(spark, sf), ["report_date", "report_type", "index_name", "category"])


@query("v10_canonical_by_overlap", sql("industry_status", f"SELECT {DATE}, report_type, index_name, rank, industry_name FROM industry_status"))
def canonical_by_overlap(spark, sf):
    return _mentions(spark, sf).select("report_date", "report_type", "index_name", "rank", C.canonical_by_overlap(
        F.col("report_type"), F.col("raw_industry")).alias("industry_name"))


def _canonical_lists(spark):
    """The canonical lists as a table, as a config's would be."""
    return inline_table(spark, ["report_type", "position", "name"], [(kind, i, n) for kind, names in C.LISTS.items() for i, n in enumerate(names)])


def _renamed(spark, sf, mapping):
    """Mentions under the names that a mapping (report_type, raw, name) gives their spellings."""
    mentions = _mentions(spark, sf)
    names = mapping(mentions.select("report_type", F.col("raw_industry").alias("raw")), _canonical_lists(spark), ["report_type"]).withColumnsRenamed({"raw": "raw_industry", "name": "industry_name"})
    return mentions.drop("industry_name").join(names, ["report_type", "raw_industry"])


@query("v09_canonical_from_table", sql("industry_status", f"SELECT {DATE}, report_type, index_name, category, industry_name, rank FROM industry_status"))
def canonical_from_table(spark, sf):
    named = _renamed(spark, sf, canonical_names).where("industry_name IS NOT NULL")
    return named.groupBy("report_date", "report_type", "index_name", "category", "industry_name").agg(F.min("rank").alias("rank"))


@query("v10_overlap_from_table", sql("industry_status", f"SELECT {DATE}, report_type, index_name, rank, industry_name FROM industry_status"))
def overlap_from_table(spark, sf):
    return _renamed(spark, sf, names_by_overlap).select("report_date", "report_type", "index_name", "rank", "industry_name")


def _swapped(spark, sf):
    """Services reports that use three manufacturing names, in even months."""
    flip = (F.col("report_type") == "Services") & (F.month("report_date") % 2 == 0)
    old = (F.when(F.col("index_name") == "Services PMI", "Manufacturing PMI")
           .when(F.col("index_name") == "Business Activity", "Production")
           .when(F.col("index_name") == "Inventory Sentiment", "Customers' Inventories").otherwise(F.col("index_name")))
    return _facts(spark, sf).withColumn("index_name", F.when(flip, old).otherwise(F.col("index_name")))


@query("v11_harmonised_names", sql("index_obs", f"SELECT {ID}, {DATE}, report_type, index_name, index_value AS value FROM index_obs"))
def harmonised_names(spark, sf):
    return C.harmonise_names(_swapped(spark, sf))


@query("v11_harmonised_names_strict", sql("index_obs", f"""SELECT {ID}, {DATE}, report_type, CASE WHEN report_type = 'Services' AND month(s.report_date) % 2 = 0 AND index_name = 'Inventory Sentiment' THEN 'Customers'' Inventories' ELSE index_name END AS index_name, index_value AS value FROM index_obs s"""))
def harmonised_names_strict(spark, sf):
    return C.harmonise_names(_swapped(spark, sf), drop_old=True)


@query("v12_type_by_headline", sql("index_obs", f"""SELECT {ID}, CASE WHEN bool_or(index_name = 'Manufacturing PMI') THEN 'Manufacturing' WHEN bool_or(index_name = 'Services PMI') THEN 'Services' ELSE 'Unknown' END AS report_type
  FROM index_obs GROUP BY report_date, report_type""".replace("report_type AS report_id", "index_obs.report_type AS report_id").replace("GROUP BY report_date, report_type", "GROUP BY report_date, index_obs.report_type")))
def type_by_headline(spark, sf):
    return C.type_by_headline(_facts(spark, sf).withColumn("report_type", F.lit("Unknown")))


_ALIASES = list(V.REPORT_TYPE_ALIASES) + ["other", " MFG "]


@query("v13_standard_report_types", f"""SELECT event_id, CASE WHEN a IN ('services', 'svc', 'service', 'services pmi', 'non-manufacturing') THEN 'Services' ELSE 'Manufacturing' END AS report_type
  FROM (SELECT event_id, {sql_list(_ALIASES)}[event_id % {len(_ALIASES)} + 1] AS a FROM events)""")
def standard_report_types(spark, sf):
    return B.table(spark, sf, "events").select("event_id", C.standard_report_type(
        B.pick(_ALIASES, F.col("event_id"))).alias("report_type"))


@query("v14_repaired_values", sql("index_obs", f"""SELECT {ID}, index_name, CASE k WHEN 1 THEN CASE WHEN index_value BETWEEN 20 AND 80 OR (index_name IN ('New Export Orders', 'Supplier Deliveries') AND index_value > 20) THEN index_value END
    WHEN 2 THEN CASE WHEN index_name IN ('New Export Orders', 'Supplier Deliveries') AND index_value > 20 THEN index_value ELSE 3.5 END ELSE index_value END AS value,
    k = 1 AND index_name IN ('New Export Orders', 'Supplier Deliveries') AS needs_correction FROM (SELECT *, month(report_date) % 3 AS k FROM index_obs)"""))
def repaired_values(spark, sf):
    k, level = F.month("report_date") % 3, F.format_number("value", 1)
    rows = _facts(spark, sf).withColumn("current", F.when(k == 1, "+3.5").when(k == 2, "3.5").otherwise(level)).withColumn(
        "series_index", level)
    return C.repair_values(rows).select("report_id", "index_name", "value", "needs_correction")


def _headless(spark, sf):
    rows = cut_lineage(_facts(spark, sf)).withColumn("direction", X.direction_by_level(F.col("index_name"), F.col("value")))
    head = X.is_headline(F.col("report_type"), F.col("index_name"))
    return rows.where(~(head & (F.month("report_date") % 2 == 1)))


_COMPONENT = "CASE report_type WHEN 'Manufacturing' THEN index_name IN ('New Orders', 'Production', 'Employment', 'Supplier Deliveries', 'Inventories') ELSE index_name IN ('Business Activity', 'New Orders', 'Employment', 'Supplier Deliveries') END"
HEADLESS = {"headless": f"SELECT {ID}, report_date, report_type, index_name, index_value AS value, {direction('index_name', 'index_value')} AS direction FROM index_obs s WHERE NOT (index_name IN ('Manufacturing PMI', 'Services PMI') AND month(s.report_date) % 2 = 1)".replace("CAST(report_date", "CAST(s.report_date").replace("|| report_type", "|| s.report_type"),
    "imputed": f"""SELECT report_id, report_type, index_name, value, direction, false AS inferred FROM headless UNION ALL
      SELECT report_id, report_type, report_type || ' PMI', avg(value), CASE WHEN avg(value) >= 50 THEN 'Growing' ELSE 'Contracting' END, true FROM headless
      WHERE {_COMPONENT} AND report_id NOT IN (SELECT report_id FROM headless WHERE index_name LIKE '%PMI') GROUP BY report_id, report_type"""}


@query("v15_imputed_headline", sql("index_obs", "SELECT report_id, report_type, index_name, round(value, 6) AS value, direction, inferred FROM imputed", HEADLESS))
def imputed_headline(spark, sf):
    return _rounded(C.impute_headline(_headless(spark, sf)), {"value": 6})


def _doubled(spark, sf):
    """Mentions where every third industry is also listed in the other category."""
    rows = cut_lineage(_mentions(spark, sf).drop("raw_industry"))
    other = F.when(F.col("category") == R.positive_category(F.col("index_name")), R.negative_category(
        F.col("index_name"))).otherwise(R.positive_category(F.col("index_name")))
    extra = rows.where(F.col("rank") % 3 == 0).withColumn("category", other)
    return rows.unionByName(extra)


@query("v16_one_category_each", sql("industry_status", f"""SELECT {ID}, {DATE}, report_type, index_name, industry_name, rank,
  CASE WHEN rank % 3 = 0 THEN {positive('index_name')} ELSE category END AS category FROM industry_status"""))
def one_category_each(spark, sf):
    return C.one_category_each(_doubled(spark, sf), ["report_id", "index_name"])


def _report_ids(spark, sf):
    return B.reports(spark, sf).select(_id(), "report_date", "report_type")


GRID = {"expected": f"SELECT 'Manufacturing' AS report_type, unnest({sql_list(V.MANUFACTURING_INDICES[1:])}) AS index_name UNION ALL SELECT 'Services', unnest({sql_list(V.SERVICES_INDICES[1:])})",
        "ids": f"SELECT {ID}, report_date, report_type FROM reports"}


@query("v17_complete_grid", sql(["reports", "industry_status"], f"""SELECT g.report_id, g.report_type, g.index_name, g.category, coalesce(industries, '') AS industries FROM (
    SELECT report_id, report_date, report_type, index_name, unnest([{positive('index_name')}, {negative('index_name')}]) AS category FROM ids JOIN expected USING (report_type)) g
  LEFT JOIN (SELECT report_date, report_type, index_name, category, string_agg(industry_name, '|' ORDER BY rank) AS industries FROM industry_status GROUP BY ALL) l
    ON l.report_date = g.report_date AND l.report_type = g.report_type AND l.index_name = g.index_name AND l.category = g.category""", GRID))
def complete_grid(spark, sf):
    rows = C.complete_grid(_report_ids(spark, sf), _mentions(spark, sf))
    return rows.withColumn("industries", F.array_join("industries", "|"))


@query("v18_validation_verdicts", sql(["reports", "industry_status"], """SELECT report_id, i.report_type, e.index_name, s.index_name IS NOT NULL AS valid FROM ids i JOIN expected e USING (report_type)
  LEFT JOIN (SELECT DISTINCT report_date, report_type, index_name FROM industry_status) s ON s.report_date = i.report_date AND s.report_type = i.report_type AND s.index_name = e.index_name""", GRID))
def validation_verdicts(spark, sf):
    return C.validation_verdicts(_report_ids(spark, sf), _mentions(spark, sf))


@query("v19_missing_indices", sql(["reports", "index_obs"], f"""SELECT report_id, i.report_type, e.index_name FROM ids i JOIN (SELECT * FROM expected UNION ALL VALUES ('Manufacturing', 'Manufacturing PMI'), ('Services', 'Services PMI')) e USING (report_type)
  WHERE NOT EXISTS (SELECT 1 FROM index_obs o WHERE o.report_date = i.report_date AND o.report_type = i.report_type AND o.index_name = e.index_name AND NOT (e.index_name LIKE '%PMI' AND month(i.report_date) % 2 = 1))""", GRID))
def missing_indices(spark, sf):
    return C.missing_indices(_report_ids(spark, sf), _headless(spark, sf))


@query("v20_merged_extractions", sql("industry_status", f"""SELECT {ID}, index_name, category, industry_name, row_number() OVER (PARTITION BY report_date, report_type, index_name, category ORDER BY late, rank, industry_name) - 1 AS rank FROM (
    SELECT m.*, CASE WHEN (lead_a AND NOT in_a) OR (NOT lead_a AND NOT in_b) THEN 1 ELSE 0 END AS late FROM (
      SELECT *, rank % 3 <> 0 AS in_a, rank % 4 <> 1 AS in_b FROM industry_status WHERE rank % 3 <> 0 OR rank % 4 <> 1) m
    JOIN (SELECT report_date, report_type, count(*) FILTER (rank % 3 <> 0) >= count(*) FILTER (rank % 4 <> 1) AS lead_a FROM industry_status GROUP BY ALL) USING (report_date, report_type)) s"""))
def merged_extractions(spark, sf):
    rows = cut_lineage(_mentions(spark, sf).select("report_id", "index_name", "category", "industry_name", "rank"))
    return C.merge_extractions(rows.where(F.col("rank") % 3 != 0), rows.where(F.col("rank") % 4 != 1))


@query("v21_validated_reports", sql("index_obs", """SELECT report_id, report_type, index_name, round(value, 6) AS value, direction, inferred, substr(report_id, 1, 10) AS report_date FROM (
  SELECT report_id, report_type, index_name, value, CASE WHEN direction IN ('Increasing') THEN 'Growing' WHEN direction = 'Decreasing' THEN 'Contracting' ELSE direction END AS direction, inferred FROM imputed)""", HEADLESS))
def validated_reports(spark, sf):
    rows = _headless(spark, sf).select(
        "report_id", F.date_format("report_date", "MMM-yy").alias("month_text"),
        F.when(F.col("report_type") == "Services", "svc").otherwise("mfg").alias("report_type"), "index_name",
        F.concat(F.format_number("value", 1), F.lit("%")).alias("value_text"), F.upper("direction").alias("direction"))
    return _rounded(C.validated_reports(rows), {"value": 6})
