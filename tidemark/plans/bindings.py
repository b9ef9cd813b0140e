"""Role tables built from the given tables, so every operator runs over the data at hand.

The operators only know roles (index observations, prices, portfolios, articles, ...). These
functions read the parquet tables with pruned columns and derive the role tables from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.dates import month_name
from tidemark.functions.text import lookup

COMPANIES = [
    "apple", "microsoft", "google", "amazon", "tesla", "meta", "nvidia", "netflix", "adobe",
    "salesforce", "oracle", "intel", "amd", "cisco", "boeing", "visa", "walmart", "nike",
    "zorgon works", "ABC",
]
DOMAINS = list(V.PREMIUM_SOURCES) + list(V.UNWANTED_SOURCES) + ["herald.example", "wire.example"]
SOURCE_TYPES = ["alphavantage_premium", "nyt_api", "rss_feed", "google_search"]
# prices are quoted in another currency at this rate
EXCHANGE_RATE = 0.917431192661
QUALITY_LABELS = ["Premium+", "Premium", "Institutional", "Professional", "Standard", "Limited"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a text table that may be dealt out: a fixed, small bound, whatever the cluster.
SMALL_BYTES = 64 << 20


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts. Scoring them is heavy per row, so one of at most SMALL_BYTES (a file or two, which Spark can't split) is dealt
    over the cores; a larger one is read as it is, without any exchange."""
    rows = table(spark, sf_dir, name)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL_BYTES else rows


def texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def pick(values: list[str], position: Column) -> Column:
    """Element of a fixed list at a zero-based position (taken modulo its length)."""
    return F.get(texts(values), (position % len(values)).cast("int"))


# ---- index reports ------------------------------------------------------------------------
def _index_key(orders: DataFrame) -> DataFrame:
    slot = (F.substring("o_orderpriority", 1, 1).cast("int") - 1) * 3 + (
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2))
    kind = F.when(F.col("o_custkey") % 2 == 0, "Manufacturing").otherwise("Services")
    return orders.select(
        F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("report_date"),
        kind.alias("report_type"),
        F.when(kind == "Manufacturing", pick(V.MANUFACTURING_INDICES, slot))
        .otherwise(pick(V.SERVICES_INDICES, slot)).alias("index_name"),
        "o_custkey", "o_totalprice",
    )


def index_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_date, report_type, index_name, index_value: one row per month, type and index."""
    keyed = _index_key(table(spark, sf_dir, "orders"))
    return keyed.groupBy("report_date", "report_type", "index_name").agg(
        F.round(F.avg("o_totalprice") / 4500, 1).alias("index_value"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per month and report type."""
    keys = _index_key(table(spark, sf_dir, "orders")).select("report_date", "report_type").distinct()
    return keys.select(
        "report_date", "report_type", month_name(F.col("report_date")).alias("month_year"),
        F.concat(F.lit("reports/"), F.date_format("report_date", "yyyy-MM"), F.lit("-"),
                 F.lower("report_type"), F.lit(".txt")).alias("file_path"))


def category_columns(name: Column) -> tuple[Column, Column]:
    positive = F.coalesce(lookup(name, {k: v[0] for k, v in V.CATEGORIES.items()}),
                          F.lit(V.DEFAULT_CATEGORIES[0]))
    negative = F.coalesce(lookup(name, {k: v[1] for k, v in V.CATEGORIES.items()}),
                          F.lit(V.DEFAULT_CATEGORIES[1]))
    return positive, negative


def industry_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked industries per month, type and index; raw_industry carries spelling variants."""
    keyed = _index_key(table(spark, sf_dir, "orders"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = keyed.join(customer, keyed.o_custkey == customer.c_custkey)
    named = joined.withColumn(
        "industry_name",
        F.when(F.col("report_type") == "Manufacturing",
               pick(V.MANUFACTURING_INDUSTRIES, F.col("c_nationkey")))
        .otherwise(pick(V.SERVICES_INDUSTRIES, F.col("c_nationkey"))))
    totals = named.groupBy("report_date", "report_type", "index_name", "industry_name").agg(
        F.sum("o_totalprice").alias("amount"))
    group = W.partitionBy("report_date", "report_type", "index_name")
    ranked = totals.withColumn(
        "rank", F.row_number().over(group.orderBy(F.desc("amount"), "industry_name")) - 1
    ).withColumn("mean_amount", F.avg("amount").over(group))
    positive, negative = category_columns(F.col("index_name"))
    variant = (F.col("rank") + F.month("report_date")) % 6
    name = F.col("industry_name")
    raw = (F.when(variant == 1, F.lower(name))
           .when(variant == 2, F.replace(name, F.lit(" & "), F.lit(" and ")))
           .when(variant == 3, F.regexp_replace(name, r" Products$", ""))
           .when(variant == 4, F.concat(F.lit("the "), name))
           .when(variant == 5, F.concat(name, F.lit(" (1)")))
           .otherwise(name))
    return ranked.select(
        "report_date", "report_type", "index_name", "industry_name",
        F.when(F.col("amount") > F.col("mean_amount"), positive).otherwise(negative).alias("category"),
        F.col("rank").cast("int").alias("rank"), raw.alias("raw_industry"))


REPORT_SLOTS = 11


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report text per document: glance table, the document as comment section, summaries."""
    docs = text_table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = F.when(F.col("doc_id") % 2 == 0, "Manufacturing").otherwise("Services")
    month_no = (F.col("doc_id") % 120).cast("int")
    docs = docs.select(
        "doc_id", "text", kind.alias("report_type"),
        F.add_months(F.lit("2015-01-01").cast("date"), month_no).alias("report_date"))
    docs = docs.withColumn("month_year", month_name(F.col("report_date")))
    names = F.when(F.col("report_type") == "Manufacturing", texts(V.MANUFACTURING_INDICES)).otherwise(
        texts(V.SERVICES_INDICES))
    industries = F.when(F.col("report_type") == "Manufacturing",
                        texts(V.MANUFACTURING_INDUSTRIES)).otherwise(texts(V.SERVICES_INDUSTRIES))
    docs = docs.withColumn("names", names).withColumn("industries", industries)

    def value(i: Column) -> Column:
        v = F.lit(300) + (F.col("doc_id") * 37 + i * 101) % 400
        return F.concat(F.floor(v / 10).cast("string"), F.lit("."), (v % 10).cast("string"))

    def high(i: Column) -> Column:
        return (F.col("doc_id") * 37 + i * 101) % 400 >= 200

    def direction(i: Column) -> Column:
        name = F.get(F.col("names"), i)
        return (F.when(name == "Supplier Deliveries", F.when(high(i), "Slowing").otherwise("Faster"))
                .when(name.isin("Customers' Inventories", "Inventory Sentiment"),
                      F.when(high(i), "Too High").otherwise("Too Low"))
                .when(name == "Prices", F.when(high(i), "Increasing").otherwise("Decreasing"))
                .otherwise(F.when(high(i), "Growing").otherwise("Contracting")))

    def glance(i: Column) -> Column:
        name = F.get(F.col("names"), i)
        mark = F.when(name.endswith("PMI"), "®").otherwise("")
        return F.concat(name, mark, F.lit(" at "), value(i), F.lit(" percent, "), direction(i))

    def industry(i: Column, offset: int) -> Column:
        return F.get(F.col("industries"), ((F.col("doc_id") + i * 5 + offset) % 18).cast("int"))

    def summary(i: Column) -> Column:
        name = F.get(F.col("names"), i)
        positive, negative = category_columns(name)
        month = F.date_format("report_date", "MMMM")
        variant = (F.col("doc_id") + i) % 3  # the same facts in other words
        up = (F.when((positive == "Slower") & (variant == 1), "slower deliveries")
              .when((positive == "Higher") & (variant == 1), "growth in inventories")
              .when((positive == "Increasing") & (variant == 1), "paying higher prices")
              .when((name == "Employment") & (variant == 1), "employment growth")
              .when(positive == "Slower", "slower supplier deliveries")
              .when(positive == "Higher", "higher inventories")
              .when(positive == "Too High", F.concat(F.lower(name), F.lit(" as too high")))
              .when(positive == "Increasing", "increased prices")
              .otherwise(F.concat(F.lit("growth in "), F.lower(name))))
        down = (F.when((name == "Backlog of Orders") & (variant == 1), "lower order backlogs")
                .when((name == "Imports") & (variant == 1), "lower volumes of imports")
                .when((negative == "Decreasing") & (variant == 1), "paying decreased prices")
                .when(negative == "Faster", "faster supplier deliveries")
                .when(negative == "Lower", "lower inventories")
                .when(negative == "Too Low", F.concat(F.lower(name), F.lit(" as too low")))
                .when(negative == "Decreasing", "decreased prices")
                .otherwise(F.concat(F.lit("a decline in "), F.lower(name))))
        moved = F.when(high(i), ", growing compared with the prior month. ").otherwise(
            ", contracting compared with the prior month. ")
        change = F.when((F.col("doc_id") + i) % 5 == 0, "The index increased 3.1 percent. ").otherwise("")
        both = F.when((F.col("doc_id") + i) % 6 == 2, F.concat(F.lit("; "), industry(i, 0))).otherwise("")
        verb = F.when(variant == 0, "reporting ").otherwise("that reported ")
        are = F.when(variant == 2, " are ").otherwise(" are: ")
        listed = F.concat(
            F.lit("The three industries "), verb, up, F.lit(" in "), month,
            F.lit(" — listed in order — are: "), industry(i, 0), F.lit("; "), industry(i, 4),
            F.lit("; and "), industry(i, 8), F.lit(". The industries "), verb, down, F.lit(" in "),
            month, are, industry(i, 2), F.lit("; "), industry(i, 6), both, F.lit("."))
        sentence = F.lit("Growth was seen in sectors including Machinery, Primary Metals. "
                         "Activity declined in sectors including Textile Mills, Wood Products.")
        body = F.when((F.col("doc_id") + i) % 7 == 3, sentence).otherwise(listed)
        mark = F.when(name.endswith("PMI"), "®").otherwise("")
        return F.concat(F.upper(name), F.lit("\nThe "), name, mark, F.lit(" Index registered "),
                        value(i), F.lit(" percent in "), F.col("month_year"), moved, change, body,
                        F.lit("\n"))

    slots = F.sequence(F.lit(0), F.lit(REPORT_SLOTS - 1))
    upper = F.upper("report_type")
    body = F.concat(
        F.col("month_year"), F.lit(" "), upper, F.lit(" INDEX REPORT\n\n"), upper,
        F.lit(" AT A GLANCE\n"), F.upper("month_year"), F.lit("\n\n"),
        F.array_join(F.transform(slots, glance), "\n"),
        F.lit("\nOVERALL ECONOMY Growing\n\nWHAT RESPONDENTS ARE SAYING\n"), F.col("text"),
        F.lit("\n\n"), upper, F.lit(" INDEX SUMMARIES\n\n"),
        F.array_join(F.transform(slots, summary), "\n"), F.lit("\nBUYING POLICY\nNo change.\n"))
    return docs.select(
        "doc_id", "report_type", "report_date", "month_year",
        F.concat(F.lit("report_"), F.date_format("report_date", "MMM_yy"), F.lit("_"),
                 F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name"),
        F.date_add("report_date", 40).alias("modified"), F.inline(F.array(F.struct(body.alias("text")))))


# ---- prices and portfolios ----------------------------------------------------------------
def prices_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, open/high/low/close/adj_close, volume per brand and ship date."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    unit = F.col("l_extendedprice") / F.col("l_quantity") * EXCHANGE_RATE
    daily = items.join(part, items.l_partkey == part.p_partkey).groupBy(
        F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("date").alias("date")
    ).agg(F.sum("l_extendedprice").alias("amount"), F.sum("l_quantity").alias("quantity"),
          F.max(unit).alias("high"), F.min(unit).alias("low"))
    span = W.partitionBy("symbol").orderBy("date").rowsBetween(-29, 0)
    close = F.sum("amount").over(span) / F.sum("quantity").over(span) * EXCHANGE_RATE
    return daily.select(
        "symbol", "date", "high", "low", close.alias("close"), close.alias("adj_close"),
        F.col("quantity").cast("bigint").alias("volume"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand_no = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), brand_no.alias("no")).distinct().select(
        "symbol", F.concat(F.lit("Company "), F.col("no").cast("string")).alias("name"),
        F.when(F.col("no") % 2 == 0, "NYSE").otherwise("NASDAQ").alias("exchange"),
        F.concat(F.lit("S"), (F.col("no") % 5).cast("string")).alias("sector"))


def _orders_by_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey", F.col("c_nationkey").alias("portfolio_id"),
        F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("quarter_start"))


def portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One portfolio per nation; even ones hold weights, odd ones share counts."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        key.alias("portfolio_id"), F.concat(F.lit("user"), (key % 7).cast("string")).alias("user_id"),
        F.col("n_name").alias("name"),
        F.when(key % 2 == 0, "weight").otherwise("quantity").alias("allocation_type"))


def _version_columns() -> list[Column]:
    hours = F.make_dt_interval(F.lit(0), (F.col("portfolio_id") % 24).cast("int"))
    return [
        F.concat_ws("-", F.col("portfolio_id").cast("string"),
                    F.date_format("quarter_start", "yyyyMM")).alias("version_id"),
        (F.col("quarter_start").cast("timestamp_ntz") + hours).alias("effective_at"),
    ]


def portfolio_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly snapshots, effective some hours into their first day."""
    base = _orders_by_portfolio(spark, sf_dir).select("portfolio_id", "quarter_start").distinct()
    number = F.row_number().over(W.partitionBy("portfolio_id").orderBy("quarter_start"))
    return base.select("portfolio_id", number.alias("version_number"), *_version_columns())


def portfolio_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """version_id, symbol, value (weights in weight mode, share counts otherwise)."""
    held = _orders_by_portfolio(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = items.join(part, items.l_partkey == part.p_partkey).join(
        held, items.l_orderkey == held.o_orderkey)
    summed = joined.groupBy("portfolio_id", "quarter_start", F.col("p_brand").alias("symbol")).agg(
        F.sum("l_quantity").alias("quantity"))
    total = F.sum("quantity").over(W.partitionBy("portfolio_id", "quarter_start"))
    value = F.when(F.col("portfolio_id") % 2 == 0, F.col("quantity") / total).otherwise(F.col("quantity"))
    version_id, _ = _version_columns()
    return summed.select(version_id, "symbol", value.alias("value"))


# ---- news ---------------------------------------------------------------------------------
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article per document, requested for a company given by the document's source."""
    d = F.col("doc_id")
    source_no = F.coalesce(F.regexp_extract("source", r"(\d+)", 1).try_cast("int"), F.lit(0))
    company = pick(COMPANIES, source_no)
    boost = F.when(d % 3 == 0, F.concat(
        F.lit(" "), company, F.lit(" reported quarterly results: revenue up 15% to $3.2b in Q1 2024 and "
                                   "earnings beat. The analyst raised the price target for "), company,
        F.lit(" stock."))).when(d % 7 == 1, F.lit(" Apply for a job listing in the directory.")).otherwise("")
    body = F.concat(F.col("text"), boost)
    title_words = F.slice(F.split("text", r"\s+"), 1, 12)
    title = F.concat(F.array_join(title_words, " "),
                     F.when(d % 6 == 0, F.concat(F.lit(" "), company)).otherwise(""))
    kind = pick(SOURCE_TYPES, F.floor(d / 2))
    domain = pick(DOMAINS, d * 5 + F.floor(d / 18))
    link_no = F.when(d % 10 == 9, d - 1).otherwise(d)
    score = (F.pmod(d * 13, F.lit(201)) - 100) / 100
    premium = kind == "alphavantage_premium"
    return text_table(spark, sf_dir, "documents").select(
        d.alias("seq"), company.alias("company"), title.alias("title"), body.alias("snippet"),
        body.alias("full_content"),
        F.concat(F.lit("https://www."), pick(DOMAINS, link_no * 5 + F.floor(link_no / 18)), F.lit("/a/"),
                 link_no.cast("string")).alias("link"),
        domain.alias("source"), kind.alias("source_type"),
        F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (d % 90).cast("int")), "yyyyMMdd"),
                 F.lit("T"), F.lpad((d % 24).cast("string"), 2, "0"), F.lit("3000")).alias("published"),
        F.when(premium, score).alias("sentiment_score"),
        F.when(premium, F.when(score > 0.2, "Bullish").when(score < -0.2, "Bearish").otherwise("Neutral"))
        .alias("sentiment_label"),
        F.when(premium, (d * 7 % 101) / 100).alias("relevance_score"),
        pick(V.NON_BUSINESS_SECTIONS + ["business", "markets", "technology"], d).alias("section"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with citation markers and three headed bullet sections."""
    rows = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    n = F.col("conv_id") % 9
    t = F.col("turn").cast("string")
    marks = F.concat(F.lit(" [^"), t, F.lit("] and (S"), n.cast("string"), F.lit("), { s"), t,
                     F.lit("} [12]"))
    bullets = F.concat(
        F.lit("**Executive Summary**\n- "), F.replace("text", F.lit("\n"), F.lit("\n• ")),
        F.when(F.col("turn") % 3 == 0, "\n\nInvestor Insights:\n* short\n").otherwise(
            F.concat(F.lit("\n\nInvestor Insights:\n* Margin moved <b>up</b> 15% to $3"), marks,
                     F.lit("\n- - Guidance kept at 10-12% for Q2 2024\n"))),
        F.lit("\n# Catalysts & Risks\nplain line\n• Revenue estimate 4.5x above target with 20% probability"))
    return rows.select("conv_id", "turn", F.concat("text", marks).alias("answer"), bullets.alias("analysis"))


# ---- monitoring ---------------------------------------------------------------------------
def api_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(*api_usage_columns())


def api_usage_columns() -> list[Column]:
    return [
        F.col("event_id"), F.col("ts"), F.col("event_type").alias("api_source"),
        (F.col("event_type") != "error").alias("success"), F.col("value").alias("response_time_ms"),
        (F.col("value") > 200).alias("rate_limited"),
    ]


def analysis_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysis request per event; article counts follow the event's own number."""
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    counts = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("company"),
        (k % 9).alias("alphavantage_articles"), (k % 5).alias("nyt_articles"),
        (k % 7).alias("rss_articles"), (e % 4).cast("int").alias("google_articles"),
        pick(QUALITY_LABELS, e).alias("analysis_quality"),
        (F.col("value") / 10).alias("response_time_seconds"),
        (e % 3 == 0).alias("escalated"), ((e * 7) % 101).cast("double").alias("relevance_percentage"))
    total = (F.col("alphavantage_articles") + F.col("nyt_articles") + F.col("rss_articles")
             + F.col("google_articles"))
    return counts.withColumn("total_articles", total).withColumn(
        "premium_sources", F.floor(F.col("total_articles") / 3).cast("int"))


# ---- company feeds ------------------------------------------------------------------------
def _decimal_text(value: Column) -> Column:
    return F.round(value, 2).cast("decimal(24,2)").cast("string")


def _quarter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return items.join(part, items.l_partkey == part.p_partkey).groupBy(
        F.col("p_brand").alias("symbol"),
        F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("fiscal_date")
    ).agg(F.sum("l_extendedprice").alias("amount"), F.sum("l_quantity").alias("quantity"),
          F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("discounted")
          ).withColumn("tag", F.regexp_extract("symbol", r"(\d+)", 1).cast("int") + F.month("fiscal_date")
                       + F.year("fiscal_date"))


def earnings_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, fiscal_date, reported_date, reported_eps, estimated_eps as feed texts."""
    q = _quarter_totals(spark, sf_dir)
    reported = _decimal_text((F.col("amount") - F.col("discounted")) / F.col("quantity") / 100)
    estimated = _decimal_text(F.col("amount") / F.col("quantity") / 105)
    return q.select(
        "symbol", "fiscal_date", F.date_add("fiscal_date", 30).alias("reported_date"),
        F.when(F.col("tag") % 11 == 0, "None").otherwise(reported).alias("reported_eps"),
        F.when(F.col("tag") % 13 == 0, "0").when(F.col("tag") % 17 == 0, "").otherwise(estimated).alias("estimated_eps"))


def statement_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per company: nested arrays of text-valued maps per statement kind and period."""
    q = _quarter_totals(spark, sf_dir)

    def entry(values: dict[str, Column]) -> Column:
        flat = [x for k, v in values.items() for x in (F.lit(k), v)]
        return F.create_map(F.lit("fiscalDateEnding"), F.date_format("fiscal_date", "yyyy-MM-dd"), *flat)

    income = entry({"totalRevenue": _decimal_text(F.col("amount") * 1000),
                    "netIncome": F.when(F.col("tag") % 11 == 0, "None").otherwise(
                        _decimal_text(F.col("discounted") * 3000 - F.col("amount") * 50))})
    balance = F.when(F.col("tag") % 7 != 0, entry({"totalShareholderEquity": F.when(
        F.col("tag") % 5 == 0, "0").otherwise(_decimal_text(F.col("amount") * 2500))}))
    cash = F.when(F.col("tag") % 9 != 0, entry({
        "operatingCashflow": _decimal_text(F.col("amount") * 200),
        "capitalExpenditures": _decimal_text(F.col("amount") * -70)}))
    yearly = F.month("fiscal_date") == 10

    def reports_of(item: Column, flag: Column | None = None) -> Column:
        shown = item if flag is None else F.when(flag, item)
        return F.collect_list(shown)

    return q.groupBy("symbol").agg(
        reports_of(income).alias("income_quarterly"), reports_of(income, yearly).alias("income_annual"),
        reports_of(balance).alias("balance_quarterly"), reports_of(balance, yearly).alias("balance_annual"),
        reports_of(cash).alias("cash_quarterly"), reports_of(cash, yearly).alias("cash_annual"))


def overview_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, name, sector, pe_ratio and profit_margin as feed texts."""
    no = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    base = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol"), no.alias("no")).agg(
        F.avg("p_retailprice").alias("mean_price"), F.avg("p_size").alias("mean_size"))
    return base.select(
        "symbol", F.concat(F.lit("Company "), F.col("no").cast("string")).alias("name"),
        F.when(F.col("no") % 9 == 8, "Unknown").otherwise(
            F.concat(F.lit("S"), (F.col("no") % 5).cast("string"))).alias("sector"),
        F.when(F.col("no") % 6 == 0, "None").otherwise(
            _decimal_text(F.col("mean_price") / (30 + 6 * (F.col("no") % 7)))).alias("pe_ratio"),
        F.when(F.col("no") % 10 == 0, "").otherwise(
            _decimal_text((F.col("no") % 4) * 0.06 + F.col("mean_size") / 1000)).alias("profit_margin"))


def news_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, title, time_published, overall score, ticker_sentiment and topics arrays."""
    d = F.col("doc_id")
    symbol = F.concat(F.lit("Brand#"), (d % 25 + 1).cast("string"))
    other = F.concat(F.lit("Brand#"), ((d + 7) % 25 + 1).cast("string"))
    score = (F.pmod(d * 29, F.lit(201)) - 100) / 100

    def sentiment(ticker: Column, value: Column) -> Column:
        return F.struct(
            ticker.alias("ticker"), F.lit("0.500000").alias("relevance_score"),
            F.round(value, 2).cast("decimal(6,2)").cast("string").alias("ticker_sentiment_score"),
            F.when(value > 0.15, "Bullish").when(value < -0.15, "Bearish").otherwise("Neutral")
            .alias("ticker_sentiment_label"))

    listed = F.when(d % 8 == 0, F.array(sentiment(other, score * -1))).otherwise(
        F.array(sentiment(other, score * -1), sentiment(symbol, score)))
    return table(spark, sf_dir, "documents").select(
        d.alias("article_id"), symbol.alias("symbol"),
        F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (d % 60).cast("int")), "yyyyMMdd"),
                 F.lit("T"), F.lpad((d % 24).cast("string"), 2, "0"), F.lit("1500")).alias("time_published"),
        (F.pmod(d * 17, F.lit(101)) - 50).cast("double").alias("raw_score"),
        ((F.pmod(d * 17, F.lit(101)) - 50) / 100).alias("overall_sentiment_score"),
        listed.alias("ticker_sentiment"),
        F.array(F.struct(F.col("lang").alias("topic")), F.struct(F.col("source").alias("topic"))).alias("topics")
    ).drop("raw_score")
