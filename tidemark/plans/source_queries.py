"""Registered queries over sources and sinks; files are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.operators import index_series as X
from tidemark.plans import bindings as B
from tidemark.plans.oracle_tables import direction, negative, positive, sql, sql_list
from tidemark.plans.portfolio_queries import _rounded
from tidemark.plans.registry import query
from tidemark.runtime import scratch_path
from tidemark.sources import feeds as S
from tidemark.sources import index_csv as I
from tidemark.sources import tables as K

DATE = "CAST(report_date AS VARCHAR) AS report_date"
OBS = sql("index_obs", f"SELECT {DATE}, report_type, index_name, index_value, {direction('index_name', 'index_value')} AS direction FROM index_obs WHERE report_type = 'Manufacturing'")


def _wide(spark, sf):
    """The manufacturing months as a wide table with 'Mon-yy' labels and blank markers."""
    wide = X.heatmap(B.index_obs(spark, sf), "Manufacturing")
    cells = [F.coalesce(F.format_number(F.col(f"`{c}`"), 1), F.lit("n/a")).alias(c) for c in wide.columns[1:]]
    return wide.select(F.date_format(F.to_date("Month", "MM/dd/yyyy"), "MMM-yy").alias("Month"), *cells)


@query("s01_index_csv", OBS)
def index_csv(spark, sf):
    path = scratch_path(spark, "index-csv")
    _wide(spark, sf).write.option("header", True).csv(path)
    return I.read_index_csv(spark, path)


@query("s02_numbered_csv", OBS)
def numbered_csv(spark, sf):
    path = scratch_path(spark, "numbered-csv")
    wide = _wide(spark, sf).coalesce(1)
    numbered = wide.select((F.monotonically_increasing_id() + 1).alias("No"), "*")
    numbered.write.option("header", True).csv(path)
    if not I.has_row_numbers(spark, path):
        raise ValueError("row-number column not recognised")
    return I.read_index_csv(spark, path)


CONFIG_SQL = sql("index_obs", f"""SELECT report_type, index_name, array_to_string([{positive('index_name')}, {negative('index_name')}], '|') AS categories
  FROM (SELECT DISTINCT report_type, index_name FROM index_obs)""")


def _config_folder(spark, sf):
    """One config file per report type, from the observed indices, one as JSON and one as YAML; a broken file of each form beside them."""
    folder = scratch_path(spark, "configs")
    obs = B.index_obs(spark, sf).select("report_type", "index_name").distinct()
    pos, neg = B.category_columns(F.col("index_name"))
    listed = obs.groupBy("report_type").agg(
        F.array_sort(F.collect_list("index_name")).alias("indices"),
        F.map_from_entries(F.collect_list(F.when(F.col("index_name") != "Prices", F.struct("index_name", F.array(pos, neg))))).alias("index_categories"))
    items = F.array_join(F.transform("indices", lambda x: F.concat(F.lit("  - "), x)), "\n")
    pairs = F.array_join(F.transform(F.map_entries("index_categories"), lambda e: F.concat(F.lit('  "'), e["key"], F.lit('": ['), F.array_join(e["value"], ", "), F.lit("]"))), "\n")
    forms = {"Manufacturing": ("json", F.to_json(F.struct("indices", "index_categories"))),
             "Services": ("yaml", F.concat(F.lit("# observed indices\nindices:\n"), items, F.lit("\nindex_categories:\n"), pairs))}
    for kind, (form, text) in forms.items():
        listed.where(F.col("report_type") == kind).select(text.alias("value")).coalesce(1).write.text(f"{folder}/{kind.lower()}_config.{form}")
    for form in ("json", "yml"):
        listed.limit(1).select(F.lit("{invalid json").alias("value")).coalesce(1).write.text(f"{folder}/broken_config.{form}")
    return I.read_report_configs(spark, folder)


@query("s03_report_configs", sql("index_obs", "SELECT report_type, count(DISTINCT index_name) AS index_count, string_agg(DISTINCT index_name, '|' ORDER BY index_name) AS indices FROM index_obs GROUP BY report_type"))
def report_configs(spark, sf):
    configs = _config_folder(spark, sf)
    return configs.select("report_type", F.size("indices").cast("bigint").alias("index_count"),
                          F.array_join("indices", "|").alias("indices"))


@query("s04_index_categories", CONFIG_SQL)
def index_categories(spark, sf):
    configs = _config_folder(spark, sf)
    indices = B.index_obs(spark, sf).select("report_type", "index_name").distinct()
    return I.categories_of(configs, indices).withColumn("categories", F.array_join("categories", "|"))


# ---- article feeds ------------------------------------------------------------------------
CUTOFF = "2024-02-01"


def _feed_base(spark, sf):
    return B.articles(spark, sf).select("seq", "company", "title", "snippet", "link", "published", "section",
                                        F.to_date(F.substring("published", 1, 8), "yyyyMMdd").alias("day"))


def _sentiment(spark, sf):
    seq = F.col("seq")
    one = F.struct(F.lit("ABC").alias("ticker"), F.lit("0.25").alias("relevance_score"), F.lit("0.5").alias("ticker_sentiment_score"), F.lit("Bullish").alias("ticker_sentiment_label"))
    other = F.struct(F.lit("XYZ").alias("ticker"), F.lit("0.9").alias("relevance_score"), F.lit("-1").alias("ticker_sentiment_score"), F.lit("Bearish").alias("ticker_sentiment_label"))
    item = F.struct(
        F.when(seq % 10 == 3, " ").otherwise(F.col("title")).alias("title"), F.col("snippet").alias("summary"), F.col("link").alias("url"),
        F.when(seq % 9 == 2, "soon").otherwise(F.col("published")).alias("time_published"),
        F.when(seq % 2 == 0, F.array(other, one)).otherwise(F.array(other)).alias("ticker_sentiment"))
    payloads = _feed_base(spark, sf).select("company", F.lit("ABC").alias("ticker"), F.to_json(F.struct(F.array(item).alias("feed"))).alias("payload"))
    return S.sentiment_feed(payloads, F.lit(CUTOFF).cast("date"))


DAY = "CAST(strptime(left(published, 8), '%Y%m%d') AS DATE) AS day"
SENTIMENT_SQL = f"""SELECT company, trim(title) AS title, left(trim(snippet), 300) AS snippet, trim(snippet) AS full_content, link, regexp_extract(link, '://(?:www\\.)?([^/]*)', 1) AS source,
    CASE WHEN seq % 9 = 2 THEN 'soon' ELSE published END AS published, 'alphavantage_premium' AS source_type, CASE WHEN seq % 2 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS sentiment_score,
    CASE WHEN seq % 2 = 0 THEN 'Bullish' ELSE 'Neutral' END AS sentiment_label, CASE WHEN seq % 2 = 0 THEN 0.25 ELSE 0 END::DOUBLE AS relevance_score
  FROM (SELECT *, {DAY} FROM articles) WHERE seq % 10 <> 3 AND trim(title) <> '' AND (seq % 9 = 2 OR day >= DATE '{CUTOFF}')"""


@query("s05_sentiment_feed", sql("articles", SENTIMENT_SQL))
def sentiment_feed(spark, sf):
    return _sentiment(spark, sf)


def _newspaper(spark, sf):
    seq = F.col("seq")
    item = F.struct(
        F.struct(F.col("title").alias("main")).alias("headline"), F.when(seq % 4 == 0, "").otherwise(F.col("title")).alias("abstract"),
        F.when(seq % 3 == 0, F.when(seq % 4 == 0, "").otherwise(F.col("title"))).otherwise(F.col("snippet")).alias("lead_paragraph"), F.col("link").alias("web_url"),
        F.when(seq % 9 == 2, "n.d.").otherwise(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T10:00:00+0000"))).alias("pub_date"), F.col("section").alias("section_name"))
    payloads = _feed_base(spark, sf).select("company", F.to_json(F.struct(F.array(item).alias("docs"))).alias("payload"))
    return S.newspaper_feed(payloads, F.lit(CUTOFF).cast("date"))


NEWSPAPER_SQL = f"""SELECT company, t AS title, CASE WHEN content <> '' THEN left(content, 400) ELSE title END AS snippet, content AS full_content, link, 'nytimes.com' AS source,
    CASE WHEN seq % 9 = 2 THEN 'n.d.' ELSE strftime(day, '%Y-%m-%d') || 'T10:00:00+0000' END AS published, 'nyt_api' AS source_type, section
  FROM (SELECT *, {DAY}, trim(title) AS t, CASE WHEN seq % 4 = 0 AND seq % 3 = 0 THEN '' WHEN seq % 4 = 0 THEN trim(snippet) WHEN seq % 3 = 0 OR trim(snippet) = trim(title) OR trim(snippet) = '' THEN trim(title) ELSE trim(title) || ' ' || trim(snippet) END AS content FROM articles)
  WHERE t <> '' AND (seq % 9 = 2 OR day >= DATE '{CUTOFF}')"""


@query("s06_newspaper_feed", sql("articles", NEWSPAPER_SQL))
def newspaper_feed(spark, sf):
    return _newspaper(spark, sf)


def _rss(spark, sf):
    entries = _feed_base(spark, sf).select(
        "company", F.array("company").alias("terms"), F.concat(F.lit("feed"), (F.col("seq") % 3).cast("string")).alias("feed"), "seq", "title", "link",
        F.concat(F.lit("<p>"), F.col("snippet"), F.lit("</p>")).alias("description"), F.when(F.col("seq") % 9 != 2, F.col("day")).alias("published"))
    return S.rss_feed(entries, F.lit(CUTOFF).cast("date"))


_RSS_ANY = " OR ".join(f"contains(content, '{w}')" for w in V.RSS_FINANCE_WORDS)
RSS_SQL = f"""SELECT company, t AS title, left(body, 300) AS snippet, body AS full_content, link, regexp_extract(link, '://(?:www\\.)?([^/]*)', 1) AS source, CASE WHEN seq % 9 = 2 THEN '' ELSE CAST(day AS VARCHAR) END AS published, 'rss_feed' AS source_type
  FROM (SELECT *, CASE WHEN plain <> '' THEN plain ELSE t END AS body, lower(t) || ' ' || lower(plain) AS content FROM (
    SELECT *, {DAY}, trim(title) AS t, left(regexp_replace('<p>' || snippet || '</p>', '<[^>]+>', '', 'g'), 400) AS plain, row_number() OVER (PARTITION BY company, seq % 3 ORDER BY seq) AS place FROM articles))
  WHERE place <= 20 AND t <> '' AND (seq % 9 = 2 OR day >= DATE '{CUTOFF}') AND (contains(content, lower(company)) OR {_RSS_ANY})"""


@query("s07_rss_feed", sql("articles", RSS_SQL))
def rss_feed(spark, sf):
    return _rss(spark, sf)


def _search(spark, sf):
    rows = _feed_base(spark, sf)
    present = rows.where(F.col("seq") % 4 == 0).select("company", "link")
    return S.search_feed(rows.select("seq", "company", "title", "snippet", "link"), present)


SEARCH_SQL = """SELECT company, title, snippet, snippet AS full_content, link, regexp_extract(link, '://(?:www\\.)?([^/]*)', 1) AS source, 'google_search' AS source_type FROM articles a
  WHERE NOT EXISTS (SELECT 1 FROM articles p WHERE p.seq % 4 = 0 AND p.company = a.company AND p.link = a.link) QUALIFY row_number() OVER (PARTITION BY company ORDER BY seq) <= 15"""


@query("s08_search_feed", sql("articles", SEARCH_SQL))
def search_feed(spark, sf):
    return _search(spark, sf)


@query("s09_all_feeds", sql("articles", f"""SELECT company, source_type, count(*) AS articles, count(DISTINCT link) AS links FROM (SELECT company, link, source_type FROM ({SENTIMENT_SQL}) UNION ALL SELECT company, link, source_type FROM ({NEWSPAPER_SQL})
  UNION ALL SELECT company, link, source_type FROM ({RSS_SQL}) UNION ALL SELECT company, link, source_type FROM ({SEARCH_SQL})) GROUP BY ALL"""))
def all_feeds(spark, sf):
    rows = S.all_feeds([_sentiment(spark, sf), _newspaper(spark, sf), _rss(spark, sf), _search(spark, sf)])
    return rows.groupBy("company", "source_type").agg(F.count(F.lit(1)).alias("articles"), F.countDistinct("link").alias("links"))


# ---- bars ---------------------------------------------------------------------------------
def _bar_payloads(spark, sf):
    """Yearly payloads per symbol: date -> bar fields as texts; some bars are malformed."""
    daily = B.prices_daily(spark, sf).select(
        "symbol", "date", F.year("date").alias("y"), *[F.col(c).cast("decimal(18,4)").cast("string").alias(c) for c in ("high", "low", "close")], F.col("volume").cast("string").alias("volume"))
    d = F.dayofmonth("date")
    bar = F.struct(F.col("low").alias("open"), "high", F.when(d == 13, "n/a").otherwise(F.col("low")).alias("low"), "close",
                   F.when(d % 2 == 0, F.col("close")).alias("adj_close"), "volume")
    return daily.groupBy("symbol", "y").agg(F.map_from_entries(F.collect_list(
        F.struct(F.date_format("date", "yyyy-MM-dd"), bar))).alias("m")).select("symbol", F.to_json("m").alias("payload"))


@query("s10_daily_bar_feed", sql("prices", "SELECT symbol, CAST(date AS VARCHAR) AS moment, CAST(volume AS VARCHAR) AS volume FROM prices"))
def daily_bar_feed(spark, sf):
    return S.bar_rows(_bar_payloads(spark, sf)).select("symbol", "moment", "volume")


@query("s11_normal_bars", sql("prices", "SELECT symbol, CAST(date AS VARCHAR) AS date, round(adj_close, 4) AS adj_close, volume FROM prices WHERE day(date) <> 13"))
def normal_bars(spark, sf):
    rows = S.normal_bars(S.bar_rows(_bar_payloads(spark, sf)))
    return rows.select("symbol", "date", F.round(F.col("adj_close").cast("double"), 4).alias("adj_close"), "volume")


@query("s12_intraday_bars", """SELECT event_type AS symbol, strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS moment, max(value) AS high, min(value) AS low, count(*) AS volume FROM events GROUP BY ALL""")
def intraday_bars(spark, sf):
    slot = F.window(F.col("ts"), "30 minutes")["start"]
    bars = B.table(spark, sf, "events").groupBy(F.col("event_type").alias("symbol"), slot.alias("slot")).agg(
        F.max("value").alias("high"), F.min("value").alias("low"), F.count(F.lit(1)).alias("volume"))
    text = {c: F.col(c).cast("decimal(18,4)").cast("string") for c in ("high", "low")}
    bar = F.struct(text["low"].alias("open"), text["high"].alias("high"), text["low"].alias("low"), text["high"].alias("close"),
                   F.lit(None).cast("string").alias("adj_close"), F.col("volume").cast("string").alias("volume"))
    payloads = bars.groupBy("symbol", F.to_date("slot").alias("day")).agg(F.map_from_entries(F.collect_list(
        F.struct(F.date_format("slot", "yyyy-MM-dd'T'HH:mm:ss"), bar))).alias("m")).select("symbol", F.to_json("m").alias("payload"))
    rows = S.normal_bars(S.bar_rows(payloads), intraday=True)
    return rows.select("symbol", "moment", F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low"), "volume")


# ---- sinks --------------------------------------------------------------------------------
@query("s13_upserted_facts", sql("index_obs", f"SELECT {DATE}, report_type, index_name, CASE WHEN month(s.report_date) % 3 = 0 THEN index_value + 1 ELSE index_value END AS index_value, CASE WHEN month(s.report_date) % 3 = 0 THEN 2 ELSE 1 END AS version FROM index_obs s"))
def upserted_facts(spark, sf):
    path, keys = scratch_path(spark, "facts"), ["report_date", "report_type", "index_name"]
    obs = B.index_obs(spark, sf).withColumn("version", F.lit(1))
    K.upsert(obs, path, keys, "version", "report_date")
    changed = obs.where(F.month("report_date") % 3 == 0).withColumn("index_value", F.col("index_value") + 1).withColumn("version", F.lit(2))
    K.upsert(changed, path, keys, "version", "report_date")
    return spark.read.parquet(path).select("report_date", "report_type", "index_name", "index_value", "version")


@query("s14_upserted_prices", sql("prices", "SELECT upper(symbol) AS symbol, CAST(date AS VARCHAR) AS date, volume + CASE WHEN year(date) >= 2000 THEN 1 ELSE 0 END AS volume FROM prices"))
def upserted_prices(spark, sf):
    path = scratch_path(spark, "prices")
    rows = B.prices_daily(spark, sf).select(F.upper("symbol").alias("symbol"), "date", "volume", F.year("date").alias("y"), F.lit(1).alias("version"))
    K.upsert(rows, path, ["symbol", "date"], "version", "y")
    late = rows.where(F.col("y") >= 2000).withColumn("volume", F.col("volume") + 1).withColumn("version", F.lit(2))
    K.upsert(late, path, ["symbol", "date"], "version", "y")
    return spark.read.parquet(path).select("symbol", "date", "volume")


@query("s14_new_instruments", sql("prices", "SELECT DISTINCT upper(symbol) AS symbol FROM prices WHERE upper(symbol) NOT IN (SELECT upper(p_brand) FROM part WHERE p_size > 48)"))
def new_instruments(spark, sf):
    known = B.table(spark, sf, "part").where(F.col("p_size") > 48).select(F.col("p_brand").alias("symbol"))
    return K.missing_dimension_rows(B.prices_daily(spark, sf), known, "symbol")


@query("s15_appended_log", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS log_date, event_type, 2 * count(*) AS calls FROM events GROUP BY ALL")
def appended_log(spark, sf):
    path = scratch_path(spark, "log")
    rows = B.table(spark, sf, "events").select("ts", "event_type", "value")
    K.append_log(rows, path, "ts")
    K.append_log(rows, path, "ts")
    return spark.read.parquet(path).groupBy("log_date", "event_type").agg(F.count(F.lit(1)).alias("calls"))


@query("s16_published_heatmap", sql("index_obs", """SELECT strftime(report_date, '%m/%d/%Y') AS "Month", CASE WHEN year(report_date) >= 1999 THEN 2 ELSE 1 END AS version,
  max(CASE WHEN index_name = 'Manufacturing PMI' THEN index_value END) AS "PMI", max(CASE WHEN index_name = 'Imports' THEN index_value END) AS "Imports" FROM index_obs WHERE report_type = 'Manufacturing' GROUP BY report_date"""))
def published_heatmap(spark, sf):
    path = scratch_path(spark, "published")
    rows = X.heatmap(B.index_obs(spark, sf), "Manufacturing").select(
        "Month", "PMI", "Imports", F.substring("Month", 7, 4).alias("y"))
    first = rows.withColumn("PMI", F.when(F.col("y") >= "1999", 0.0).otherwise(F.col("PMI"))).withColumn("version", F.lit(1))
    K.upsert(first, path, ["Month"], "version", "y")
    K.upsert(rows.where(F.col("y") >= "1999").withColumn("version", F.lit(2)), path, ["Month"], "version", "y")
    return spark.read.parquet(path).select("Month", "PMI", "Imports", "version")


EXPORT_SQL = "SELECT event_id, event_type, value, props FROM events"


@query("s17_exported_csv", EXPORT_SQL)
def exported_csv(spark, sf):
    path = scratch_path(spark, "export-csv")
    K.export_csv(B.table(spark, sf, "events").select("event_id", "event_type", "value", "props"), path)
    return spark.read.schema("event_id bigint, event_type string, value double, props string").option("header", True).option(
        "escape", "\\").csv(path)


@query("s17_exported_json", EXPORT_SQL)
def exported_json(spark, sf):
    path = scratch_path(spark, "export-json")
    K.export_json(B.table(spark, sf, "events").select("event_id", "event_type", "value", "props"), path)
    return spark.read.schema("event_id bigint, event_type string, value double, props string").json(path)


@query("s18_decoded_insights", """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k, 0::DOUBLE AS missing FROM events ORDER BY event_id DESC LIMIT 200""")
def decoded_insights(spark, sf):
    rows = K.decoded_column(B.table(spark, sf, "events").select("event_id", "props"), "props", "k string, missing string", ["k", "missing"])
    return K.newest(rows, "event_id", 200)


@query("s17_exported_report", """SELECT 30 AS period_days, count(*) AS total_records, round(avg(value), 6) AS average, count(*) AS listed, CAST(max(event_id) AS BIGINT) AS newest
  FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY""")
def exported_report(spark, sf):
    path = scratch_path(spark, "export-report")
    events = B.table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    recent = events.where(F.col("ts") > events.agg(F.max("ts")).scalar() - F.make_dt_interval(F.lit(30)))
    K.export_report(events, path, "ts", events.agg(F.max("ts")).scalar(), 30, recent.agg(F.avg("value").alias("average")))
    header = spark.read.schema("period_days int, total_records bigint, summary struct<average: double>").json(f"{path}/header")
    listed = spark.read.schema("event_id bigint").json(f"{path}/metrics").agg(F.count(F.lit(1)).alias("listed"), F.max("event_id").alias("newest"))
    return header.select("period_days", "total_records", F.round("summary.average", 6).alias("average")).join(listed, F.lit(True))


@query("s19_cascaded_delete", """SELECT name, key, count(*) AS n FROM (SELECT 'orders' AS name, o_orderkey AS key FROM orders WHERE o_custkey % 10 <> 0
    UNION ALL SELECT 'orders', -o_orderkey FROM orders WHERE o_custkey % 10 = 1
    UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)) GROUP BY name, key""")
def cascaded_delete(spark, sf):
    paths, to = ([scratch_path(spark, f"{state}-{name}") for name in ("orders", "lineitem")] for state in ("old", "new"))
    parent = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    late = parent.where(F.col("o_custkey") % 10 == 1).withColumn("key", -F.col("key"))
    K.inserted(parent, late.unionByName(parent), "key").write.parquet(paths[0])
    B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")).write.parquet(paths[1])
    K.rewritten_without(paths, parent.where(F.col("o_custkey") % 10 == 0), "key", to)
    left = [spark.read.parquet(p).groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "key", "n")
            for p, name in zip(to, ("orders", "lineitem"), strict=True)]
    return left[0].unionByName(left[1])


@query("s20_evolved_reports", sql("reports", f"SELECT {DATE}, month_year, file_path, CASE WHEN month(r.report_date) % 2 = 0 THEN report_type ELSE 'Manufacturing' END AS report_type, (year(r.report_date) * 12 + month(r.report_date)) * 2 + CASE WHEN r.report_type = 'Services' THEN 1 ELSE 0 END AS rank FROM reports r"))
def evolved_reports(spark, sf):
    # ids rise with the month; the new rank column takes them over
    reports = B.reports(spark, sf).withColumn("id", (F.year("report_date") * 12 + F.month("report_date")) * 2 + (F.col("report_type") == "Services").cast("int"))
    even = F.month("report_date") % 2 == 0
    old = reports.where(~even).drop("report_type")
    both = reports.where(even).unionByName(old, allowMissingColumns=True)
    return K.evolved(both, {"report_type": ("string", F.lit("Manufacturing")), "rank": ("int", F.col("id"))}).drop("id")
