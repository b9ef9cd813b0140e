"""Registered queries over articles: relevance, duplicates, ranking, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.text import domain_of
from tidemark.operators import dedup as D
from tidemark.operators import relevance as R
from tidemark.operators.news_selection import select_articles
from tidemark.plans import bindings as B
from tidemark.plans.oracle_tables import quoted, sql, sql_list, sql_map
from tidemark.plans.portfolio_queries import _rounded
from tidemark.plans.registry import query


@query("n01_domains", """SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS domain FROM pages""")
def domains(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", domain_of(F.col("url")).alias("domain"))


TICKERS = {k: v[0] for k, v in V.COMPANY_ALIASES.items()}
NAMES = {k: v[1] for k, v in V.COMPANY_ALIASES.items()}


def _short(name: str, lower: bool) -> str:
    for suffix in V.COMPANY_SUFFIXES:
        name = f"replace({name}, {quoted(suffix.lower() if lower else suffix)}, '')"
    return name


RESOLVED = {
    "requests": """SELECT company FROM articles UNION SELECT 'Company ' || CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) FROM part
      UNION SELECT 'Q' || n_nationkey % 3 FROM nation UNION SELECT upper(substr(r_name, 1, 4)) FROM region""",
    "resolved": f"""SELECT r.company, CASE WHEN m_t IS NOT NULL THEN m_t WHEN tick THEN upper(r.company) ELSE i.symbol END AS ticker,
      CASE WHEN m_t IS NOT NULL THEN m_n WHEN tick THEN NULL ELSE r.company END AS company_name
      FROM (SELECT company, {sql_map(TICKERS)}[lower(trim(company))] AS m_t, {sql_map(NAMES)}[lower(trim(company))] AS m_n,
        length(trim(company)) <= 5 AND regexp_full_match(regexp_replace(upper(trim(company)), '[.-]', '', 'g'), '\\p{{L}}+') AS tick FROM requests) r
      LEFT JOIN instruments i ON lower(i.name) = lower(trim(r.company)) AND m_t IS NULL AND NOT tick"""}


def _requests(spark, sf):
    parts = [
        B.articles(spark, sf).select("company"),
        B.instruments(spark, sf).select(F.col("name").alias("company")),
        B.table(spark, sf, "nation").select(F.concat(F.lit("Q"), (F.col("n_nationkey") % 3).cast("string")).alias("company")),
        B.table(spark, sf, "region").select(F.upper(F.substring("r_name", 1, 4)).alias("company")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _resolved(spark, sf):
    return R.resolve_companies(_requests(spark, sf), B.instruments(spark, sf))


_BLANK = "company, coalesce(ticker, '') AS ticker, coalesce(company_name, '') AS company_name"


@query("n02_resolved_companies", sql(["articles", "instruments"], f"SELECT {_BLANK} FROM resolved", RESOLVED))
def resolved_companies(spark, sf):
    return _resolved(spark, sf).fillna("")


@query("n03_search_terms", sql(["articles", "instruments"], f"""SELECT company, array_to_string(list_slice(list_filter([trim(company),
    CASE WHEN ticker <> trim(company) THEN ticker END, CASE WHEN company_name <> trim(company) AND company_name IS DISTINCT FROM ticker THEN company_name END,
    CASE WHEN {_short('company_name', False)} <> company_name AND {_short('company_name', False)} <> trim(company) AND {_short('company_name', False)} IS DISTINCT FROM ticker THEN {_short('company_name', False)} END], lambda t: t IS NOT NULL), 1, 3), '|') AS terms FROM resolved""", RESOLVED))
def search_terms(spark, sf):
    return _resolved(spark, sf).select("company", F.array_join(R.search_terms(), "|").alias("terms"))


@query("n04_identifiers", sql(["articles", "instruments"], f"""SELECT company, array_to_string(list_sort(list_distinct(list_filter([lower(trim(company)), lower(ticker), lower(company_name), {_short('lower(company_name)', True)}], lambda t: t IS NOT NULL AND t <> ''))), '|') AS identifiers FROM resolved""", RESOLVED))
def identifiers(spark, sf):
    return _resolved(spark, sf).select("company", F.array_join(F.array_sort(R.identifiers()), "|").alias("identifiers"))


def _presence(text: str, weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, {quoted(k)}) THEN {v!r}::DOUBLE ELSE 0.0::DOUBLE END" for k, v in weights.items()) + ")"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def _hits(text: str, patterns) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({text}, {quoted(p)}, 0, 'i'))" for p in patterns) + ")"


ASSESSED = {
    "named": f"""SELECT a.*, {sql_map(TICKERS)}[lower(company)] AS ticker0, {sql_map(NAMES)}[lower(company)] AS name0,
      lower(title) || ' ' || lower(snippet) AS txt FROM articles a""",
    "named2": """SELECT *, coalesce(ticker0, CASE WHEN company = 'ABC' THEN 'ABC' END) AS ticker, CASE WHEN ticker0 IS NOT NULL THEN name0 WHEN company = 'ABC' THEN NULL ELSE company END AS company_name FROM named""",
    "ided": f"""SELECT *, list_distinct(list_filter([lower(company), lower(ticker), lower(company_name), {_short('lower(company_name)', True)}], lambda t: t IS NOT NULL AND t <> '')) AS ids,
      ' ' || regexp_replace(txt, '[^\\p{{L}}\\p{{N}}_]', '  ', 'g') || ' ' AS spaced FROM named2""",
    "parts": f"""SELECT *, round(least(list_sum(list_transform(ids, lambda i: (length(left(txt, 100)) - length(replace(left(txt, 100), i, ''))) // length(i) * 0.3::DOUBLE +
        (length(spaced) - length(replace(spaced, ' ' || regexp_replace(i, '[^\\p{{L}}\\p{{N}}_]', '  ', 'g') || ' ', ''))) // (length(regexp_replace(i, '[^\\p{{L}}\\p{{N}}_]', '  ', 'g')) + 2) * 0.2::DOUBLE))
        + list_sum(list_transform(ids, lambda i: (length(txt) - length(replace(txt, i, ''))) // length(i))) / len(list_filter(regexp_split_to_array(txt, '\\s+'), lambda w: w <> '')) * 10, 1.0), 9) AS m,
      round(least({_presence('txt', {k: v * 0.1 for k, v in V.FINANCE_KEYWORDS.items()})} + {_hits('txt', V.FINANCE_PATTERNS)} * 0.15::DOUBLE + {_presence('txt', {k: 0.1 for k in V.BUSINESS_PHRASES})}, 1.0), 9) AS f,
      round(least(CASE WHEN length(snippet) + length(full_content) > 500 THEN 0.3 WHEN length(snippet) + length(full_content) > 200 THEN 0.2 WHEN length(snippet) + length(full_content) > 100 THEN 0.1 ELSE 0 END::DOUBLE
        + coalesce({sql_map(V.SOURCE_TYPE_QUALITY)}[source_type], 0)::DOUBLE + CASE WHEN length(full_content) > 300 THEN 0.2 ELSE 0 END::DOUBLE
        + CASE WHEN sentiment_label IS NOT NULL THEN 0.1 ELSE 0 END::DOUBLE, 1.0), 9) AS q,
      round(coalesce({sql_map(V.PREMIUM_SOURCES)}[lower(source)], 0.3)::DOUBLE / 20, 9) AS s,
      round(least({_presence('txt', {k: 0.1 for k in V.NEGATIVE_INDICATORS})}, 0.5), 9) AS n FROM ided""",
    "overall": "SELECT *, round(least(greatest(m * 0.4::DOUBLE + f * 0.3::DOUBLE + q * 0.2::DOUBLE + s * 0.1::DOUBLE - n, 0.0), 1.0), 9) AS o FROM parts",
    "assessed": """SELECT *, r3(m) AS company_relevance, r3(f) AS financial_context, r3(q) AS content_quality, r3(s) AS source_quality, r3(o) AS overall_relevance, r3(n) AS negative_penalty,
      m >= 0.6 AND f >= 0.3 AND o >= 0.5 AS is_company_specific FROM overall""",
    "statistics": """SELECT company, count(*) AS total_articles, count(*) FILTER (is_company_specific) AS relevant_articles, avg(CAST(is_company_specific AS INTEGER)) AS relevance_share,
      avg(overall_relevance) AS average_relevance, count(*) FILTER (is_company_specific OR overall_relevance >= 0.3) AS lenient_articles FROM assessed GROUP BY company""",
    "relevant": "SELECT a.*, is_company_specific OR (total_articles < 10 AND overall_relevance >= 0.3) AS is_relevant FROM assessed a JOIN (SELECT company, total_articles FROM statistics) USING (company)"}
ASSESSED = {k: v.replace("r3(m)", "R(m)").replace("r3(f)", "R(f)").replace("r3(q)", "R(q)").replace("r3(s)", "R(s)").replace("r3(o)", "R(o)").replace("r3(n)", "R(n)") for k, v in ASSESSED.items()}
for _c in "mfqson":
    ASSESSED["assessed"] = ASSESSED["assessed"].replace(f"R({_c})", f"CAST(round(CAST({_c} AS DECIMAL(20,10)), 3) AS DOUBLE) + 0.0")


def _assessed(spark, sf):
    return R.assess(R.resolve_companies(B.articles(spark, sf)))


SCORES = ["company_relevance", "financial_context", "content_quality", "source_quality", "overall_relevance", "negative_penalty"]


def _score_query(name: str, columns: list[str]) -> None:
    @query(name, sql("articles", f"SELECT seq, company, {', '.join(columns)} FROM assessed", ASSESSED))
    def scores(spark, sf):
        return _assessed(spark, sf).select("seq", "company", *columns)


_score_query("n05_company_mentions", ["company_relevance"])
_score_query("n06_financial_context", ["financial_context"])
_score_query("n07_content_quality", ["content_quality"])
_score_query("n08_source_quality", ["source_quality"])
_score_query("n09_negative_penalty", ["negative_penalty"])
_score_query("n10_overall_relevance", [*SCORES, "is_company_specific"])


@query("n11_batch_statistics", sql("articles", "SELECT company, total_articles, relevant_articles, round(relevance_share, 6) AS relevance_share, round(average_relevance, 6) AS average_relevance, lenient_articles FROM statistics", ASSESSED))
def batch_statistics(spark, sf):
    return _rounded(R.batch_statistics(_assessed(spark, sf)), {"relevance_share": 6, "average_relevance": 6})


@query("n11_relevant_articles", sql("articles", "SELECT seq, company, is_relevant FROM relevant", ASSESSED))
def relevant_articles(spark, sf):
    rows = _assessed(spark, sf)
    return R.relevant_articles(rows, R.batch_statistics(rows)).select("seq", "company", "is_relevant")


@query("n12_escalation", sql("articles", """SELECT company, total_articles, n AS relevant_count, round(relevance_share, 6) AS relevance_share, reason <> 'sufficient' AS escalate, reason FROM (
  SELECT *, CASE WHEN n < 15 THEN 'too few relevant' WHEN total_articles < 15 THEN 'low volume' WHEN n < 8 THEN 'insufficient relevant' WHEN relevance_share >= 0.4 THEN 'sufficient' ELSE 'avoid filler' END AS reason
  FROM (SELECT *, CASE WHEN total_articles < 10 THEN lenient_articles ELSE relevant_articles END AS n FROM statistics))""", ASSESSED))
def escalation(spark, sf):
    return _rounded(R.escalation(R.batch_statistics(_assessed(spark, sf))), {"relevance_share": 6})


def _dedup_sql(key: str) -> dict[str, str]:
    """The pass in seq order as a recursion over the articles that have a duplicate partner."""
    return {
        "worded": f"SELECT seq, {key} AS k, link, list_sort(list_distinct(list_filter(regexp_split_to_array(trim(lower(title)), '\\s+'), lambda w: w <> ''))) AS words FROM articles",
        "tokens": "SELECT seq, k, len(words) AS m, unnest(words) AS word FROM worded WHERE len(words) > 3",
        "near": """SELECT a.k, a.seq AS early, b.seq AS late FROM tokens a JOIN tokens b ON a.k = b.k AND a.word = b.word AND a.seq < b.seq
          GROUP BY a.k, a.seq, b.seq HAVING count(*) / (any_value(a.m) + any_value(b.m) - count(*)) > 0.7""",
        "edges": "SELECT early, late FROM near UNION SELECT a.seq, b.seq FROM worded a JOIN worded b ON a.k = b.k AND a.link = b.link AND a.seq < b.seq",
        "nodes": "SELECT late AS seq, list(early) AS earlier, row_number() OVER (ORDER BY late) AS pos FROM edges GROUP BY late",
        "walk": """SELECT CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS dropped
          UNION ALL SELECT n.pos, CASE WHEN len(list_filter(n.earlier, lambda e: NOT list_contains(w.dropped, e))) > 0 THEN list_append(w.dropped, n.seq) ELSE w.dropped END
          FROM walk w JOIN nodes n ON n.pos = w.pos + 1""",
        "dropped": "SELECT unnest(dropped) AS seq FROM (SELECT dropped FROM walk ORDER BY pos DESC LIMIT 1)"}


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("n13_deduplicated", _recursive(sql("articles", "SELECT seq, company FROM articles WHERE seq NOT IN (SELECT seq FROM dropped)", _dedup_sql("company"))))
def deduplicated(spark, sf):
    return D.deduplicate(B.articles(spark, sf).select("seq", "company", "title", "link"), ["company"]).select("seq", "company")


@query("n13_deduplicated_all", _recursive(sql("articles", "SELECT seq, company FROM articles WHERE seq NOT IN (SELECT seq FROM dropped)", _dedup_sql("1"))))
def deduplicated_all(spark, sf):
    return D.deduplicate(B.articles(spark, sf).select("seq", "company", "title", "link")).select("seq", "company")


_MENTION = "(length(content) - length(replace(content, lower(company), ''))) // length(company)"


def _scored(source: str) -> dict[str, str]:
    listed = {**V.UNWANTED_SOURCES, **V.PREMIUM_SOURCES}
    return {
        "counted": f"""SELECT *, {_MENTION} AS mentions, company = 'apple' AND {_any('content', V.COMPANY_SYNONYMS['apple'])} AS excused FROM (SELECT *, lower(title) || ' ' || lower(snippet) AS content FROM {source})""",
        "scored": f"""SELECT *, mentions > 0 OR excused AS mentions_company, {_any('content', V.BACKFILL_KEYWORDS)} AS has_finance_word FROM (SELECT *,
        CASE WHEN mentions = 0 AND NOT excused THEN -50 ELSE 0 END::DOUBLE + coalesce({sql_map(listed)}[lower(source)], 0)
        + CASE source_type WHEN 'alphavantage_premium' THEN 15 + relevance_score * 10 WHEN 'nyt_api' THEN 25 WHEN 'rss_feed' THEN 8 ELSE 0 END
        + CASE WHEN mentions > 0 THEN CASE WHEN contains(lower(title), lower(company)) THEN 10 ELSE 0 END + least(mentions * 3, 15) ELSE 0 END
        + ({' + '.join(f"CASE WHEN contains(content, {quoted(w)}) THEN 1 ELSE 0 END" for w in V.SCORE_KEYWORDS)}) * 2 AS score FROM counted) WHERE score >= -30"""}


@query("n14_scored_articles", sql("articles", "SELECT seq, company, round(score, 6) AS score, mentions_company, has_finance_word FROM scored", _scored("articles")))
def scored_articles(spark, sf):
    rows = R.scored_articles(B.articles(spark, sf))
    return _rounded(rows.select("seq", "company", "score", "mentions_company", "has_finance_word"), {"score": 6})


SELECTED = _dedup_sql("company") | {"unique_articles": "SELECT * FROM articles WHERE seq NOT IN (SELECT seq FROM dropped)"} | _scored("unique_articles") | ASSESSED | {
    "links": "SELECT DISTINCT company, link FROM relevant WHERE is_relevant",
    "selected": """SELECT *, row_number() OVER (PARTITION BY company ORDER BY is_relevant DESC, score DESC, seq) AS place FROM (
      SELECT s.*, (company, link) IN (SELECT (company, link) FROM links) AS is_relevant FROM scored s) WHERE is_relevant OR mentions_company OR (has_finance_word AND score > 10) QUALIFY place <= 30""",
    "feeds": """SELECT company, count(*) FILTER (source_type = 'alphavantage_premium') AS alphavantage_articles, count(*) FILTER (source_type = 'nyt_api') AS nyt_articles,
      count(*) FILTER (source_type = 'rss_feed') AS rss_articles, count(*) FILTER (source_type = 'google_search') AS google_articles FROM articles GROUP BY company"""}


def _selected(spark, sf):
    articles = B.articles(spark, sf)
    return articles, select_articles(articles)


@query("n15_final_selection", _recursive(sql("articles", "SELECT seq, company, place, round(score, 6) AS score, is_relevant FROM selected", SELECTED)))
def final_selection(spark, sf):
    return _rounded(_selected(spark, sf)[1].select("seq", "company", "place", "score", "is_relevant"), {"score": 6})


@query("n16_coverage", _recursive(sql("articles", f"""SELECT company, total_articles, premium_count, alphavantage_articles, nyt_articles, rss_articles, google_articles, round(share, 1) AS premium_coverage,
  CASE WHEN alphavantage_articles >= 8 AND share >= 40 THEN 'Premium' WHEN alphavantage_articles >= 5 AND share >= 30 THEN 'Institutional' WHEN alphavantage_articles >= 3 OR share >= 40 THEN 'Professional'
    WHEN total_articles >= 10 THEN 'Standard' ELSE 'Limited' END AS tier FROM (
  SELECT f.*, coalesce(t, 0) AS total_articles, coalesce(p, 0) AS premium_count, coalesce(p / t * 100, 0) AS share FROM feeds f LEFT JOIN (
    SELECT company, count(*) AS t, count(*) FILTER (source IN (SELECT unnest({sql_list(V.PREMIUM_SOURCES)}))) AS p FROM selected GROUP BY company) USING (company))""", SELECTED)))
def coverage(spark, sf):
    articles, selected = _selected(spark, sf)
    return R.coverage(selected, R.feed_counts(articles))


@query("n17_budgeted_sample", sql("articles", """SELECT company, seq, level, place, CASE level WHEN 'high' THEN title ELSE left(title, 80) END AS title,
    CASE level WHEN 'high' THEN left(snippet, 400) ELSE left(snippet, 120) END AS snippet, coalesce(CASE WHEN level = 'high' THEN sentiment_label END, '') AS sentiment_label
  FROM (SELECT *, count(*) FILTER (level = 'high' AND place <= 12) OVER (PARTITION BY company) AS h FROM (
    SELECT *, row_number() OVER (PARTITION BY company, level ORDER BY seq) AS place FROM (SELECT *, CASE WHEN is_company_specific OR overall_relevance > 0.5 THEN 'high' ELSE 'standard' END AS level FROM assessed)))
  WHERE (level = 'high' AND place <= 12) OR (level = 'standard' AND place <= 18 - h)""", ASSESSED))
def budgeted_sample(spark, sf):
    return R.budgeted_sample(_assessed(spark, sf)).fillna("", ["sentiment_label"])


@query("n18_first_links", sql("articles", "SELECT company, source, arg_min(link, seq) AS link FROM articles GROUP BY ALL"))
def first_links(spark, sf):
    return R.first_link_per_source(B.articles(spark, sf))


@query("n19_source_index", _recursive(sql("articles", "SELECT company, place AS source_no, link, title, published, source FROM selected", SELECTED)))
def source_index(spark, sf):
    return R.source_index(_selected(spark, sf)[1])
