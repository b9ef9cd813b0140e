"""Registered queries over answers, pages and embeddings, and the retired news rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.operators import citations as C
from tidemark.operators import pages as P
from tidemark.operators import relevance as R
from tidemark.operators import report_text as T
from tidemark.operators import retired_news as L
from tidemark.plans import bindings as B
from tidemark.plans.news_queries import ASSESSED, _any, _assessed, _hits
from tidemark.plans.oracle_tables import quoted, sql, sql_list, sql_map
from tidemark.plans.portfolio_queries import _rounded
from tidemark.plans.registry import query

KEYS = ["conv_id", "turn"]
NORMAL = {"normal": r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(answer, '\[\^?(\d+)\]', '[S\1]', 'g'), '\(\s*[Ss]\s*(\d+)\s*\)', '[S\1]', 'g'), '\{\s*[Ss]\s*(\d+)\s*\}', '[S\1]', 'g') AS answer FROM answers"""}
# the markers appended to each answer name turn, conv_id % 9, turn and 12
CITED = {"cites": """SELECT conv_id, turn, list_filter(CASE WHEN turn = conv_id % 9 THEN [turn, 12] ELSE [turn, conv_id % 9, 12] END, lambda n: n BETWEEN 1 AND 8) AS nums FROM conversations WHERE role = 'assistant'"""}


@query("n20_normalised_citations", sql("answers", "SELECT conv_id, turn, md5(answer) AS digest, length(answer) AS size FROM normal", NORMAL))
def normalised_citations(spark, sf):
    return C.normalised(B.answers(spark, sf)).select(*KEYS, F.md5("answer").alias("digest"), F.length("answer").cast("bigint").alias("size"))


def _cited(spark, sf):
    return C.cited(B.answers(spark, sf).withColumn("max_source", F.lit(8)), KEYS)


@query("n21_cited_sources", sql([], "SELECT conv_id, turn, array_to_string(nums, ',') AS cited FROM cites", CITED))
def cited_sources(spark, sf):
    return _cited(spark, sf).select(*KEYS, F.array_join(F.transform("cited", lambda n: n.cast("string")), ",").alias("cited"))


def _run_sources(spark, sf):
    """Source index of every run: the five pages whose numbers follow from its conversation and turn."""
    runs = B.answers(spark, sf).select(*KEYS)
    articles = runs.withColumn("source_no", F.explode(F.array(*[F.lit(i) for i in range(1, 6)]))).withColumn("page_id", F.col("conv_id") * 2 + F.col("turn") + F.col("source_no"))
    return C.run_sources(articles, B.table(spark, sf, "pages"), KEYS)


def _entity(text: str) -> str:
    for entity, sign in P.ENTITIES.items():
        text = f"replace({text}, {quoted(entity)}, {quoted(sign)})"
    return text


_VISIBLE = "trim(regexp_replace(" + _entity("regexp_replace({x}, '(?s)<!--.*?-->|<[^>]+>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"
_TITLE = _VISIBLE.replace('{x}', "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
# the pages have no date tags
SOURCES = {"sources": f"""SELECT conv_id, turn, n AS source_no, CASE WHEN {_TITLE} = '' THEN 'No title found' ELSE {_TITLE} END AS title,
      regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS source, '' AS published
    FROM conversations, (SELECT unnest([1, 2, 3, 4, 5]) AS n), pages WHERE role = 'assistant' AND page_id = conv_id * 2 + turn + n"""}


@query("n22_resolved_citations", sql([], """SELECT c.conv_id, c.turn, pos, c.source_no, coalesce(title, '') AS title, coalesce(source, '') AS source FROM (
    SELECT conv_id, turn, unnest(range(0, len(nums))) AS pos, unnest(nums) AS source_no FROM cites) c LEFT JOIN sources s ON s.conv_id = c.conv_id AND s.turn = c.turn AND s.source_no = c.source_no""", CITED | SOURCES))
def resolved_citations(spark, sf):
    rows = C.resolved_citations(_cited(spark, sf), _run_sources(spark, sf), KEYS)
    return rows.drop("published").fillna("", ["title", "source"])


def _bullets(spark, sf):
    return T.analysis_bullets(B.answers(spark, sf), KEYS)


BULLETS = {
    "sized": """SELECT conv_id, turn, len(string_split(text, chr(10))) AS body, text, ' [^' || turn || '] and (S' || (conv_id % 9) || '), { s' || turn || '} [12]' AS marks FROM conversations WHERE role = 'assistant'""",
    "lines": "SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(1, body + 1)) AS n FROM sized",
    "longs": "SELECT conv_id, turn, n, trim(regexp_replace(line, '^[•\\-* ]+', '')) AS bullet FROM lines WHERE length(trim(regexp_replace(line, '^[•\\-* ]+', ''))) > 10",
    "bullets": f"""SELECT conv_id, turn, 1 AS block, n, bullet FROM longs
      UNION ALL SELECT conv_id, turn, 1, 0, {quoted(V.EMPTY_SECTION)} FROM sized WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM longs)
      UNION ALL SELECT conv_id, turn, 2, 1, CASE WHEN turn % 3 = 0 THEN {quoted(V.EMPTY_SECTION)} ELSE 'Margin moved <b>up</b> 15% to $3' || marks END FROM sized
      UNION ALL SELECT conv_id, turn, 2, 2, 'Guidance kept at 10-12% for Q2 2024' FROM sized WHERE turn % 3 <> 0
      UNION ALL SELECT conv_id, turn, 3, 1, 'Revenue estimate 4.5x above target with 20% probability' FROM sized"""}


@query("n23_run_contexts", sql([], """SELECT conv_id, turn, md5(string_agg(line, chr(10) ORDER BY block, n)) AS digest FROM (
    SELECT conv_id, turn, block, n, '• ' || regexp_replace(bullet, '<[^>]+>', '', 'g') AS line FROM bullets
    UNION ALL SELECT conv_id, turn, 0, -1, 'RUN: ' || conv_id FROM sized UNION ALL SELECT conv_id, turn, 1, -1, '== EXECUTIVE SUMMARY ==' FROM sized
    UNION ALL SELECT conv_id, turn, 2, -1, '== INVESTOR INSIGHTS ==' FROM sized UNION ALL SELECT conv_id, turn, 3, -1, '== CATALYSTS & RISKS ==' FROM sized
    UNION ALL SELECT conv_id, turn, 4, -1, '== SOURCES INDEX ==' FROM sized
    UNION ALL SELECT conv_id, turn, 4, source_no, '[S' || source_no || '] ' || left(title, 60) || ' | ' || source || ' | ' || published FROM sources) GROUP BY conv_id, turn""", BULLETS | SOURCES))
def run_contexts(spark, sf):
    header = F.concat(F.lit("RUN: "), F.col("conv_id").cast("string"))
    rows = C.contexts(_bullets(spark, sf), _run_sources(spark, sf), KEYS, header)
    return rows.select(*KEYS, F.md5("context").alias("digest"))


def _reviews(spark, sf):
    """Review results per assistant turn, scores and findings following its numbers."""
    c, t = F.col("conv_id"), F.col("turn")
    search = F.array(*[F.struct(
        F.when((c + t + i) % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("update "), F.lit(str(i)))).alias("data_updated"),
        F.when((c + i) % 2 == 0, "Current figures").otherwise("Older figures").alias("key_finding")) for i in range(4)])
    return B.table(spark, sf, "conversations").where(F.col("role") == "assistant").select(
        "conv_id", "turn", (F.lit(5.0) + c % 9 * 0.25).alias("original_score"),
        (F.lit(5.0) + c % 9 * 0.25 + t % 5 * 0.5).alias("revised_score"),
        F.slice(search, F.lit(1), ((c + t) % 5).cast("int")).alias("searches"),
        F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")), F.lit(1), (t % 5).cast("int")).alias("enhancements"),
        F.when(c % 4 == 0, 2).otherwise(3).alias("sections_filled"))


REVIEWS = {"reviews": """SELECT conv_id, turn, 5.0::DOUBLE + conv_id % 9 * 0.25 AS a, 5.0::DOUBLE + conv_id % 9 * 0.25 + turn % 5 * 0.5 AS b, (conv_id + turn) % 5 AS n, turn % 5 AS e,
    CASE WHEN conv_id % 4 = 0 THEN 2 ELSE 3 END AS filled FROM conversations WHERE role = 'assistant'"""}


@query("n24_quality_gate", sql([], """SELECT conv_id, turn, a AS original_score, b AS revised_score, b - a AS score_delta, (b - a >= 0.5 OR n >= 3) AND filled = 3 AS uses_enhanced,
  CASE WHEN b >= 7 THEN 'meets threshold' WHEN b - a >= 1 AND b >= 6 THEN 'improved to acceptable' ELSE 'insufficient' END AS pass_reason, b >= 7 OR (b - a >= 1 AND b >= 6) AS passed,
  CASE WHEN b >= 9 THEN 'A+' WHEN b >= 8.5 THEN 'A' WHEN b >= 8 THEN 'A-' WHEN b >= 7.5 THEN 'B+' WHEN b >= 7 THEN 'B' WHEN b >= 6 THEN 'B-' ELSE 'C' END AS grade FROM reviews""", REVIEWS))
def quality_gate(spark, sf):
    return C.quality_gate(_reviews(spark, sf)).drop("searches", "enhancements", "sections_filled")


@query("n25_review_summaries", sql([], """SELECT conv_id, turn, n AS search_count, e AS enhancement_count,
  array_to_string(list_transform(list_filter(range(0, least(n, 3)), lambda i: (conv_id + turn + i) % 3 <> 0), lambda i: 'update ' || i), '|') AS key_updates,
  array_to_string(list_slice(['a', 'b', 'c', 'd'], 1, least(e, 3)), '|') AS top_enhancements, len(list_filter(range(0, n), lambda i: (conv_id + i) % 2 = 0)) AS current_findings FROM reviews""", REVIEWS))
def review_summaries(spark, sf):
    return C.review_summaries(_reviews(spark, sf)).drop("searches", "enhancements", "sections_filled", "original_score", "revised_score")


@query("n27_semantic_filter", """SELECT label AS query_id, vec_id AS item_id, round(sim, 6) + 0.0 AS similarity, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS place FROM (
  SELECT e.label, e.vec_id, list_cosine_similarity(CAST(q.v AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS sim FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label) q ON q.label = e.label
  WHERE e.vec_id % 7 = 6 OR e.vec_id % 90 <= 45) QUALIFY place <= 5""")
def semantic_filter(spark, sf):
    rows = B.table(spark, sf, "embeddings")
    as_of = F.lit("2024-03-31").cast("date")
    evidence = rows.select(
        F.col("label").alias("query_id"), F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"),
        F.when(F.col("vec_id") % 7 == 6, "some day").otherwise(
            F.date_format(F.date_sub(as_of, (F.col("vec_id") % 90).cast("int")), "yyyy-MM-dd")).alias("published"))
    queries = rows.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query_vector"))
    return _rounded(P.semantic_filter(queries, evidence, as_of), {"similarity": 6})


@query("n28_page_articles", f"""SELECT page_id, url, CASE WHEN title = '' THEN 'No title found' ELSE title END AS title, md5(CASE WHEN length(c) > 5000 THEN left(c, 5000) || '...' ELSE c END) AS digest,
    length(CASE WHEN length(c) > 5000 THEN left(c, 5000) || '...' ELSE c END) AS size FROM (
  SELECT page_id, url, {_TITLE} AS title,
    {_VISIBLE.replace('{x}', "regexp_extract(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', '', 'g'), '(?is)<article[^>]*>(.*?)</article>', 1)")} AS c FROM pages)""")
def page_articles(spark, sf):
    rows = P.page_articles(B.text_table(spark, sf, "pages"))
    return rows.select("page_id", "url", "title", F.md5("content").alias("digest"), F.length("content").cast("bigint").alias("size"))


@query("n29_publication_dates", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN '2024-02-01' WHEN 1 THEN '2024-03-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') WHEN 2 THEN '2023-12-24' ELSE '' END AS published FROM pages""")
def publication_dates(spark, sf):
    p = F.col("page_id")
    tag = (F.when(p % 5 == 0, '<meta name="date" content="1999-01-01"><meta property="article:published_time" content="2024-02-01">')
           .when(p % 5 == 1, F.concat(F.lit('<meta content="2024-03-'), F.lpad((p % 28 + 1).cast("string"), 2, "0"), F.lit('" name="pubdate">')))
           .when(p % 5 == 2, "<meta itemprop='datePublished' content='2023-12-24'>").otherwise(""))
    rows = B.table(spark, sf, "pages").select("page_id", F.concat("html", tag).alias("html"))
    return rows.select("page_id", F.coalesce(P.publication_date(F.col("html")), F.lit("")).alias("published"))


@query("n30_fetched_hits", """SELECT query_id, url, seq, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS place FROM (
  SELECT d.doc_id % 12 AS query_id, p.url, min(d.doc_id) AS seq FROM documents d JOIN pages p ON p.page_id = (d.doc_id * 7) % 251 GROUP BY ALL) QUALIFY place <= 20""")
def fetched_hits(spark, sf):
    pages = B.table(spark, sf, "pages").select("page_id", "url", F.col("url").alias("title"))
    d = F.col("doc_id")
    docs = B.table(spark, sf, "documents").select(d.alias("seq"), (d % 12).alias("query_id"), (d * 7 % 251).alias("page_id"))
    hits = docs.join(pages.select("page_id", "url"), "page_id").select("query_id", "url", "seq")
    return P.fetched_hits(hits, pages).drop("title")


@query("n31_implications", """SELECT conv_id, turn, 'sector' AS kind, 'Sector ' || conv_id % 5 AS name, CASE WHEN turn % 2 = 0 THEN 'bullish' ELSE 'bearish' END AS impact FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn, 'company', 'Firm ' || turn, 'bearish' FROM conversations WHERE role = 'assistant'""")
def implications(spark, sf):
    c, t = F.col("conv_id"), F.col("turn").cast("string")
    sector = F.concat(F.lit("Sector "), (c % 5).cast("string"))
    impact = F.when(F.col("turn") % 2 == 0, "bullish").otherwise("Bearish")
    as_json = F.to_json(F.struct(
        F.array(F.struct(sector.alias("name"), impact.alias("impact"))).alias("sectors"),
        F.array(F.struct(F.concat(F.lit("Firm "), t).alias("name"), F.lit("").alias("ticker"), F.lit("bearish").alias("impact"))).alias("companies"),
        F.col("text").alias("timing")))
    as_lines = F.concat(F.col("text"), F.lit("\n- Sector: "), sector, F.lit(" ("), impact, F.lit(")\n* Company: Firm "), t, F.lit(" (BEARISH)"))
    rows = B.table(spark, sf, "conversations").where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.when(c % 2 == 0, as_json).otherwise(as_lines).alias("note"))
    return P.implications(rows, KEYS)


# ---- retired rules ------------------------------------------------------------------------
def _tickered(spark, sf):
    ticker = B.pick(["ON", "UP", "KO", "TO", "NVDA"], F.col("seq"))
    rows = R.resolve_companies(B.articles(spark, sf)).withColumn("ticker", ticker)
    told = F.when(F.col("seq") % 11 == 0, F.concat(F.lit(" pass "), F.lower("ticker"), F.lit(" his"))).otherwise("")
    return rows.withColumn("title", F.concat("title", told))


def _phrases(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, replace({quoted(p)}, '{{t}}', lower(ticker)))" for p in phrases) + ")"


@query("l01_preposition_flags", sql("articles", f"""SELECT seq, company, ticker, ticker <> 'NVDA' AND ticker <> 'KO' AS ambiguous,
  CASE WHEN section IN ({', '.join(quoted(s) for s in V.NON_BUSINESS_SECTIONS)}) AND contains(t, lower(ticker)) THEN NOT {_any('t', V.BUSINESS_WORDS)} ELSE {_phrases('t', V.OBVIOUS_PREPOSITION_PHRASES)} END AS obvious_preposition,
  NOT coalesce(contains(c, lower(company_name)), false) AND {_phrases('c', V.LIKELY_PREPOSITION_PHRASES)} AS likely_preposition
  FROM (SELECT seq, company, section, ticker, company_name, lower(title2) AS t, lower(title2) || ' ' || lower(snippet) AS c FROM (
    SELECT *, title || CASE WHEN seq % 11 = 0 THEN ' pass ' || lower(ticker) || ' his' ELSE '' END AS title2 FROM (
      SELECT *, ['ON', 'UP', 'KO', 'TO', 'NVDA'][seq % 5 + 1] AS ticker, CASE WHEN company <> 'ABC' THEN coalesce({sql_map({k: v[1] for k, v in V.COMPANY_ALIASES.items()})}[company], company) END AS company_name FROM articles)))"""))
def preposition_flags(spark, sf):
    return L.preposition_flags(_tickered(spark, sf))


ENHANCED = ASSESSED | {"enhanced": f"""SELECT seq, company, is_company_specific, source_type, round(least((overall_relevance * 0.4::DOUBLE + CASE WHEN is_company_specific THEN 0.2 ELSE 0 END::DOUBLE) * {sql_map(V.ENHANCED_SOURCE_WEIGHTS)}[source_type]
    + (CASE WHEN source IN ({', '.join(quoted(s) for s in V.ENHANCED_PREMIUM)}) THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN length(full_content) > 300 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN sentiment_label IS NOT NULL THEN 0.1 ELSE 0 END::DOUBLE), 2.0), 9) AS enhanced_score FROM assessed"""}


@query("l02_enhanced_selection", sql("articles", """SELECT seq, company, is_company_specific, source_type, round(enhanced_score, 6) AS enhanced_score, row_number() OVER (PARTITION BY company ORDER BY enhanced_score DESC, seq) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY company ORDER BY is_company_specific DESC, enhanced_score DESC, seq) AS pick FROM enhanced WHERE is_company_specific OR enhanced_score > 0.3) WHERE pick <= 30""", ENHANCED))
def enhanced_selection(spark, sf):
    return _rounded(L.enhanced_selection(L.enhanced_scores(_assessed(spark, sf))), {"enhanced_score": 6})


@query("l03_source_share", sql("articles", """SELECT company, total, premium, round(share, 6) AS share, greatest(CAST(floor(total * 0.25) AS BIGINT), 8) AS target, share >= 0.25 OR premium >= greatest(floor(total * 0.25), 8) AS met FROM (
  SELECT company, count(*) AS total, count(*) FILTER (source_type = 'alphavantage_premium') AS premium, avg(CAST(source_type = 'alphavantage_premium' AS INTEGER)) AS share FROM articles GROUP BY company)"""))
def source_share(spark, sf):
    return _rounded(L.source_share(B.articles(spark, sf)), {"share": 6})


@query("l04_sentiment_distribution", sql("articles", """SELECT company, count(*) AS articles, count(*) FILTER (sentiment_label = 'Bullish') AS bullish, count(*) FILTER (sentiment_label = 'Neutral') AS neutral,
  count(*) FILTER (sentiment_label = 'Bearish') AS bearish, round(avg(sentiment_score), 6) + 0.0 AS mean_score, CASE WHEN avg(sentiment_score) > 0.2 THEN 'Bullish' WHEN avg(sentiment_score) < -0.2 THEN 'Bearish' ELSE 'Neutral' END AS trend
  FROM articles WHERE source_type = 'alphavantage_premium' GROUP BY company"""))
def sentiment_distribution(spark, sf):
    return _rounded(L.sentiment_distribution(B.articles(spark, sf)), {"mean_score": 6})


@query("l05_keyword_relevant", sql("articles", f"""SELECT seq, company, contains(c, lower(company)) AND {_any('c', V.RETIRED_FINANCE_WORDS)} AND NOT {_any('c', V.RETIRED_NEGATIVE_WORDS)} AS relevant FROM (SELECT seq, company, lower(title) || ' ' || lower(snippet) AS c FROM articles)"""))
def keyword_relevant(spark, sf):
    return L.keyword_relevant(B.articles(spark, sf))


METRICS = BULLETS | {"text_metrics": f"""SELECT conv_id, turn, block, CAST(sum({' + '.join(f"CASE WHEN contains(lower(bullet), {quoted(t)}) THEN 1 ELSE 0 END" for t in V.QUALITY_TERMS)}) AS BIGINT) AS finance_terms,
    CAST(sum({_hits('bullet', V.QUANTIFIED_PATTERNS)}) AS BIGINT) AS quantified FROM bullets GROUP BY ALL"""}


@query("l06_text_metrics", sql([], "SELECT conv_id, turn, CAST(sum(finance_terms) AS BIGINT) AS finance_terms, CAST(sum(quantified) AS BIGINT) AS quantified FROM text_metrics GROUP BY conv_id, turn", METRICS))
def text_metrics(spark, sf):
    return C.text_metrics(_bullets(spark, sf), KEYS)


@query("l06_metric_improvement", sql([], """SELECT a.conv_id, a.turn, round((b.finance_terms / nullif(a.finance_terms, 0) - 1) * 100, 6) + 0.0 AS terms_improvement, round((b.quantified / nullif(a.quantified, 0) - 1) * 100, 6) + 0.0 AS quantified_improvement
  FROM text_metrics a JOIN text_metrics b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.block = 2 AND b.block = 3""", METRICS))
def metric_improvement(spark, sf):
    bullets = _bullets(spark, sf)
    base = C.text_metrics(bullets.where(F.col("section") == "investor"), KEYS)
    other = C.text_metrics(bullets.where(F.col("section") == "catalysts"), KEYS)
    return _rounded(C.metric_improvement(base, other, KEYS), {"terms_improvement": 6, "quantified_improvement": 6})
