"""The role tables of bindings.py as SQL common table expressions for the checking engine."""

from __future__ import annotations

from tidemark.functions import vocab as V
from tidemark.plans import bindings as B


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) if isinstance(v, str) else repr(v) for v in values) + "]"


def sql_map(mapping: dict) -> str:
    def lit(v):
        return quoted(v) if isinstance(v, str) else repr(v)
    return "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in mapping.items()) + "}"


def pick(values, position: str) -> str:
    return f"{sql_list(values)}[CAST(({position}) % {len(values)} AS INTEGER) + 1]"


def positive(name: str) -> str:
    m = sql_map({k: v[0] for k, v in V.CATEGORIES.items()})
    return f"coalesce({m}[{name}], 'Growing')"


def negative(name: str) -> str:
    m = sql_map({k: v[1] for k, v in V.CATEGORIES.items()})
    return f"coalesce({m}[{name}], 'Declining')"


def direction(name: str, value: str) -> str:
    return f"""CASE WHEN {name} = 'Supplier Deliveries' THEN CASE WHEN {value} >= 50 THEN 'Slowing' ELSE 'Faster' END
      WHEN {name} IN ('Customers'' Inventories', 'Inventory Sentiment') THEN CASE WHEN {value} >= 50 THEN 'Too High' ELSE 'Too Low' END
      WHEN {name} = 'Prices' THEN CASE WHEN {value} >= 50 THEN 'Increasing' ELSE 'Decreasing' END
      ELSE CASE WHEN {value} >= 50 THEN 'Growing' ELSE 'Contracting' END END"""


def status(name: str, category: str) -> str:
    return f"""CASE WHEN {name} = 'Supplier Deliveries' THEN CASE WHEN {category} = 'Slower' THEN 'Slowing' ELSE 'Faster' END
      WHEN {name} = 'Inventories' THEN CASE WHEN {category} = 'Higher' THEN 'Higher' ELSE 'Lower' END
      WHEN {name} IN ('Customers'' Inventories', 'Inventory Sentiment') THEN {category}
      WHEN {name} = 'Prices' THEN CASE WHEN {category} = 'Increasing' THEN 'Increasing' ELSE 'Decreasing' END
      ELSE CASE WHEN {category} = 'Growing' THEN 'Growing' ELSE 'Contracting' END END"""


_SLOT = """((CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) * 3 +
      CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)"""

_NAMES = f"CASE WHEN doc_id % 2 = 0 THEN {sql_list(V.MANUFACTURING_INDICES)} ELSE {sql_list(V.SERVICES_INDICES)} END"
_CANON = f"CASE WHEN doc_id % 2 = 0 THEN {sql_list(V.MANUFACTURING_INDUSTRIES)} ELSE {sql_list(V.SERVICES_INDUSTRIES)} END"

CTES: dict[str, tuple[list[str], str]] = {
    "keyed": ([], f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS report_date,
      CASE WHEN o_custkey % 2 = 0 THEN 'Manufacturing' ELSE 'Services' END AS report_type,
      CASE WHEN o_custkey % 2 = 0 THEN {pick(V.MANUFACTURING_INDICES, _SLOT)}
           ELSE {pick(V.SERVICES_INDICES, _SLOT)} END AS index_name,
      o_custkey, o_totalprice FROM orders"""),
    "index_obs": (["keyed"], """SELECT report_date, report_type, index_name,
      round(avg(o_totalprice) / 4500, 1) AS index_value FROM keyed GROUP BY ALL"""),
    "reports": (["keyed"], """SELECT DISTINCT report_date, report_type, strftime(report_date, '%B %Y') AS month_year,
      'reports/' || strftime(report_date, '%Y-%m') || '-' || lower(report_type) || '.txt' AS file_path FROM keyed"""),
    "status_base": (["keyed"], f"""SELECT report_date, report_type, index_name,
      CASE WHEN report_type = 'Manufacturing' THEN {pick(V.MANUFACTURING_INDUSTRIES, 'c_nationkey')}
           ELSE {pick(V.SERVICES_INDUSTRIES, 'c_nationkey')} END AS industry_name, sum(o_totalprice) AS amount
      FROM keyed JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""),
    "industry_status": (["status_base"], f"""SELECT report_date, report_type, index_name, industry_name,
      CASE WHEN amount > mean_amount THEN {positive('index_name')} ELSE {negative('index_name')} END AS category,
      rank, CASE (rank + month(report_date)) % 6 WHEN 1 THEN lower(industry_name)
        WHEN 2 THEN replace(industry_name, ' & ', ' and ') WHEN 3 THEN regexp_replace(industry_name, ' Products$', '')
        WHEN 4 THEN 'the ' || industry_name WHEN 5 THEN industry_name || ' (1)' ELSE industry_name END AS raw_industry
      FROM (SELECT *, row_number() OVER (PARTITION BY report_date, report_type, index_name
          ORDER BY amount DESC, industry_name) - 1 AS rank,
        avg(amount) OVER (PARTITION BY report_date, report_type, index_name) AS mean_amount FROM status_base)"""),
    # facts behind the report texts, straight from the document numbers
    "doc_slots": ([], f"""SELECT doc_id, i, CASE WHEN doc_id % 2 = 0 THEN 'Manufacturing' ELSE 'Services' END AS report_type,
      CAST(DATE '2015-01-01' + to_months(CAST(doc_id % 120 AS INTEGER)) AS DATE) AS report_date,
      ({_NAMES})[i + 1] AS index_name, {_CANON} AS canon,
      (300 + (doc_id * 37 + i * 101) % 400) AS v FROM documents, range(0, 11) AS r(i)"""),
    "report_facts": (["doc_slots"], f"""SELECT doc_id, i, report_type, report_date, index_name, v,
      CAST(v AS DOUBLE) / 10 AS value, CAST(v // 10 AS VARCHAR) || '.' || CAST(v % 10 AS VARCHAR) AS value_text,
      {direction('index_name', 'v / 10.0')} AS direction,
      {positive('index_name')} AS pos, {negative('index_name')} AS neg,
      (doc_id + i) % 7 = 3 AS by_sentence, (doc_id + i) % 6 = 2 AS conflicted, (doc_id + i) % 5 = 0 AS with_change,
      [canon[(doc_id + i * 5) % 18 + 1], canon[(doc_id + i * 5 + 4) % 18 + 1], canon[(doc_id + i * 5 + 8) % 18 + 1]] AS ups,
      [canon[(doc_id + i * 5 + 2) % 18 + 1], canon[(doc_id + i * 5 + 6) % 18 + 1]] AS downs FROM doc_slots"""),
    "report_lines": (["report_facts"], """SELECT *, CASE WHEN index_name LIKE '%PMI' THEN '®' ELSE '' END AS mark,
      CASE WHEN said = 1 AND pos = 'Slower' THEN 'slower deliveries' WHEN said = 1 AND pos = 'Higher' THEN 'growth in inventories'
        WHEN said = 1 AND pos = 'Increasing' THEN 'paying higher prices' WHEN said = 1 AND index_name = 'Employment' THEN 'employment growth'
        WHEN pos = 'Slower' THEN 'slower supplier deliveries' WHEN pos = 'Higher' THEN 'higher inventories'
        WHEN pos = 'Too High' THEN lower(index_name) || ' as too high' WHEN pos = 'Increasing' THEN 'increased prices'
        ELSE 'growth in ' || lower(index_name) END AS up_words,
      CASE WHEN said = 1 AND index_name = 'Backlog of Orders' THEN 'lower order backlogs' WHEN said = 1 AND index_name = 'Imports' THEN 'lower volumes of imports'
        WHEN said = 1 AND neg = 'Decreasing' THEN 'paying decreased prices'
        WHEN neg = 'Faster' THEN 'faster supplier deliveries' WHEN neg = 'Lower' THEN 'lower inventories'
        WHEN neg = 'Too Low' THEN lower(index_name) || ' as too low' WHEN neg = 'Decreasing' THEN 'decreased prices'
        ELSE 'a decline in ' || lower(index_name) END AS down_words,
      strftime(report_date, '%B') AS month, strftime(report_date, '%B %Y') AS month_year
      FROM (SELECT *, (doc_id + i) % 3 AS said FROM report_facts)"""),
    "report_sections": (["report_lines"], """SELECT doc_id, i, report_type, report_date, index_name, month_year, value, direction,
      index_name || mark || ' at ' || value_text || ' percent, ' || direction AS glance_line,
      'The ' || index_name || mark || ' Index registered ' || value_text || ' percent in ' || month_year ||
      CASE WHEN v >= 500 THEN ', growing' ELSE ', contracting' END || ' compared with the prior month. ' ||
      CASE WHEN with_change THEN 'The index increased 3.1 percent. ' ELSE '' END ||
      CASE WHEN by_sentence THEN 'Growth was seen in sectors including Machinery, Primary Metals. Activity declined in sectors including Textile Mills, Wood Products.'
      ELSE 'The three industries ' || CASE said WHEN 0 THEN 'reporting ' ELSE 'that reported ' END || up_words || ' in ' || month || ' — listed in order — are: ' ||
        ups[1] || '; ' || ups[2] || '; and ' || ups[3] || '. The industries ' || CASE said WHEN 0 THEN 'reporting ' ELSE 'that reported ' END || down_words || ' in ' || month ||
        CASE said WHEN 2 THEN ' are ' ELSE ' are: ' END || downs[1] || '; ' || downs[2] || CASE WHEN conflicted THEN '; ' || ups[1] ELSE '' END || '.' END AS body
      FROM report_lines"""),
    "report_text": (["report_sections"], """SELECT d.doc_id, s.report_type, s.report_date, s.month_year, d.text AS comments,
      s.month_year || ' ' || upper(s.report_type) || ' INDEX REPORT' || chr(10) || chr(10) || upper(s.report_type) ||
      ' AT A GLANCE' || chr(10) || upper(s.month_year) || chr(10) || chr(10) || s.glance || chr(10) ||
      'OVERALL ECONOMY Growing' || chr(10) || chr(10) || 'WHAT RESPONDENTS ARE SAYING' || chr(10) || d.text || chr(10) || chr(10) ||
      upper(s.report_type) || ' INDEX SUMMARIES' || chr(10) || chr(10) || s.summaries || chr(10) || 'BUYING POLICY' || chr(10) || 'No change.' || chr(10) AS text
      FROM documents d JOIN (SELECT doc_id, any_value(report_type) AS report_type, any_value(report_date) AS report_date,
        any_value(month_year) AS month_year, string_agg(glance_line, chr(10) ORDER BY i) AS glance,
        string_agg(upper(index_name) || chr(10) || body || chr(10), chr(10) ORDER BY i) AS summaries
        FROM report_sections GROUP BY doc_id) s USING (doc_id)"""),
    "price_base": ([], """SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) AS amount,
      sum(l_quantity) AS quantity, max(l_extendedprice / l_quantity) AS hi, min(l_extendedprice / l_quantity) AS lo
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"""),
    "prices": (["price_base"], f"""SELECT symbol, date, hi * {B.EXCHANGE_RATE} AS high, lo * {B.EXCHANGE_RATE} AS low,
      sum(amount) OVER w / sum(quantity) OVER w * {B.EXCHANGE_RATE} AS adj_close, CAST(quantity AS BIGINT) AS volume
      FROM price_base WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""),
    "instruments": ([], """SELECT symbol, 'Company ' || no AS name, CASE WHEN no % 2 = 0 THEN 'NYSE' ELSE 'NASDAQ' END AS exchange,
      'S' || (no % 5) AS sector FROM (SELECT DISTINCT p_brand AS symbol, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS no FROM part)"""),
    "held": ([], """SELECT o_orderkey, c_nationkey AS portfolio_id, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start
      FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "portfolios": ([], """SELECT n_nationkey AS portfolio_id, 'user' || (n_nationkey % 7) AS user_id, n_name AS name,
      CASE WHEN n_nationkey % 2 = 0 THEN 'weight' ELSE 'quantity' END AS allocation_type FROM nation"""),
    "versions": (["held"], """SELECT portfolio_id, row_number() OVER (PARTITION BY portfolio_id ORDER BY quarter_start) AS version_number,
      portfolio_id || '-' || strftime(quarter_start, '%Y%m') AS version_id, quarter_start AS effective_date,
      CAST(quarter_start AS TIMESTAMP) + to_hours(portfolio_id % 24) AS effective_at
      FROM (SELECT DISTINCT portfolio_id, quarter_start FROM held)"""),
    "positions": (["held"], """SELECT portfolio_id, portfolio_id || '-' || strftime(quarter_start, '%Y%m') AS version_id, symbol,
      CASE WHEN portfolio_id % 2 = 0 THEN quantity / sum(quantity) OVER (PARTITION BY portfolio_id, quarter_start) ELSE quantity END AS value
      FROM (SELECT portfolio_id, quarter_start, p_brand AS symbol, sum(l_quantity) AS quantity FROM lineitem
        JOIN part ON l_partkey = p_partkey JOIN held ON l_orderkey = o_orderkey GROUP BY ALL)"""),
    "articles": ([], f"""SELECT seq, company, title, body AS snippet, body AS full_content, link, source, source_type, published,
      CASE WHEN source_type = 'alphavantage_premium' THEN score END AS sentiment_score,
      CASE WHEN source_type = 'alphavantage_premium' THEN CASE WHEN score > 0.2 THEN 'Bullish' WHEN score < -0.2 THEN 'Bearish' ELSE 'Neutral' END END AS sentiment_label,
      CASE WHEN source_type = 'alphavantage_premium' THEN (seq * 7 % 101) / 100 END AS relevance_score, section
      FROM (SELECT doc_id AS seq, company, array_to_string(list_slice(regexp_split_to_array(text, '\\s+'), 1, 12), ' ') ||
          CASE WHEN doc_id % 6 = 0 THEN ' ' || company ELSE '' END AS title,
        text || CASE WHEN doc_id % 3 = 0 THEN ' ' || company || ' reported quarterly results: revenue up 15% to $3.2b in Q1 2024 and earnings beat. The analyst raised the price target for ' || company || ' stock.'
          WHEN doc_id % 7 = 1 THEN ' Apply for a job listing in the directory.' ELSE '' END AS body,
        'https://www.' || {pick(B.DOMAINS, 'link_no * 5 + link_no // 18')} || '/a/' || link_no AS link,
        {pick(B.DOMAINS, 'doc_id * 5 + doc_id // 18')} AS source, {pick(B.SOURCE_TYPES, 'doc_id // 2')} AS source_type,
        strftime(CAST(DATE '2024-01-01' + CAST(doc_id % 90 AS INTEGER) AS DATE), '%Y%m%d') || 'T' || lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || '3000' AS published,
        ((doc_id * 13) % 201 - 100) / 100 AS score, {pick(V.NON_BUSINESS_SECTIONS + ["business", "markets", "technology"], 'doc_id')} AS section
        FROM (SELECT *, {pick(B.COMPANIES, "CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER)")} AS company,
          CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END AS link_no FROM documents))"""),
    "answers": ([], """SELECT conv_id, turn, text || marks AS answer,
      '**Executive Summary**' || chr(10) || '- ' || replace(text, chr(10), chr(10) || '• ') ||
      CASE WHEN turn % 3 = 0 THEN chr(10) || chr(10) || 'Investor Insights:' || chr(10) || '* short' || chr(10)
        ELSE chr(10) || chr(10) || 'Investor Insights:' || chr(10) || '* Margin moved <b>up</b> 15% to $3' || marks || chr(10) || '- - Guidance kept at 10-12% for Q2 2024' || chr(10) END ||
      chr(10) || '# Catalysts & Risks' || chr(10) || 'plain line' || chr(10) || '• Revenue estimate 4.5x above target with 20% probability' AS analysis
      FROM (SELECT *, ' [^' || turn || '] and (S' || (conv_id % 9) || '), { s' || turn || '} [12]' AS marks
        FROM conversations WHERE role = 'assistant')"""),
    "api_usage": ([], """SELECT event_id, ts, event_type AS api_source, event_type <> 'error' AS success,
      value AS response_time_ms, value > 200 AS rate_limited FROM events"""),
    "metrics": ([], f"""SELECT *, alphavantage_articles + nyt_articles + rss_articles + google_articles AS total_articles,
      (alphavantage_articles + nyt_articles + rss_articles + google_articles) // 3 AS premium_sources
      FROM (SELECT event_id, ts, 'C' || user_id AS company, k % 9 AS alphavantage_articles, k % 5 AS nyt_articles, k % 7 AS rss_articles,
        event_id % 4 AS google_articles, {pick(B.QUALITY_LABELS, 'event_id')} AS analysis_quality, value / 10 AS response_time_seconds,
        event_id % 3 = 0 AS escalated, CAST((event_id * 7) % 101 AS DOUBLE) AS relevance_percentage
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""),
}


def sql(needs: list[str] | str, body: str, extra: dict[str, str] | None = None) -> str:
    """A query over role tables: the needed CTEs in dependency order, then the body."""
    needs = [needs] if isinstance(needs, str) else needs
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS (\n{CTES[n][1]})" for n in ordered]
    parts += [f"{n} AS (\n{text})" for n, text in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
