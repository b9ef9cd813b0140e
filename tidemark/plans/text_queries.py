"""Registered queries over report texts; most are checked against the facts behind the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.operators import report_text as T
from tidemark.plans import bindings as B
from tidemark.plans.oracle_tables import quoted, sql
from tidemark.plans.portfolio_queries import _rounded
from tidemark.plans.registry import query


def _reports(spark, sf):
    return B.report_text(spark, sf)


def _summaries(spark, sf):
    return T.index_summaries(_reports(spark, sf))


def _count(text: str, word: str) -> str:
    return f"(length({text}) - length(replace({text}, {quoted(word)}, ''))) // {len(word)}"


def _type_cte() -> dict[str, str]:
    cols = []
    for k in ("Manufacturing", "Services"):
        cols.append(" + ".join(f"{_count('u', w)} * {n}" for w, n in V.TYPE_KEYWORDS[k].items()) + f" AS words_{k}")
        cols.append(" + ".join(_count("u", w) for w in V.TYPE_INDUSTRIES[k]) + f" AS mentions_{k}")
        cols.append("(" + " + ".join(f"CAST(regexp_matches(text, {quoted('(?is)' + p)}) AS INTEGER)" for p in V.TYPE_STRUCTURES[k])
                    + f") / {len(V.TYPE_STRUCTURES[k])} * 100 AS shape_{k}")
    share = "CASE WHEN {a} + {b} = 0 THEN 50 ELSE {a} / ({a} + {b}) * 100 END"
    def total(k, o):
        return (share.format(a=f"words_{k}", b=f"words_{o}") + f" * 0.5 + shape_{k} * 0.3 + "
                + share.format(a=f"mentions_{k}", b=f"mentions_{o}") + " * 0.2")
    return {"counted": f"SELECT doc_id, {', '.join(cols)} FROM (SELECT doc_id, text, upper(text) AS u FROM report_text)",
            "typed": f"SELECT doc_id, {total('Manufacturing', 'Services')} AS m, {total('Services', 'Manufacturing')} AS s FROM counted"}


@query("t01_report_type", sql("report_text", "SELECT doc_id, round(m, 6) AS manufacturing_score, round(s, 6) AS services_score, CASE WHEN m > s THEN 'Manufacturing' ELSE 'Services' END AS report_type FROM typed", _type_cte()))
def report_type(spark, sf):
    return _rounded(T.type_scores(_reports(spark, sf)), {"manufacturing_score": 6, "services_score": 6})


@query("t02_type_by_vote", sql("report_text", "SELECT doc_id, report_type FROM report_text"))
def type_by_vote(spark, sf):
    return _reports(spark, sf).select("doc_id", T.type_by_vote(F.col("text")).alias("report_type"))


@query("t03_report_month", sql("report_text", "SELECT doc_id, month_year, month_year AS frequent_month FROM report_text"))
def report_month(spark, sf):
    return _reports(spark, sf).select("doc_id", T.report_month(F.col("text")).alias("month_year"),
                                      T.most_frequent_month(F.col("text")).alias("frequent_month"))


@query("t04_month_fallback", sql("report_text", "SELECT doc_id, month_year AS from_name, strftime(CAST(report_date + 40 AS DATE), '%B %Y') AS from_change FROM report_text"))
def month_fallback(spark, sf):
    rows = _reports(spark, sf)
    return rows.select("doc_id", T.month_fallback(F.col("file_name"), F.col("modified")).alias("from_name"),
                       T.month_fallback(F.lit("report.pdf"), F.col("modified")).alias("from_change"))


@query("t05_glance_section", sql("report_text", """SELECT doc_id, length(part) AS size, md5(part) AS digest FROM (
  SELECT doc_id, substr(text, p, CASE WHEN e > 0 THEN e + 4 ELSE length(text) END) AS part FROM (
    SELECT *, strpos(lower(substr(text, p)), 'month') AS e FROM (SELECT doc_id, text, strpos(text, upper(report_type) || ' AT A GLANCE') AS p FROM report_text)))"""))
def glance_section(spark, sf):
    rows = _reports(spark, sf).select("doc_id", F.coalesce(
        T.glance_section(F.col("text"), "Manufacturing"), T.glance_section(F.col("text"), "Services")).alias("part"))
    return rows.select("doc_id", F.length("part").cast("bigint").alias("size"), F.md5("part").alias("digest"))


@query("t06_glance_table", sql("report_facts", "SELECT doc_id, index_name, value_text AS value, direction FROM report_facts"))
def glance_table(spark, sf):
    return T.glance_table(_reports(spark, sf))


@query("t07_index_summaries", sql("report_sections", "SELECT doc_id, index_name, body AS summary FROM report_sections"))
def index_summaries(spark, sf):
    return _summaries(spark, sf)


@query("t08_summary_values", sql("report_facts", """SELECT doc_id, index_name, value, CASE WHEN v >= 500 THEN 'Growing' ELSE 'Contracting' END AS direction FROM report_facts"""))
def summary_values(spark, sf):
    return T.summary_values(_summaries(spark, sf))


@query("t09_guarded_values", sql("report_facts", """SELECT doc_id, index_name, value, CASE WHEN v >= 500 THEN 'Growing' ELSE 'Contracting' END AS direction FROM report_facts WHERE NOT with_change"""))
def guarded_values(spark, sf):
    return T.guarded_values(_summaries(spark, sf))


LISTS = {"lists": """SELECT doc_id, i, index_name, pos AS category, unnest(ups) AS industry_name, unnest(range(0, 3)) AS rank FROM report_facts WHERE NOT by_sentence
    UNION ALL SELECT doc_id, i, index_name, neg, unnest(CASE WHEN conflicted THEN list_append(downs, ups[1]) ELSE downs END), unnest(range(0, CASE WHEN conflicted THEN 3 ELSE 2 END)) FROM report_facts WHERE NOT by_sentence"""}


@query("t10_industry_lists", sql("report_facts", "SELECT doc_id, index_name, category, string_agg(industry_name, '; ' ORDER BY rank) AS industries FROM lists GROUP BY ALL", LISTS))
def industry_lists(spark, sf):
    rows = T.industry_lists(_summaries(spark, sf))
    return rows.select("doc_id", "index_name", "category", F.array_join(T.split_industries(F.col("list_text")), "; ").alias("industries"))


@query("t11_industry_mentions", sql("report_facts", "SELECT doc_id, index_name, category, industry_name, rank FROM lists", LISTS))
def industry_mentions(spark, sf):
    return T.industry_mentions(T.industry_lists(_summaries(spark, sf)))


@query("t12_sentence_mentions", sql("report_lines", """SELECT doc_id, index_name, 'Growing' AS category, 1 + c AS sentence_no, unnest(range(0, 2)) AS pos, unnest(['Machinery', 'Primary Metals']) AS industry_name FROM plain
  UNION ALL SELECT doc_id, index_name, 'Declining', 2 + c, unnest(range(0, 2)), unnest(['Textile Mills', 'Wood Products']) FROM plain""",
    {"plain": "SELECT *, CAST(with_change AS INTEGER) AS c FROM report_lines WHERE by_sentence"}))
def sentence_mentions(spark, sf):
    return T.sentence_mentions(_summaries(spark, sf))


@query("t13_resolved_conflicts", sql("report_facts", """SELECT doc_id, index_name, pos AS category, unnest(ups) AS industry_name, unnest(range(0, 3)) AS rank FROM report_facts WHERE NOT by_sentence
  UNION ALL SELECT doc_id, index_name, neg, unnest(downs), unnest(range(0, 2)) FROM report_facts WHERE NOT by_sentence"""))
def resolved_conflicts(spark, sf):
    return T.resolved_mentions(_summaries(spark, sf))


@query("t14_merged_extractions", sql("report_facts", """SELECT doc_id, index_name, value, CASE WHEN NOT with_change THEN CASE WHEN v >= 500 THEN 'Growing' ELSE 'Contracting' END ELSE direction END AS direction,
  CASE WHEN NOT with_change THEN 2 ELSE 1 END AS source_order FROM report_facts"""))
def merged_extractions(spark, sf):
    return T.merged_values(_reports(spark, sf))


@query("t15_analysis_bullets", sql("answers", f"""SELECT conv_id, turn, section, row_number() OVER (PARTITION BY conv_id, turn, section ORDER BY n) - 1 AS pos, bullet FROM (
    SELECT conv_id, turn, 'executive' AS section, n, trim(regexp_replace(line, '^[•\\-* ]+', '')) AS bullet FROM lines WHERE n <= body
    UNION ALL SELECT conv_id, turn, 'executive', 0, {quoted(V.EMPTY_SECTION)} FROM sized WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.conv_id = sized.conv_id AND l.turn = sized.turn AND n <= body AND length(trim(regexp_replace(line, '^[•\\-* ]+', ''))) > 10)
    UNION ALL SELECT conv_id, turn, 'investor', 1, CASE WHEN turn % 3 = 0 THEN {quoted(V.EMPTY_SECTION)} ELSE 'Margin moved <b>up</b> 15% to $3' || marks END FROM sized
    UNION ALL SELECT conv_id, turn, 'investor', 2, 'Guidance kept at 10-12% for Q2 2024' FROM sized WHERE turn % 3 <> 0
    UNION ALL SELECT conv_id, turn, 'catalysts', 1, 'Revenue estimate 4.5x above target with 20% probability' FROM sized) WHERE length(bullet) > 10""",
    {"sized": """SELECT c.conv_id, c.turn, text, len(string_split(text, chr(10))) AS body, ' [^' || c.turn || '] and (S' || (c.conv_id % 9) || '), { s' || c.turn || '} [12]' AS marks
       FROM conversations c WHERE role = 'assistant'""",
     "lines": "SELECT conv_id, turn, body, unnest(string_split(text, chr(10))) AS line, unnest(range(1, body + 1)) AS n FROM sized"}))
def analysis_bullets(spark, sf):
    return T.analysis_bullets(B.answers(spark, sf), ["conv_id", "turn"])
