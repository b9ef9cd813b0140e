"""The whole article selection: relevance, de-duplication, ranking, for all companies at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import dedup as D
from tidemark.operators import relevance as R
from tidemark.runtime import cut_lineage

LONG_TEXTS = ("snippet", "full_content")


def article_facts(articles: DataFrame) -> DataFrame:
    """All that the selection needs to know of each article, from one pass over the texts, stored without them."""
    rows = R.ranked_articles(R.assess(R.resolve_companies(articles)))
    known = [c for c in articles.columns if c not in LONG_TEXTS]
    return cut_lineage(rows.select(*known, "overall_relevance", "is_company_specific", "score", "mentions_company", "has_finance_word"))


def select_articles(articles: DataFrame) -> DataFrame:
    """The final articles of every company, placed 1 ... 30.

    All text work happens row by row in one scan; from there on only scores, flags and short
    columns are read and travel through exchanges.
    """
    facts = article_facts(articles)
    relevant = R.relevant_articles(facts.select("company", "link", "overall_relevance", "is_company_specific"), R.batch_statistics(facts))
    scored = facts.where(F.col("score") >= R.LEAST_SCORE).drop("overall_relevance", "is_company_specific")
    unique = scored.join(D.kept_keys(facts, ["company"]), ["company", "seq"], "left_semi")
    return R.final_selection(R.relevance_by_link(unique, relevant))
