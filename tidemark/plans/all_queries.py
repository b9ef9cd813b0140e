"""Importing this module registers every query family."""

from tidemark.plans import (  # noqa: F401
    cleaning_queries, company_queries, evidence_queries, index_queries, monitoring_queries, news_queries, portfolio_queries, source_queries,
    stream_queries, text_queries)
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
