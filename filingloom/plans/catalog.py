"""Every query of the filing-corpus operators, with its SQL."""

from __future__ import annotations

from filingloom.plans import corpus_queries, fact_queries, filing_queries, source_queries, text_queries  # noqa: F401  they register their queries
from filingloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
