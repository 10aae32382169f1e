"""Queries of the text problems, and the SQL they are held against."""

from __future__ import annotations

from tidewell.llm import posting_queries, text_queries
from tidewell.session import shipping

MODULES = (posting_queries, text_queries)


def queries() -> dict:
    return {name: shipping(q) for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
