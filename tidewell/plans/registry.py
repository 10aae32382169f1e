"""All queries of the core, and the SQL they are held against."""

from __future__ import annotations

from tidewell.plans import board_plans, data_queries, job_plans, posting_plans, wording_plans
from tidewell.session import shipping

MODULES = (data_queries, posting_plans, job_plans, wording_plans, board_plans)


def queries() -> dict:
    return {name: shipping(q) for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
