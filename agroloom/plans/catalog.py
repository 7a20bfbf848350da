"""All registered queries of the engine and their SQL, by name."""

from __future__ import annotations

from agroloom.plans import answer_queries, claim_queries, dialogue_queries, fact_queries, retrieval_queries

MODULES = (retrieval_queries, dialogue_queries, fact_queries, claim_queries, answer_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
