"""The registered queries, name to function, and the SQL that each must agree with."""

from __future__ import annotations

from .plans import choices, clients, compare, event_time, evidence, history, lines, messages, outcomes, packs, queues, records, texts

FLAGSHIP = "client_article_profile"
MODULES = (history, compare, texts, queues, messages, event_time, records, clients, outcomes, packs, choices, lines, evidence)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
