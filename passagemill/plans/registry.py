"""All named queries and the SQL for those that SQL can say."""

from __future__ import annotations

from passagemill.plans import endtoend, scoring, search, texts

MODULES = (search, texts, scoring, endtoend)


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
