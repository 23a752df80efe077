"""Registered queries: each is a function of (spark, data directory), and most have SQL that gives the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def load() -> tuple[dict, dict[str, str]]:
    """All queries and their SQL."""
    from pagewright.queries import artifacts, corpus, evaluation, hops, integrity, notes, registered, retrieval, tables, trees, upkeep  # noqa: F401

    return QUERIES, ORACLE_SQL
