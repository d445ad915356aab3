"""Registers of queries by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """(queries, SQL, decorator): the decorator takes a query's SQL, or nothing where SQL can't express it."""
    queries: dict[str, Callable] = {}
    texts: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                texts[f.__name__] = sql
            return f

        return add

    return queries, texts, query
