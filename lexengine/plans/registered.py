"""Queries that stand beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES, SQL = {}, {}


def query(sql: str) -> Callable:
    """Registers a query under its name, with the SQL that gives the same rows."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register
