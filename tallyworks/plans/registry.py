"""A registry of queries and their SQL for one group."""

from __future__ import annotations

from collections.abc import Callable


class Group:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle_sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracle_sql[f.__name__] = sql
            return f

        return add
