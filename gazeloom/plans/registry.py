"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, in the order they were added."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Registers the decorated query under its own name, with its SQL if it has one."""

        def keep(query: Query) -> Query:
            key = name or query.__name__
            if key in self.queries:
                raise ValueError(f"{key} is registered twice")
            self.queries[key] = query
            if sql is not None:
                self.sql[key] = sql
            return query

        return keep
