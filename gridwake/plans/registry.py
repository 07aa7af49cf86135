"""A list of queries with, where there is one, the SQL text that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridwake.plans.base import once

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, repeated: bool = False) -> Callable[[Query], Query]:
        """Registers a query; its SQL text counts each key once too, unless the query looks at ``repeated`` rows."""

        def take(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is there twice")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql if repeated else once(sql)
            return f

        return take
