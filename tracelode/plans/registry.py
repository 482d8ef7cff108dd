"""Named queries: a function of (spark, sf_dir), and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import adapters

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None, views: tuple[str, ...] = ("elog",)):
        """Registers f(*views) under a name; sql names views and tables in braces."""

        def register(f):
            self.queries[name] = lambda spark, sf_dir: f(*[adapters.view(spark, sf_dir, v) for v in views])
            if sql:
                self.sql[name] = adapters.duck(sql)
            return f

        return register
