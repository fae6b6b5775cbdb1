"""A registry of queries: each reads views of the given tables; most have SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from posegrid.session import ship
from posegrid.views import view, with_views


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, *views: str, sql: str | None = None):
        """Register a function of DataFrames (the views, in order) under its own name."""

        def add(f: Callable) -> Callable:
            def run(spark, sf_dir):
                ship(spark)
                return f(*[view(spark, sf_dir, v) for v in views])

            self.queries[f.__name__] = run
            if sql:
                self.sql[f.__name__] = with_views(sql)
            return f

        return add
