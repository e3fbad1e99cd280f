"""A query and its DuckDB SQL, registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its own name; `sql` may use {NAME} for a CTE of plans.derived."""
        from . import derived

        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                ctes = {k[:-4]: v for k, v in vars(derived).items() if k.endswith("_SQL")}
                text = sql
                for k, v in ctes.items():
                    text = text.replace("{" + k + "}", v)
                self.sql[f.__name__] = text
            return f

        return put


def r6(v: Column) -> Column:
    """Rounded to 6 decimals, without a negative zero."""
    return F.round(v, 6) + F.lit(0.0)


def r4(v: Column) -> Column:
    return F.round(v, 4) + F.lit(0.0)
