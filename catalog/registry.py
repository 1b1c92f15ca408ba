"""Name -> (Spark query, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None):
    def keep(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = (function, sql)
        return function

    return keep


def r6(value) -> Column:
    """Rounded double without negative zero, as in the SQL texts."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), 6) + F.lit(0.0)


def n(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("bigint")
