"""Where the catalogs register their queries and the SQL twins (DuckDB) that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
twins: dict[str, str] = {}


def twin(sql: str = ""):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        queries[f.__name__] = f
        if sql:
            twins[f.__name__] = sql
        return f

    return add
