"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cinderlake import context_queries, document_queries, event_queries, pack_queries, registry, telemetry_queries, typed_queries, validation_queries  # noqa: F401  (importing registers)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.queries)


def oracle_sql() -> dict[str, str]:
    return dict(registry.twins)
