"""The registered queries of the timeline and catalogue operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register the decorated function (spark, sf_dir) -> DataFrame under ``name``, with SQL where there is any."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def load() -> None:
    """Import the modules that register queries."""
    from . import file_queries, report_queries, source_queries, store_queries, text_queries, timeline_queries  # noqa: F401
