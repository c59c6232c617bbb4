"""Registry of named queries: the Spark job and, where it can be written, the SQL to check it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Callable], Callable]:
    """Register a job under ``name``; it receives a :class:`~.views.Tables` over the data folder."""
    def register(job: Callable) -> Callable:
        from .views import Tables

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: job(Tables(spark, folder))
        if check is not None:
            CHECKS[name] = check
        return job

    return register


def with_views(*views: str, body: str, recursive: bool = False) -> str:
    """SQL text with the given view definitions in front."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(views) + "\n" + body
