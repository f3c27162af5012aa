"""Registry of named queries: a Spark plan and, where SQL can say the same, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """``run(spark, sf_dir)`` builds the plan; ``sql`` is the DuckDB text with equal rows, or None."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function under ``name``."""

    def add(run):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, sql)
        return run

    return add
