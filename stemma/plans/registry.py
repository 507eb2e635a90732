"""The queries by name, each with the ids of the operators it covers and, where SQL can express it, DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = Query(run.__name__, tuple(covers.split()), run, sql)
        return run

    return register


def every() -> dict[str, Query]:
    from stemma.plans import catalog  # noqa: F401  registers all

    return QUERIES
