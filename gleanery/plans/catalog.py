"""Registry of the queries: a job over the inputs, and its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.sources.adapters import Inputs, with_inputs

_JOBS: dict[str, Callable[[Inputs], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of the inputs under its own name."""

    def register(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        _JOBS[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _job(f: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Inputs(spark, sf_dir))


def _load() -> None:
    from gleanery.plans import flow, reading, state, texts  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _job(f) for name, f in _JOBS.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_inputs(sql) for name, sql in _SQL.items()}


def epoch(column: str):
    """A timestamp as whole seconds, under the same name."""
    return F.col(column).cast("long").alias(column)


def at(text: str):
    return F.lit(text).cast("timestamp")
