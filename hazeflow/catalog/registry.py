"""Collects the registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with its DuckDB twin if there is one."""

    def register(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _oracles[name] = sql
        return f

    return register


def _load() -> None:
    from hazeflow.catalog import (  # noqa: F401
        audit_queries,
        feature_queries,
        job_queries,
        model_queries,
        scalar_queries,
        source_queries,
        training_queries,
    )


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)
