"""Named queries over the driver tables, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("pipeline_views", "search_views", "corpus_views", "vector_views", "quality_views", "upkeep_views", "event_views", "posting_views", "tracking_views", "retrieval_views", "source_views", "linkage_views", "keyword_views", "learned_views", "requirement_views", "set_views")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with the SQL that DuckDB answers it by."""

    def keep(fn):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return keep


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"brindle.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["funnel_score_bands"](spark, sf_dir)
