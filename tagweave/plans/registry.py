"""Registry of checkable queries: each entry pairs a Spark builder
``(spark, sf_dir) -> DataFrame`` with the DuckDB SQL that must give the same
rows (or ``None`` when no SQL form exists)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tagweave.plans.oracle_views import with_views
from tagweave.session import ship_package
from tagweave.sources.tables import Tables


@dataclass
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


QUERIES: dict[str, Query] = {}


def register(key: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Decorator: ``fn(tables: Tables) -> DataFrame`` becomes a registered query."""
    def deco(fn: Callable[[Tables], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Tables(spark, sf_dir))
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = Query(key, build, with_views(sql, *views) if sql else None, fn.__doc__ or "")
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from tagweave.plans import (q_sampling, q_text, q_relational, q_reactions,  # noqa: F401
                                q_vectors, q_models, q_lens, q_cluster, q_language, q_mllib)
    return QUERIES
