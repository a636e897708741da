"""Registered queries: name -> (Spark builder, declared columns, oracle SQL).

Builders take (spark, sf_dir) and read the driver test tables through
``sources.testmap``; the work then runs through the library operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furrow.plans.spec import Query, finish, wrap_sql

_REGISTRY: dict[str, Query] = {}


def register(name: str, columns, sql: str | None = None, doc: str = ""):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir), columns, compared=sql is not None)

        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        _REGISTRY[name] = Query(name, build, list(columns), sql, doc or (fn.__doc__ or ""))
        return fn

    return deco


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_REGISTRY)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.build for k, q in all_queries().items()}


def oracle_queries() -> dict[str, str]:
    return {k: wrap_sql(q.sql, q.columns) for k, q in all_queries().items() if q.sql}


_LOADED = False


def _load():
    global _LOADED
    if _LOADED:
        return
    _LOADED = True
    # Import for side effects: each module registers its queries.
    from furrow.plans import q_inference, q_ingest, q_models, q_panel, q_profile, q_sequence, q_trees  # noqa: F401
