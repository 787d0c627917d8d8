"""Registry of named queries: Spark plan + (optional) DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigil.plans.oracle import with_tables
from vigil.sources.adapters import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``.

    ``sql`` is the DuckDB oracle over the entity CTEs named in ``tables``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_tables(sql, *tables)
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from vigil.plans import catalog_facts, catalog_misc, catalog_network, catalog_process, catalog_stream  # noqa: F401
