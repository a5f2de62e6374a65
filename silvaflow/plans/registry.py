"""All registered queries of the forest-structure engine and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: name -> (callable of (spark, sf_dir), SQL of the same rows or None)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"silvaflow.plans.{name}")


MODULES: tuple[str, ...] = ("quality", "relational", "statistics", "flows", "files", "expressions", "cascades", "spatial", "summaries", "simulation", "modelling")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    load()
    return QUERIES["tile_class_means"][0](spark, sf_dir)


def queries() -> dict:
    load()
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
