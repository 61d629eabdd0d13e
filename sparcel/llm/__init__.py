"""Training-data operators and the queries that apply them to the given tables.

Nothing else in the library imports this package. ``load_all`` gives every query of the
package as name -> (build, sql); sql is None where SQL cannot say it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Build, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register ``build(spark, sf_dir)`` under ``name``."""

    def register(build: Build) -> Build:
        REGISTRY[name] = (build, sql)
        return build

    return register


def load_all() -> dict[str, tuple[Build, str | None]]:
    from sparcel.llm import queries  # noqa: F401  registers on import

    return REGISTRY
