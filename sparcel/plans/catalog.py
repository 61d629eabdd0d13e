"""The query catalogue."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None
    covers: str


CATALOG: dict[str, Query] = {}


def _without_negative_zero(sql: str) -> str:
    """Add 0 to every rounded value: DuckDB rounds small negatives to -0.0, Spark to 0.0."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 1, start + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = _without_negative_zero(sql[start + len("round(") : end - 1])
        out += f"{sql[at:start]}(round({inner}) + 0)"
        at = end
    return out + sql[at:]


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register ``build(spark, sf_dir)`` under ``name``; ``covers`` lists inventory ids."""

    def register(build: Build) -> Build:
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Query(name, build, sql and _without_negative_zero(sql), covers)
        return build

    return register
