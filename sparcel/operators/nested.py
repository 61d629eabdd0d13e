"""Nested objects of any depth as flat rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.session import stage

#: Levels that are opened in one plan; what is deeper goes on from a written table.
LEVELS = 40


def nesting(text: str) -> Column:
    """How deep the objects of a JSON text nest; braces inside strings don't count."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', "")
    braces = F.split(F.regexp_replace(bare, r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(braces, start, step, lambda s: s["most"])


def flatten_objects(df: DataFrame, keep: Sequence[str], column: str, depth: int) -> DataFrame:
    """(*keep, key, value) of the leaves of a VARIANT column whose objects nest ``depth`` deep; keys are joined with ``/``.

    Each level is one generator over all rows, in which leaves stay as they are. An object without keys has no leaf.
    """
    flat = df.select(*keep, F.lit(None).cast("string").alias("key"), F.col(column).alias("value"))
    inside = "transform(map_entries(try_cast(value AS map<string, variant>)), e -> struct(concat_ws('/', key, e.key) AS key, e.value AS value))"
    for level in range(depth):
        if level and level % LEVELS == 0:
            flat = stage(flat, "leaves")
        flat = flat.select(*keep, F.explode(F.expr(f"coalesce({inside}, array(struct(key, value)))")).alias("leaf")).select(*keep, "leaf.*")
    return flat
