"""Filter cascades with running counts, and pending-work masks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.functions.nulls import not_true

Step = tuple[str, Column]


def cascade_counts(df: DataFrame, steps: Sequence[Step], by: Sequence[str] = ()) -> DataFrame:
    """How many rows are left after each step, in one pass over the table."""
    counts = [F.count(F.lit(1)).alias("total")]
    passed = F.lit(True)
    for name, predicate in steps:
        passed = passed & predicate
        counts.append(F.count_if(passed).alias(name))
    return df.groupBy(*by).agg(*counts) if by else df.agg(*counts)


def cascade(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """The rows that pass every step."""
    return df.filter(reduce(lambda a, b: a & b, [p for _, p in steps], F.lit(True)))


def pending(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows for which at least one stage is unfinished; an absent flag column means all."""
    if any(flag not in df.columns for flag in flags):
        return df
    return df.filter(reduce(lambda a, b: a | b, [not_true(F.col(f)) for f in flags]))
