"""Keyed overlay of sparse tables: the first non-missing value wins, column by column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparcel.functions.nulls import nan_to_null


def _present(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return nan_to_null(df[name])
    return df[name]


def overlay(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of keys and of columns; ``left`` wins where it has a value.

    Non-key columns come back in sorted order. Keys must be unique per side
    (see :func:`compact`); a key that repeats would multiply.
    """
    values = sorted((set(left.columns) | set(right.columns)) - set(keys))
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])
    cols = [F.coalesce(left[k], right[k]).alias(k) for k in keys]
    for v in values:
        sides = [_present(side, v) for side in (left, right) if v in side.columns]
        cols.append(F.coalesce(*sides).alias(v))
    return left.join(right, on, "full_outer").select(*cols)


def overlay_all(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-to-right overlay of many tables in one shuffle.

    All tables are stacked with their rank; per key and column the lowest rank that
    has a value wins. A chain of joins would shuffle once per table.
    """
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [
            t.select(*keys, *[_present(t, c).alias(c) for c in t.columns if c not in keys]).withColumn(
                "_rank", F.lit(i)
            )
            for i, t in enumerate(tables)
        ],
    )
    values = sorted(set(stacked.columns) - set(keys) - {"_rank"})
    return stacked.groupBy(*keys).agg(
        *[F.min_by(v, F.when(F.col(v).isNotNull(), F.col("_rank"))).alias(v) for v in values]
    )


def compact(log: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Collapse an append-only record log: per key and column the newest value wins.

    A later record that lacks a value does not erase an earlier one.
    """
    values = sorted(set(log.columns) - set(keys) - set(seq))
    order = F.struct(*seq)
    return log.groupBy(*keys).agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), order)).alias(v) for v in values]
    )


def stack(tables: dict[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """Rows of several roots with their name; absent columns become NULL."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
