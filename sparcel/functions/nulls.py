"""Flag predicates under missing values: a missing flag is neither true nor finished."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_true(flag: Column) -> Column:
    """True only for a stored true; NULL counts as false."""
    return flag.eqNullSafe(F.lit(True))


def not_true(flag: Column) -> Column:
    """True for false *and* for NULL, so unfinished rows are kept."""
    return ~flag.eqNullSafe(F.lit(True))


def is_missing(value: Column) -> Column:
    """NULL or NaN, the two spellings of an absent number."""
    return value.isNull() | F.isnan(value)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def all_finite(values: Column) -> Column:
    """No NaN and no infinity in an array of doubles."""
    return F.forall(values, lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
