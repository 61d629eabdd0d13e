"""Quantisation to bytes, bit packing, and moving coordinates between resolutions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_byte(value: Column) -> Column:
    """Clamp to [0, 1], scale to 0..255, drop the fraction."""
    return F.floor(F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)) * 255).cast("int")


def from_byte(value: Column) -> Column:
    return value / F.lit(255.0)


def signed_from_byte(value: Column) -> Column:
    """Bytes back to [-1, 1]."""
    return value / F.lit(255.0) * 2 - 1


def pack_flags(*flags: Column) -> Column:
    """First flag in the lowest bit."""
    return reduce(lambda a, b: a + b, [f.cast("int") * (1 << i) for i, f in enumerate(flags)])


def unpack_flag(packed: Column, i: int) -> Column:
    return F.shiftright(packed, i).bitwiseAND(F.lit(1)) == 1


def byte_diff(a: Column, b: Column) -> Column:
    """Difference modulo 256."""
    return F.pmod(a - b, F.lit(256))


def rescale_coordinate(c: Column, low_res: int, high_res: int) -> Column:
    """Cell index at another resolution, through the cell center."""
    return F.floor((c + 0.5) / low_res * (high_res // 16)).cast("int")


def nearest_power_of_two(n: Column) -> Column:
    """Nearest power of two; a tie goes up."""
    low = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double"))))
    return F.when(n - low < low * 2 - n, low).otherwise(low * 2).cast("bigint")
