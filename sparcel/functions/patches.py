"""Index arithmetic between dense grids and patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def patch_of(coords: Sequence[Column], size: int) -> tuple[list[Column], Column]:
    """Patch coordinates and the channel a position takes inside its patch (last axis fastest)."""
    channel = F.lit(0)
    for c in coords:
        channel = channel * size + F.pmod(c, F.lit(size))
    return [F.floor(c / size).cast("int") for c in coords], channel


def pixel_of(tiles: Sequence[Column], channel: Column, size: int) -> list[Column]:
    """Inverse of :func:`patch_of`; with upscaled tiles it is the pixel shuffle."""
    rank = len(tiles)
    inner = [F.pmod(F.floor(channel / size ** (rank - 1 - i)), F.lit(size)).cast("int") for i in range(rank)]
    return [t * size + c for t, c in zip(tiles, inner)]
