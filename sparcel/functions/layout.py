"""Channel layouts of packed attribute arrays, and the geometry of a voxel grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel_layout(channels: Sequence[tuple[str, int]]) -> dict[str, tuple[int, int]]:
    """Start and width of each named attribute, from the running sum of the channel counts."""
    out, start = {}, 0
    for name, width in channels:
        out[name] = (start, width)
        start += width
    return out


def channels_of(attrs: str | Column, layout: dict[str, tuple[int, int]], name: str) -> Column:
    start, width = layout[name]
    return F.slice(attrs, start + 1, width)


def cell_position(index: Column, voxel_size: float, origin: float) -> Column:
    """Center of a cell along one axis."""
    return (index + 0.5) * voxel_size + origin


def grid_geometry(
    lower: Sequence[float],
    upper: Sequence[float],
    voxel_size: float | None = None,
    grid_size: int | None = None,
    fit: bool = False,
) -> dict[str, list]:
    """Box, voxel size and cell counts when one of voxel size and grid size is given.

    With ``fit`` the box is grown evenly first: to whole voxels when the voxel size is
    given, by one voxel of margin when the grid size is.
    """
    if voxel_size is None and grid_size is None:
        raise ValueError("give voxel_size or grid_size")
    lower, upper = list(lower), list(upper)
    if fit:
        for i in range(3):
            extent = upper[i] - lower[i]
            if voxel_size is not None:
                pad = math.ceil(extent / voxel_size) * voxel_size - extent
            else:
                pad = extent / (grid_size - 1)
            lower[i] -= pad / 2
            upper[i] += pad / 2
    if voxel_size is None:
        sizes = [(u - lo) / grid_size for lo, u in zip(lower, upper)]
        counts = [grid_size] * 3
    else:
        sizes = [voxel_size] * 3
        counts = [round((u - lo) / voxel_size) for lo, u in zip(lower, upper)]
    return {"lower": lower, "upper": upper, "voxel_size": sizes, "grid_size": counts}
