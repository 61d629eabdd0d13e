"""Cells to image tiles: tile lists in depth order and the first cell a pixel ray meets."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.operators.mesh import AXES, cross, dot, minus
from sparcel.operators.ordered import group_position, running
from sparcel.session import stage


def tile_overlaps(boxes: DataFrame, tile: int, width: int, height: int, view: str, item: str) -> DataFrame:
    """One row per item and touched tile. Boxes are pixel ranges x0..x1, y0..y1 (ends exclusive)."""

    def span(lo, hi, size):
        last = (size - 1) // tile
        first = F.greatest(F.floor(F.col(lo) / tile).cast("int"), F.lit(0))
        end = F.least(F.floor((F.col(hi) - 1) / tile).cast("int"), F.lit(last))
        return F.when(end >= first, F.sequence(first, end)).otherwise(F.array().cast("array<int>"))

    across = -(-width // tile)
    return (
        boxes.withColumn("_tx", F.explode(span("x0", "x1", width)))
        .withColumn("_ty", F.explode(span("y0", "y1", height)))
        .select(view, item, "depth", (F.col("_ty") * across + F.col("_tx")).alias("tile"))
    )


def tile_list(overlaps: DataFrame, view: str, item: str) -> DataFrame:
    """The items of each tile numbered by depth; a crowded tile is numbered by many tasks."""
    return group_position(overlaps, [view, "tile"], ["depth", item], "rank")


def tile_ranges(tiles: DataFrame, view: str) -> DataFrame:
    """Start and stop of each tile in its view's list (by tile, then depth), how many items it holds and the nearest depth."""
    held = tiles.groupBy(view, "tile").agg(F.count(F.lit(1)).alias("len"), F.min("depth").alias("nearest"))
    held = stage(held, "tiles")  # a row per tile, which the running sum reads twice
    return running(held, [view], ["tile"], {"start": F.col("len")}, exclusive=True).withColumn("stop", F.col("start") + F.col("len"))


def first_hits(cells: DataFrame, view: str, values: Sequence[str], n: int, width: int) -> DataFrame:
    """Orthographic first hit along z: for every pixel of a width x width image the nearest covered cell.

    Cell i covers the pixels from ``i * width div n`` to ``(i + 1) * width div n - 1``, so a width that is no
    multiple of n is covered without gaps, and in an image of fewer pixels than cells some
    cells cover none. Pixels without a hit have no row.
    """

    def covered(axis: str):
        first, last = F.expr(f"cast({axis} * {width} div {n} as int)"), F.expr(f"cast(({axis} + 1) * {width} div {n} as int)") - 1
        return F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))

    pixels = cells.withColumn("py", covered("y")).withColumn("px", covered("x"))
    nearest = [F.min("z").alias("z"), *[F.min_by(v, "z").alias(v) for v in values]]
    return pixels.groupBy(view, "py", "px").agg(*nearest)


#: Pixels by which the projection of a cell is widened before pixel middles are looked for in it, against rounding (fixed value).
MARGIN = 1e-4

#: Cells whose center is no further in front of the camera are not drawn (fixed value).
NEAR = 0.2


def _unit(v: Sequence[Column]) -> list[Column]:
    length = F.sqrt(dot(v, v))
    return [c / length for c in v]


def look_at(cameras: DataFrame, target: Sequence[Column], up: Sequence[float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """Cameras at px, py, pz with the unit vectors r* (right), d* (down) and f* (forward) of a view towards ``target``."""
    ahead = cameras.withColumns({f"f{a}": c for a, c in zip(AXES, _unit(minus(target, [F.col(f"p{a}") for a in AXES])))})
    forward = [F.col(f"f{a}") for a in AXES]
    sided = ahead.withColumns({f"r{a}": c for a, c in zip(AXES, _unit(cross(forward, [F.lit(u) for u in up])))})
    return sided.withColumns({f"d{a}": c for a, c in zip(AXES, cross(forward, [F.col(f"r{a}") for a in AXES]))})


def project_cells(cells: DataFrame, cameras: DataFrame, view: str, item: str, edge: float, width: int, height: int) -> DataFrame:
    """Pixel ranges x0..x1, y0..y1 (ends exclusive) that may see each cell, and its depth, with all columns of cell and camera.

    ``cells`` has the center x, y, z; ``cameras`` one row per view with position, axes (see ``look_at``) and ``focal`` in pixels. The eight corners
    of a cell are projected; a cell that reaches behind the camera may be anywhere in the image. Cells nearer than ``NEAR`` and
    those outside the image have no row. ``in_x``, ``in_y`` are the first and last pixel whose middle may lie in the projection. The corners are
    an array: written out, the code of all of them is too long to be compiled at run time.
    """
    seen = cells.join(cameras.hint("shuffle_hash"), view)  # cells are never the side that is sent around
    d = [F.col(a) - F.col(f"p{a}") for a in AXES]
    seen = seen.withColumns({f"_{n}": dot(d, [F.col(f"{n}{a}") for a in AXES]) for n in "rdf"}).filter(F.col("_f") > NEAR)
    half = edge / 2
    behind = F.col("_f") - half * (F.abs("fx") + F.abs("fy") + F.abs("fz")) < 1e-6
    signs = F.array(*[F.array(*map(F.lit, s)) for s in product((-half, half), repeat=3)])

    def moved(n: str, s: Column) -> Column:
        return F.col(f"_{n}") + sum((F.col(f"{n}{a}") * s[i] for i, a in enumerate(AXES)), F.lit(0.0))

    def ends(n: str, size: int) -> Column:
        at = F.transform(signs, lambda s: F.col("focal") * moved(n, s) / F.greatest(moved("f", s), F.lit(1e-9)) + (size / 2 - 0.5))
        return F.sort_array(at)

    # a generator of one row: a condition on what it makes is not pushed below it, where all corners would be projected once more
    once = F.struct(behind.alias("behind"), ends("r", width).alias("x"), ends("d", height).alias("y"))
    seen = seen.withColumn("_p", F.explode(F.array(once)))
    bounds = {}
    for axis, size in (("x", width), ("y", height)):
        least, most = F.get(f"_p.{axis}", F.lit(0)), F.get(f"_p.{axis}", F.lit(7))
        low, high = F.greatest(F.floor(least), F.lit(0)), F.least(F.ceil(most) + 1, F.lit(size))
        bounds[f"{axis}0"] = F.when(F.col("_p.behind"), 0).otherwise(low).cast("int")
        bounds[f"{axis}1"] = F.when(F.col("_p.behind"), size).otherwise(high).cast("int")
        first, last = F.greatest(F.ceil(least - MARGIN), F.lit(0)), F.least(F.floor(most + MARGIN), F.lit(size - 1))
        bounds[f"in_{axis}"] = F.when(F.col("_p.behind"), F.struct(F.lit(0).alias("first"), F.lit(size - 1).alias("last"))).otherwise(
            F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))
        )
    placed = seen.withColumns(bounds).filter("x0 < x1 and y0 < y1")
    return placed.withColumn("depth", F.col("_f")).drop("_r", "_d", "_f", "_p")


def camera_hits(projected: DataFrame, view: str, item: str, edge: float, width: int, height: int) -> DataFrame:
    """(view, py, px, item, depth, distance): for every pixel the first cell by depth of its center that the ray through the pixel's middle meets.

    ``projected`` comes from ``project_cells``; a ray is tested against the cells whose projection's box holds the pixel's middle, as it can
    meet no other. ``distance`` is where
    the ray enters the cell, 0 from inside. Pixels without a hit have no row. Hits are combined before they are shuffled, so a view may hold any share
    of the cells.
    """
    inside = projected.filter("in_x.first <= in_x.last and in_y.first <= in_y.last")
    pixels = inside.withColumn("_v", F.explode(F.sequence("in_y.first", "in_y.last"))).withColumn("_u", F.explode(F.sequence("in_x.first", "in_x.last")))
    across, down = (F.col("_u") + (0.5 - width / 2)) / F.col("focal"), (F.col("_v") + (0.5 - height / 2)) / F.col("focal")
    ray = _unit([F.col(f"f{a}") + across * F.col(f"r{a}") + down * F.col(f"d{a}") for a in AXES])
    pixels = pixels.withColumns({f"_{a}": F.when(F.abs(c) < 1e-12, 1e-12).otherwise(c) for a, c in zip(AXES, ray)})
    near, far = ([(F.col(a) + s * edge / 2 - F.col(f"p{a}")) / F.col(f"_{a}") for a in AXES] for s in (-1, 1))
    enter = F.greatest(F.lit(0.0), *[F.least(a, b) for a, b in zip(near, far)])
    leave = F.least(*[F.greatest(a, b) for a, b in zip(near, far)])
    crossed = pixels.select(view, item, "depth", "_v", "_u", F.explode(F.array(F.struct(enter.alias("in"), leave.alias("out")))).alias("_p"))
    met = crossed.filter("_p.out > _p.in")
    first = met.groupBy(view, F.col("_v").alias("py"), F.col("_u").alias("px")).agg(F.min(F.struct("depth", item, F.col("_p.in").alias("distance"))).alias("_h"))
    return first.select(view, "py", "px", f"_h.{item}", "_h.depth", "_h.distance")
