"""Sparse cell algebra: tables keyed by (batch, x, y, z)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparcel.operators.ordered import global_position, group_position, running

KEYS = ("batch", "x", "y", "z")
AXES = ("x", "y", "z")

# fixed values: the four cells around a cell's lower edge along each axis, in winding order
EDGE_RING = {
    "x": [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)],
    "y": [(0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)],
    "z": [(0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)],
}


def floor_div(c: Column, by: int) -> Column:
    """Floor division that is also right for negative coordinates."""
    return F.floor(c / by).cast("int")


def coarse(df: DataFrame, factor: int) -> DataFrame:
    return df.withColumns({a: floor_div(F.col(a), factor) for a in AXES})


def child_index(factor: int) -> Column:
    """Position of a cell inside its coarse cell, x least significant."""
    return reduce(lambda a, b: a + b, [F.pmod(a, F.lit(factor)) * factor**i for i, a in enumerate(AXES)])


def pool(df: DataFrame, factor: int, aggs: Mapping[str, Column], occupancy: bool = False) -> DataFrame:
    """Group cells by ``coordinate // factor``. With ``occupancy`` also the bitmap of present children."""
    marked = df.withColumn("_child", child_index(factor)) if occupancy else df
    out = [c.alias(n) for n, c in aggs.items()]
    if occupancy:
        out.append(F.bit_or(F.expr("shiftleft(1, _child)")).alias("occupancy"))
    return coarse(marked, factor).groupBy(*KEYS).agg(*out)


def pool_vectors(df: DataFrame, keys: Sequence[str], vector: str, dim: int, how=F.avg) -> DataFrame:
    """Pool an array column per key, channel by channel: no explode, partial aggregation on the map side."""
    channels = [how(F.get(vector, F.lit(i)).cast("double")) for i in range(dim)]
    return df.groupBy(*keys).agg(F.array(*channels).alias(vector))


def expand(df: DataFrame, factor: int, occupancy: str = "occupancy") -> DataFrame:
    """One child row per set bit of the occupancy bitmap: the inverse of pooling's cell map."""
    bits = F.filter(
        F.sequence(F.lit(0), F.lit(factor**3 - 1)),
        lambda b: F.call_function("bit_get", F.col(occupancy), b) == 1,
    )
    child = df.withColumn("child", F.explode(bits))
    return child.withColumns(
        {a: F.col(a) * factor + F.pmod(F.floor(F.col("child") / factor**i), F.lit(factor)).cast("int") for i, a in enumerate(AXES)}
    )


def space_to_channel(df: DataFrame, factor: int, values: Sequence[str]) -> DataFrame:
    """One row per coarse cell with every child's values side by side, 0 for absent children."""
    kids = df.withColumn("_child", child_index(factor))
    slots = [
        F.coalesce(F.max(F.when(F.col("_child") == k, F.col(v))), F.lit(0).cast(df.schema[v].dataType))
        for k in range(factor**3)
        for v in values
    ]
    bits = F.bit_or(F.expr("shiftleft(1, _child)")).alias("occupancy")
    return coarse(kids, factor).groupBy(*KEYS).agg(F.array(*slots).alias("channels"), bits)


def channel_to_space(df: DataFrame, factor: int, width: int) -> DataFrame:
    """Inverse of :func:`space_to_channel`: the channels of each present child, as an array."""
    wide = expand(df, factor)
    return wide.withColumn("values", F.slice("channels", F.col("child") * width + 1, width)).drop(
        "channels", "occupancy", "child"
    )


def flat_index(sizes: Mapping[str, int]) -> Column:
    """Mixed-radix index of (batch, x, y, z) for the given axis sizes, z fastest."""
    index = F.col("batch").cast("bigint")
    for a in AXES:
        index = index * sizes[a] + F.col(a)
    return index


def from_flat_index(code: Column, sizes: Mapping[str, int]) -> dict[str, Column]:
    """The inverse, by integer arithmetic: exact for every 64-bit code."""
    rest, out = code, {}
    for a in reversed(AXES):
        out[a] = F.pmod(rest, F.lit(sizes[a])).cast("int")
        rest = F.call_function("div", rest, F.lit(sizes[a]))
    return {"batch": rest.cast("int"), **{a: out[a] for a in AXES}}


def dense_ids(df: DataFrame, keys: Sequence[str], name: str = "id") -> DataFrame:
    """Distinct keys with their rank in key order (0-based)."""
    return global_position(df.select(*keys).distinct(), keys, name)


def lookup(cells: DataFrame, probes: DataFrame, value: str, on: Sequence[str] = KEYS) -> DataFrame:
    """Coordinate lookup: a probe outside the grid or without a cell gets NULL."""
    return probes.join(cells.select(*on, value), list(on), "left")


def neighbors(cells: DataFrame, offsets: Sequence[tuple[int, int, int]], value: str) -> DataFrame:
    """Every (cell, offset) pair whose neighbor exists, with the neighbor's value.

    The value side is shifted to the cells that would look at it, so a plain equi join
    on the cell key finds all pairs.
    """
    shifts = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip(AXES, o)]) for o in offsets])
    seen = (
        cells.select(*KEYS, F.col(value).alias("neighbor"), F.explode(shifts).alias("_o"))
        .select("batch", *[(F.col(a) - F.col(f"_o.d{a}")).alias(a) for a in AXES], "_o.*", "neighbor")
    )
    return cells.join(seen, list(KEYS))


def edge_quads(cells: DataFrame, flags: Mapping[str, str], payload: Sequence[str]) -> DataFrame:
    """Quads of four cells around every flagged cell edge; only complete quads are kept.

    A cell owns the edges at its origin. A flagged edge asks for its three other cells, so rows follow the number of flagged edges, not
    that of cells; one join brings the payloads and one grouping by edge puts the ring together.
    """
    asks = F.array(
        *[
            F.struct(
                F.lit(axis).alias("axis"),
                F.lit(slot).alias("slot"),
                *[(F.col(a) + o).alias(a) for a, o in zip(AXES, offset)],
                F.coalesce(F.col(flags[axis]), F.lit(False)).alias("asked"),
            )
            for axis, ring in EDGE_RING.items()
            for slot, offset in enumerate(ring)
            if slot
        ]
    )
    asked = cells.select("batch", *[F.col(a).alias(f"_{a}") for a in AXES], *[F.col(p).alias(f"_0_{p}") for p in payload], F.explode(F.filter(asks, lambda s: s["asked"])).alias("s"))
    asked = asked.select("batch", *[f"_{a}" for a in AXES], *[f"_0_{p}" for p in payload], "s.axis", "s.slot", *[f"s.{a}" for a in AXES])
    met = asked.join(cells.select(*KEYS, *[F.col(p).alias(f"_p_{p}") for p in payload]), list(KEYS))
    # one aggregate per field, not per struct: primitive buffers keep the hash aggregate
    fields = [F.max(F.when(F.col("slot") == k, F.col(f"_p_{p}"))).alias(f"_{k}_{p}") for k in range(1, 4) for p in payload]
    own = [F.max(f"_0_{p}").alias(f"_0_{p}") for p in payload]
    whole = met.groupBy("batch", "axis", *[f"_{a}" for a in AXES]).agg(F.count(F.lit(1)).alias("_n"), *own, *fields).filter("_n = 3")
    corners = [F.struct(*[F.col(f"_{k}_{p}").alias(p) for p in payload]).alias(f"c{k}") for k in range(4)]
    return whole.select("batch", "axis", *[F.col(f"_{a}").alias(a) for a in AXES], *corners)


def trilinear(points: DataFrame, cells: DataFrame, values: Sequence[str], point_id: Sequence[str]) -> DataFrame:
    """Sample cell values at points given in cell units (cell centers at +0.5).

    Every point meets its eight surrounding cell centers; absent cells take no part
    and the remaining weights are renormalised. A point without any cell gets NULL.
    """
    base = {f"_b{a}": F.floor(F.col(f"p{a}") - 0.5).cast("int") for a in AXES}
    placed = points.withColumns(base).withColumns({f"_f{a}": F.col(f"p{a}") - 0.5 - F.col(f"_b{a}") for a in AXES})
    corner = F.array(
        *[
            F.struct(
                *[(F.col(f"_b{a}") + o).alias(a) for a, o in zip(AXES, offs)],
                reduce(
                    lambda a, b: a * b,
                    [F.col(f"_f{a}") if o else 1 - F.col(f"_f{a}") for a, o in zip(AXES, offs)],
                ).alias("w"),
            )
            for offs in [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
        ]
    )
    probes = placed.select(*point_id, "batch", F.explode(corner).alias("c")).select(*point_id, "batch", "c.*")
    met = lookup(cells.withColumn("_v", F.struct(*values)), probes, "_v")
    present = F.col("_v").isNotNull()
    weight = F.sum(F.when(present, F.col("w")))
    return met.groupBy(*point_id).agg(
        *[F.try_divide(F.sum(F.col("w") * F.col(f"_v.{v}")), weight).alias(v) for v in values],
        F.count_if(present).alias("corners"),
    )


def window_partition(df: DataFrame, window: int, shift: int, sizes: Mapping[str, int]) -> DataFrame:
    """Shifted window id of every cell: batch-major, z fastest, as many windows per axis as the shifted extent needs."""
    counts = {a: -(-(sizes[a] + shift + 1) // window) for a in AXES}
    index = F.col("batch").cast("bigint")
    for a in AXES:
        index = index * counts[a] + floor_div(F.col(a) + shift, window)
    return df.withColumn("window", index)


def batch_layout(df: DataFrame, batch: str = "batch") -> DataFrame:
    """Ragged layout: length, start and stop of every batch, batches in order."""
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("len"))
    laid = running(sizes, [], [batch], {"start": F.col("len")}, exclusive=True)
    return laid.withColumn("stop", F.col("start") + F.col("len"))


def batch_lengths(df: DataFrame, ids: DataFrame, batch: str = "batch") -> DataFrame:
    """Rows per batch for every listed batch id, 0 for an empty one."""
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("len"))
    return ids.select(batch).join(sizes, batch, "left").fillna(0, subset=["len"])


def to_padded(df: DataFrame, batch: str, order: Sequence[str], value: str, length: int | None = None) -> DataFrame:
    """Ragged to padded: every batch gets positions 0..length-1, absent ones masked.

    Without ``length`` the longest batch decides; a batch longer than a given one is an
    error, as its rows would be lost. Padding rows are generated per batch and added to the
    real rows, so nothing is joined.
    """
    placed = group_position(df.select(batch, *[c for c in order if c != batch], value), [batch], order, "pos")
    real = placed.select(batch, F.col("pos").cast("int").alias("pos"), value, F.lit(True).alias("mask"))
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    longest = sizes.agg(F.max("_n")).first()[0] or 0
    length = longest if length is None else length
    if longest > length:
        raise ValueError(f"a batch has {longest} rows, more than {length}")
    gap = (
        sizes.filter(F.col("_n") < length)
        .select(batch, F.explode(F.sequence(F.col("_n"), F.lit(length - 1))).alias("pos"))
        .withColumn("mask", F.lit(False))
    )
    return real.unionByName(gap, allowMissingColumns=True)


def grid(spark, lower: Sequence[int], upper: Sequence[int], batches: DataFrame) -> DataFrame:
    """Every cell of an inclusive box, for each batch id of ``batches``."""
    out = batches.select("batch")
    for a, lo, hi in zip(AXES, lower, upper):
        out = out.withColumn(a, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return out


def densify(cells: DataFrame, box: DataFrame, values: Sequence[str]) -> DataFrame:
    """Sparse to dense: every cell of the box, 0 where nothing is stored.

    Both sides are sorted: the box is estimated by the batch ids that it grows from, and would be broadcast whole.
    """
    filled = box.hint("merge").join(cells.select(*KEYS, *values), list(KEYS), "left")
    return filled.fillna(0, subset=list(values))


def sparsify(dense: DataFrame, test: Column) -> DataFrame:
    """Dense to sparse: the coordinates where ``test`` holds."""
    return dense.filter(test)


def concat_batches(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack cell tables, shifting batch ids so that each table's follow the previous one's.

    The shifts are one row per table: the number of batches in the tables before it.
    """
    tagged = [t.withColumn("_part", F.lit(i)) for i, t in enumerate(tables)]
    stacked = reduce(lambda a, b: a.unionByName(b), tagged)
    sizes = stacked.groupBy("_part").agg((F.max("batch") + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("int").alias("_shift"))
    return (
        stacked.join(F.broadcast(shift), "_part")
        .withColumn("batch", F.col("batch") + F.col("_shift"))
        .drop("_part", "_shift")
    )


def concat_features(left: DataFrame, right: DataFrame, name: str = "feats") -> DataFrame:
    """Join two feature tables on their cells and put the channels side by side."""
    both = left.alias("l").join(right.alias("r"), list(KEYS))
    return both.select(*KEYS, F.concat(F.col(f"l.{name}"), F.col(f"r.{name}")).alias(name))


def pick_batches(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Select and renumber batches by (new, old) pairs; an old batch may be picked repeatedly."""
    return df.join(wanted.select("new", F.col("old").alias("batch")), "batch").withColumn(
        "batch", F.col("new")
    ).drop("new")


def aligned(left: DataFrame, right: DataFrame, values: Sequence[str]) -> DataFrame:
    """Positional join of two tables over the same cells; unmatched cells are kept and marked."""
    r = right.select(*KEYS, *values, F.lit(True).alias("_r"))
    joined = left.withColumn("_l", F.lit(True)).join(r, list(KEYS), "full_outer")
    return joined.withColumn("aligned", F.col("_l").isNotNull() & F.col("_r").isNotNull()).drop("_l", "_r")
