"""Octrees of z-order codes as node tables, and the two delta codings of byte attributes.

A node is (batch, level, prefix): ``level`` 0 is the root, ``prefix`` the octal digits
above it. Nothing here needs a whole tree in one task: nodes come from one grouping,
siblings from windows of at most eight rows, order from range-partitioned slices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparcel.functions.quant import byte_diff
from sparcel.operators.ordered import group_position, largest_group

# fixed values: which existing neighbor serves as reference, later entries win
REFERENCE_ORDER = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1)]


def _padded(prefix: str, level: str, depth: int) -> Column:
    return F.expr(f"shiftleft({prefix}, 3 * ({depth} - {level}))")


def octree_nodes(leaves: DataFrame, depth: int, batch: str = "batch", code: str = "code") -> DataFrame:
    """Internal nodes with the bitmap of their children, for levels 0..depth-1."""
    level = F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level")
    placed = leaves.select(batch, code, level).select(
        batch,
        "level",
        F.expr(f"shiftright({code}, 3 * ({depth} - level))").alias("prefix"),
        F.expr(f"cast(shiftright({code}, 3 * ({depth} - level - 1)) & 7 as int)").alias("child"),
    )
    return placed.groupBy(batch, "level", "prefix").agg(F.bit_or(F.expr("shiftleft(1, child)")).alias("children"))


def node_stream(nodes: DataFrame, depth: int, batch: str = "batch", most: int | None = None) -> DataFrame:
    """Offset of every node in its batch's depth-first byte stream; ``most`` is a bound on a batch's nodes, if one is known."""
    keyed = nodes.withColumn("_first", _padded("prefix", "level", depth))
    return group_position(keyed, [batch], ["_first", "level"], "offset", most=most).drop("_first")


def node_leaves(nodes: DataFrame, depth: int, batch: str = "batch") -> DataFrame:
    """Leaf codes read back from the lowest node level."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.call_function("bit_get", F.col("children"), b) == 1)
    last = nodes.filter(F.col("level") == depth - 1)
    return last.select(batch, "prefix", F.explode(bits).alias("b")).select(
        batch, (F.col("prefix") * 8 + F.col("b")).alias("code")
    )


def parent_deltas(leaves: DataFrame, depth: int, value: str, batch: str = "batch", code: str = "code") -> DataFrame:
    """Byte values as differences along the octree, one slot per leaf.

    A node stands for its first leaf's value. The root keeps it in slot 0; every child
    but the first stores the difference to its previous sibling, slots following the
    depth-first order of the parents.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    valued = (
        leaves.select(batch, code, value, level)
        .withColumn("prefix", F.expr(f"shiftright({code}, 3 * ({depth} - level))"))
        .groupBy(batch, "level", "prefix")
        .agg(F.min_by(value, code).alias("value"))
    )
    family = Window.partitionBy(batch, "level", F.shiftright("prefix", 3)).orderBy("prefix")
    stored = valued.select(
        batch,
        "level",
        "prefix",
        F.when(F.col("level") == 0, F.col("value"))
        .otherwise(byte_diff(F.col("value"), F.lag("value").over(family)))
        .alias("delta"),
    ).filter(F.col("delta").isNotNull())
    keyed = stored.withColumn(
        "_parent", F.when(F.col("level") == 0, F.lit(-1)).otherwise(F.expr(f"shiftleft(shiftright(prefix, 3), 3 * ({depth} - level + 1))"))
    )
    # one slot per leaf
    return group_position(keyed, [batch], ["_parent", "level", "prefix"], "slot", most=largest_group(leaves, [batch])).drop("_parent")


def from_parent_deltas(nodes: DataFrame, deltas: DataFrame, depth: int, batch: str = "batch") -> DataFrame:
    """Leaf values from the node table and the stored differences, level by level from the root.

    A child joins its one parent, so no join key repeats more than eight times.
    """
    root = deltas.filter("level = 0").select(batch, "prefix", F.col("delta").alias("value"))
    values = root
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.call_function("bit_get", F.col("children"), b) == 1)
    family = Window.partitionBy(batch, "parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(1, depth + 1):
        children = (
            nodes.filter(F.col("level") == level - 1)
            .join(values.select(batch, "prefix", "value"), [batch, "prefix"])
            .select(batch, F.col("prefix").alias("parent"), "value", F.explode(bits).alias("b"))
            .withColumn("prefix", F.col("parent") * 8 + F.col("b"))
        )
        steps = deltas.filter(F.col("level") == level).select(batch, "prefix", "delta")
        values = children.join(steps, [batch, "prefix"], "left").select(
            batch,
            "prefix",
            F.pmod(F.col("value") + F.sum(F.coalesce("delta", F.lit(0))).over(family), F.lit(256)).cast("int").alias("value"),
        )
    return values.select(batch, F.col("prefix").alias("code"), "value")


def neighbor_deltas(cells: DataFrame, values: list[str], chunk: int) -> DataFrame:
    """Byte values minus those of the reference neighbor inside the same chunk, modulo 256.

    Every cell offers itself to the cells it could serve; one grouping by cell picks
    the offer of highest rank. No cell receives more than eight rows.
    """
    axes = ("x", "y", "z")
    offers = [((0, 0, 0), 0), *[(o, i + 1) for i, o in enumerate(REFERENCE_ORDER)]]
    sends = F.array(
        *[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip(axes, o)], F.lit(rank).alias("rank")) for o, rank in offers]
    )
    sent = cells.select("batch", *axes, *[F.col(v).alias(f"_v_{v}") for v in values], F.explode(sends).alias("o"))
    inside = None
    for a in axes:
        fits = (F.col(f"o.d{a}") == 0) | (F.pmod(a, F.lit(chunk)) < chunk - 1)
        inside = fits if inside is None else inside & fits
    offered = sent.filter(inside).select(
        "batch", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in axes], F.col("o.rank").alias("rank"), *[f"_v_{v}" for v in values]
    )
    # per value and not per struct: primitive buffers keep the hash aggregate
    met = offered.groupBy("batch", *axes).agg(
        F.min("rank").alias("_own"),
        F.max("rank").alias("reference"),
        *[F.max(F.when(F.col("rank") == 0, F.col(f"_v_{v}"))).alias(f"_own_{v}") for v in values],
        *[F.max_by(f"_v_{v}", F.when(F.col("rank") > 0, F.col("rank"))).alias(f"_ref_{v}") for v in values],
    )
    return met.filter("_own = 0").select(
        "batch", *axes, "reference",
        *[byte_diff(F.col(f"_own_{v}"), F.coalesce(F.col(f"_ref_{v}"), F.lit(0))).cast("int").alias(v) for v in values],
    )


def chain_sums(reference: np.ndarray, deltas: np.ndarray) -> np.ndarray:
    """Sums along reference chains (-1 ends one), halving the remaining chain each round."""
    total, ahead = deltas.astype(np.uint8).copy(), reference.copy()
    while (ahead >= 0).any():
        live = np.flatnonzero(ahead >= 0)
        total[live] += total[ahead[live]]
        ahead[live] = ahead[ahead[live]]
    return total


def reference_rows(local: np.ndarray, edge: int) -> np.ndarray:
    """Row of each cell's reference neighbor within one chunk, -1 if it has none."""
    key = (local[:, 0] * edge + local[:, 1]) * edge + local[:, 2]
    order = np.argsort(key)
    keys = key[order]
    found = np.full(len(key), -1, dtype=np.int64)
    for offset in REFERENCE_ORDER:
        at = local - np.array(offset)
        wanted = (at[:, 0] * edge + at[:, 1]) * edge + at[:, 2]
        spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = (at >= 0).all(axis=1) & (keys[spot] == wanted)
        found[hit] = order[spot[hit]]
    return found


def from_neighbor_deltas(deltas: DataFrame, values: list[str], chunk: int) -> DataFrame:
    """Undo :func:`neighbor_deltas`: a recurrence along chains, solved chunk by chunk.

    A chunk has at most ``chunk ** 3`` cells whatever the table holds, which bounds the
    group that one task sees.
    """
    axes = ["x", "y", "z"]

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        local = pdf[axes].to_numpy(np.int64) % chunk
        summed = chain_sums(reference_rows(local, chunk), pdf[values].to_numpy())
        return pdf[["batch", *axes]].assign(**{v: summed[:, i].astype(np.int32) for i, v in enumerate(values)})

    schema = "batch int, x int, y int, z int, " + ", ".join(f"{v} int" for v in values)
    box = [F.floor(F.col(a) / chunk).alias(f"_c{a}") for a in axes]
    grouped = deltas.select("batch", *axes, *values).groupBy("batch", *box)
    return grouped.applyInPandas(decode, schema)
