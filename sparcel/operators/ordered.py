"""Row numbers and running sums over a total order, without a single-task window.

A window without PARTITION BY, or one over a group that holds a large share of the
rows, runs in one task. Here the rows are range-partitioned by the whole order, each
slice numbers or sums its own rows as they come sorted, and only the edges of slices (at
most two rows per slice) are combined afterwards, on the driver whatever the data size.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparcel.session import stage

SLICE, SPOT = "_slice", "_spot"
_ROW_IN_PARTITION = (1 << 33) - 1


def sliced(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partition and sort by ``order``; tag each row with slice and 0-based spot.

    ``order`` must be total. The result is staged because range bounds are sampled:
    a second evaluation could cut elsewhere.
    """
    ranged = (
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn(SLICE, F.spark_partition_id())
        .withColumn(SPOT, F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_PARTITION)))
    )
    return stage(ranged, "sliced")


def _slice_sizes(parts: DataFrame) -> list[int]:
    """Rows per slice: one number per slice, whatever the table holds."""
    found = {r[SLICE]: r["count"] for r in parts.groupBy(SLICE).count().collect()}
    return [found.get(i, 0) for i in range(max(found, default=-1) + 1)]


def global_position(df: DataFrame, order: Sequence[str], name: str = "pos", total: str | None = None) -> DataFrame:
    """0-based position in the whole table (and optionally its row count)."""
    parts = sliced(df, order)
    before = [0, *accumulate(_slice_sizes(parts))]
    starts = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")  # folds to one literal
    numbered = parts.withColumn(name, F.get(starts, F.col(SLICE)) + F.col(SPOT))
    if total:
        numbered = numbered.withColumn(total, F.lit(before[-1]).cast("bigint"))
    return numbered.drop(SLICE, SPOT)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are alike, as are NaNs."""
    before, after = column[:-1], column[1:]
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        return np.array([x != y for x, y in zip(values, values[1:])], bool)
    differ = pc.fill_null(pc.not_equal(before, after), False)
    if pa.types.is_floating(column.type):
        both = pc.and_(pc.fill_null(pc.is_nan(before), False), pc.fill_null(pc.is_nan(after), False))
        differ = pc.and_(differ, pc.invert(both))
    lost = pc.xor(before.is_null(), after.is_null())
    return pc.or_(differ, lost).to_numpy(zero_copy_only=False)


def _sums_within(values: np.ndarray, starts: np.ndarray, carried: float) -> np.ndarray:
    """Running sums that begin anew at each start; the rows before the first start go on from ``carried``."""
    if values.dtype.kind == "f":  # differences of long sums would lose digits
        out = np.concatenate([np.cumsum(part) for part in np.split(values, starts)] or [values])
    else:
        out = np.cumsum(values)
        base = np.zeros(len(values), values.dtype)
        base[starts] = out[starts] - values[starts] - np.concatenate(([0], (out[starts] - values[starts])[:-1]))
        out = out - np.cumsum(base)
    out[: starts[0] if len(starts) else len(out)] += values.dtype.type(carried)
    return out


#: Up to so many rows a group is summed by the task that its key goes to.
WINDOW_ROWS = 1 << 20

_HEAD, _EDGE, _KEY = "_head", "_edge", "_key"


def _scanned(df: DataFrame, group: Sequence[str], order: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows in slices of the whole order, with the running sums of ``_in_*`` inside each slice and group.

    One exchange: each slice is sorted and then summed as a stream. ``_head`` marks the rows of a slice's first group, ``_edge`` its
    first (1) and last (2) row, or its only one (3).
    """
    kinds = {n: "double" if isinstance(df.schema[f"_in_{n}"].dataType, (T.FloatType, T.DoubleType)) else "bigint" for n in names}
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    places = [df.columns.index(g) for g in group]
    inputs = [(df.columns.index(f"_in_{n}"), np.float64 if kinds[n] == "double" else np.int64) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, last, carried, head, first = TaskContext.get().partitionId(), None, None, [0] * len(names), True, True

        def edged(batch: pa.RecordBatch, end: bool) -> pa.RecordBatch:
            edge = np.zeros(batch.num_rows, np.int8)
            edge[0] += first
            edge[-1] += 2 * end
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(edge)], names=[*batch.schema.names, _EDGE])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in places:
                column = batch.column(k)
                with_last = pa.concat_arrays([last.column(k), column]) if last is not None else column
                new[len(new) - len(with_last) + 1 :] |= _changes(with_last)
            starts = np.flatnonzero(new)
            heads = np.zeros(batch.num_rows, bool)
            heads[: starts[0] if len(starts) else len(heads)] = head
            head = head and not len(starts)
            sums = [_sums_within(batch.column(k).to_numpy(zero_copy_only=False).astype(kind), starts, c) for (k, kind), c in zip(inputs, carried)]
            carried, last = [s[-1] for s in sums], batch.slice(batch.num_rows - 1)
            columns = [*batch.columns, *map(pa.array, sums), pa.array(np.full(batch.num_rows, number, np.int32)), pa.array(heads)]
            if held is not None:
                yield edged(held, False)
                first = False
            held = pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names, SLICE, _HEAD])
        if held is not None:
            yield edged(held, True)

    extra = [*[T.StructField(n, T.DoubleType() if kinds[n] == "double" else T.LongType()) for n in names]]
    schema = T.StructType([*ranged.schema.fields, *extra, T.StructField(SLICE, T.IntegerType()), T.StructField(_HEAD, T.BooleanType()), T.StructField(_EDGE, T.ByteType())])
    return stage(ranged.mapInArrow(run, schema), "scanned")


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows of the largest group; rows are counted before they are shuffled."""
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    exclusive: bool = False,
    most: int | None = None,
) -> DataFrame:
    """Running sums of ``sums`` (whole numbers or doubles) inside each group, in ``order``.

    Works for groups of any size. While no group has more than ``WINDOW_ROWS`` rows, which one counting pass tells unless the caller
    knows a bound (``most``), a plain window takes one exchange and no Python. Larger groups span slices of the whole order: only a slice's first group can have begun before it, so
    two rows a slice, its first and its last, tell what every slice has to add.
    """
    names = list(sums)
    inputs = {f"_in_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}  # NULL adds nothing
    given = df.withColumns(inputs)
    if group and (largest_group(df, group) if most is None else most) <= WINDOW_ROWS:
        so_far = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        values = {n: F.sum(f"_in_{n}").over(so_far) - (F.col(f"_in_{n}") if exclusive else F.lit(0)) for n in names}
        return given.select(*[c for c in df.columns if c not in names], *[c.alias(n) for n, c in values.items()])
    clash = {*names, SLICE, _HEAD, _EDGE} & set(df.columns)
    given = given.drop(*clash) if clash else given
    parts = _scanned(given, group, [*group, *order], names)
    plain = [F.col(g) + 0.0 if isinstance(df.schema[g].dataType, (T.FloatType, T.DoubleType)) else F.col(g) for g in group]
    key = F.to_json(F.struct(*[c.alias(g) for c, g in zip(plain, group)])) if group else F.lit("")
    edges = parts.filter(f"{_EDGE} > 0").select(SLICE, _EDGE, _HEAD, key.alias(_KEY), *names).collect()
    firsts = {r[SLICE]: r[_KEY] for r in edges if r[_EDGE] & 1}
    lasts = {r[SLICE]: r for r in edges if r[_EDGE] & 2}
    carries: list[list] = [[0] * (max(firsts, default=-1) + 1) for _ in names]
    open_key, so_far = None, [0] * len(names)
    for number in sorted(firsts):
        so_far = so_far if firsts[number] == open_key else [0] * len(names)
        for k in range(len(names)):
            carries[k][number] = so_far[k]
        last = lasts[number]
        so_far = [last[n] + (c if last[_HEAD] else 0) for n, c in zip(names, so_far)]
        open_key = last[_KEY]
    joined = parts
    for n, values in zip(names, carries):
        kind = parts.schema[n].dataType.simpleString()
        carry = F.get(F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>"), F.col(SLICE))
        value = F.col(n) + F.when(F.col(_HEAD), carry).otherwise(F.lit(0))
        joined = joined.withColumn(n, value - F.col(f"_in_{n}") if exclusive else value)
    return joined.select(*[c for c in df.columns if c not in names], *names)


def group_position(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "pos", most: int | None = None) -> DataFrame:
    """0-based position inside each group; a hot group is numbered by many tasks. ``most``: see ``running``."""
    return running(df, group, order, {name: F.lit(1).cast("bigint")}, exclusive=True, most=most)


_COMBINE = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "min": F.least, "max": F.greatest}


def trailing(df: DataFrame, order: Sequence[str], width: int, aggs: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Aggregates over the last ``width`` rows of the whole order, the row itself included.

    ``aggs`` maps names to (sum | count | min | max, column). Positions are cut into
    blocks of ``width`` rows and each block also gets the rows of the block before.
    A window is then the tail of one block and the head of the next, both of which are
    running aggregates: the work per row does not depend on ``width``.
    """
    placed = global_position(df.withColumns({f"_in_{n}": c for n, (_, c) in aggs.items()}), order, "_pos")
    home = F.expr(f"_pos div {width}")
    copies = placed.withColumn("_home", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn(
        "_block", F.when(F.col("_home"), home).otherwise(home + 1)
    )
    head = Window.partitionBy("_block", "_home").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = Window.partitionBy("_block", "_home").orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {n: getattr(F, how)(f"_in_{n}") for n, (how, _) in aggs.items()}
    part = copies.withColumns({f"_head_{n}": a.over(head) for n, a in made.items()})
    part = part.withColumns({f"_tail_{n}": a.over(tail) for n, a in made.items()})
    both = Window.partitionBy("_block").orderBy("_pos")
    inner = F.pmod("_pos", F.lit(width)) < width - 1
    out = {}
    for n, (how, _) in aggs.items():
        before = F.when(inner, F.lag(f"_tail_{n}", width - 1).over(both)) if width > 1 else F.lit(None)
        own = F.col(f"_head_{n}")
        out[n] = F.coalesce(_COMBINE[how](own, before), own, before) if width > 1 else own
    return part.withColumns(out).filter("_home").select(*df.columns, *aggs.keys())
