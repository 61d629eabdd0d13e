"""Space-filling curve keys for 10-bit cell coordinates, as column expressions."""

from __future__ import annotations

from functools import cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
BITS = 10

# fixed values: masks that leave two empty bits after every coordinate bit
SPREAD_16 = 0x030000FF
SPREAD_8 = 0x0300F00F
SPREAD_4 = 0x030C30C3
SPREAD_2 = 0x09249249
LOW_10 = 0x000003FF


def _spread(v: Column) -> Column:
    v = v.cast("bigint")
    for shift, mask in ((16, SPREAD_16), (8, SPREAD_8), (4, SPREAD_4), (2, SPREAD_2)):
        v = (v * ((1 << shift) + 1)).bitwiseAND(F.lit(mask))
    return v


def _gather(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(SPREAD_2))
    for shift, mask in ((2, SPREAD_4), (4, SPREAD_8), (8, SPREAD_16), (16, LOW_10)):
        v = v.bitwiseXOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask))
    return v.cast("int")


def z_order(x: Column, y: Column, z: Column) -> Column:
    """30-bit z-order key, x most significant in each octal digit."""
    return _spread(x) * 4 + _spread(y) * 2 + _spread(z)


def from_z_order(code: Column) -> tuple[Column, Column, Column]:
    return _gather(F.shiftright(code, 2)), _gather(F.shiftright(code, 1)), _gather(code)


@cache
def _hilbert_machine() -> tuple[list[int], list[int]]:
    """Transition tables of the Hilbert curve, found by exploring its orientations.

    An orientation is a signed permutation of the axes plus the parity of the last
    Gray bits seen so far. For every orientation and octant: the curve digit and the
    next orientation, packed as ``next * 8 + digit``; and the inverse, ``next * 8 + octant``.
    """
    start = ((0, 1, 2), (0, 0, 0), 0)
    seen, todo, rows = {start: 0}, [start], []
    while todo:
        perm, flip, parity = todo.pop(0)
        row = []
        for octant in product((0, 1), repeat=3):
            bits = [octant[perm[a]] ^ flip[a] for a in range(3)]
            p, f = list(perm), list(flip)
            for a in range(3):
                if bits[a]:
                    f[0] ^= 1
                else:
                    p[0], p[a], f[0], f[a] = p[a], p[0], f[a], f[0]
            gray = [bits[0], bits[0] ^ bits[1], bits[0] ^ bits[1] ^ bits[2]]
            digit = sum((g ^ parity) << (2 - a) for a, g in enumerate(gray))
            after = (tuple(p), tuple(f), parity ^ gray[2])
            if after not in seen:
                seen[after] = len(seen)
                todo.append(after)
            row.append((digit, seen[after]))
        rows.append(row)
    encode, decode = [0] * (8 * len(rows)), [0] * (8 * len(rows))
    for state, row in enumerate(rows):
        for octant, (digit, after) in enumerate(row):
            encode[state * 8 + octant] = after * 8 + digit
            decode[state * 8 + digit] = after * 8 + octant
    return encode, decode


def _walk(df: DataFrame, table: list[int], source: Column, out: str) -> DataFrame:
    """Feed the octal digits of ``source``, highest first, through the machine.

    One projection per level keeps the generated code linear in the number of levels.
    """
    lookup = F.array(*[F.lit(v) for v in table])
    df = df.withColumns({"_src": source, "_state": F.lit(0), out: F.lit(0).cast("bigint")})
    for level in reversed(range(BITS)):
        digit = F.shiftright("_src", 3 * level).bitwiseAND(F.lit(7)).cast("int")
        df = df.withColumn("_step", F.get(lookup, F.col("_state").bitwiseAND(F.lit(-8)) + digit))
        df = df.withColumns(
            {"_state": F.col("_step"), out: F.col(out) * 8 + F.col("_step").bitwiseAND(F.lit(7))}
        )
    return df.drop("_src", "_state", "_step")


def with_hilbert(df: DataFrame, name: str = "hilbert") -> DataFrame:
    """Add the 30-bit Hilbert key of columns x, y, z."""
    encode, _ = _hilbert_machine()
    return _walk(df, encode, z_order(*[F.col(a) for a in AXES]), name)


def with_hilbert_position(df: DataFrame, code: str = "hilbert") -> DataFrame:
    """Add the x, y, z that a Hilbert key stands for."""
    _, decode = _hilbert_machine()
    df = _walk(df, decode, F.col(code), "_octants")
    return df.withColumns(dict(zip(AXES, from_z_order(F.col("_octants"))))).drop("_octants")


def permuted(code, order: tuple[int, int, int]):
    """A curve key with the axes taken in another order, e.g. (2, 1, 0) for z, y, x."""
    cols = [F.col(AXES[i]) for i in order]
    return code(*cols)


def cluster_by(df: DataFrame, code: str, partitions: int | None = None) -> DataFrame:
    """Range-partition and sort by a curve key, so files hold compact boxes and can be skipped by min/max."""
    args = [F.col(code)] if partitions is None else [partitions, F.col(code)]
    return df.repartitionByRange(*args).sortWithinPartitions(code)
