"""Textures as texel tables: pyramids, sampling, materials, and surface attributes of cells.

A texel row is (tex, level, tx, ty, r, g, b) with bytes; ``level`` 0 is the image
itself, row 0 its top. A sample point needs at most eight texels, so sampling is one
equi join and one grouping.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.operators.mesh import AXES, dot, minus, with_normal
from sparcel.operators.voxelize import hit_cells, scan_hits
from sparcel.session import stage

CHANNELS = ("r", "g", "b")

# fixed values: names used by mesh dumps for filters, wraps and the appended default material
FILTERS = {"Closest": "NEAREST", "Linear": "LINEAR", "Cubic": "LINEAR", "Smart": "LINEAR"}
WRAPS = {"REPEAT": "REPEAT", "EXTEND": "CLAMP", "CLIP": "CLAMP", "MIRROR": "MIRROR"}
DEFAULT_MATERIAL = {
    "base_color": [0.8, 0.8, 0.8],
    "metallic": 0.0,
    "roughness": 0.5,
    "alpha": 1.0,
    "alpha_mode": "OPAQUE",
    "alpha_cutoff": 0.5,
}


def rename_values(c: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in names.items() for v in pair])[c]


def fixed_alpha_mode(mode: Column, alpha_texture: Column) -> Column:
    """An opaque material that has an alpha texture blends after all."""
    return F.when(alpha_texture.isNotNull() & (mode == "OPAQUE"), "BLEND").otherwise(mode)


def with_material(faces: DataFrame, materials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Faces with their material; a face without one (-1 or unknown) gets the default."""
    joined = faces.join(materials, list(keys), "left")
    for name, value in DEFAULT_MATERIAL.items():
        if name in materials.columns:
            fallback = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
            joined = joined.withColumn(name, F.coalesce(F.col(name), fallback))
    return joined


def effective_alpha(mode: Column, alpha: Column, cutoff: Column) -> Column:
    return F.when(mode == "OPAQUE", 1.0).when(mode == "MASK", F.when(alpha < cutoff, 0.0).otherwise(1.0)).otherwise(alpha)


def wrapped(i: Column, size: Column, mode: Column) -> Column:
    """Texel index brought into 0..size-1 by repeating, clamping or mirroring."""
    mirrored = F.pmod(i, size * 2)
    return (
        F.when(mode == "CLAMP", F.greatest(F.least(i, size - 1), F.lit(0)))
        .when(mode == "MIRROR", F.when(mirrored < size, mirrored).otherwise(size * 2 - mirrored - 1))
        .otherwise(F.pmod(i, size))
        .cast("int")
    )


def pyramid(texels: DataFrame, size: int) -> DataFrame:
    """All levels of square power-of-two textures; each level averages 2x2 of the one below, dropping fractions.

    Every level is written, as the next one and every sample read it again.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("texture size must be a power of two")
    levels = [texels.withColumn("level", F.lit(0))]
    for level in range(1, int(math.log2(size)) + 1):
        below = levels[-1]
        made = (
            below.groupBy("tex", F.expr("tx div 2").cast("int").alias("tx"), F.expr("ty div 2").cast("int").alias("ty"))
            .agg(*[F.expr(f"cast(sum({c}) div 4 as int)").alias(c) for c in CHANNELS])
            .withColumn("level", F.lit(level))
        )
        levels.append(stage(made, "mip-level"))
    return reduce(lambda a, b: a.unionByName(b), levels)


def _taps(u: str, v: str) -> Column:
    """Texels and weights of one (level, share) of a sample, size being the level's edge."""
    x, y = F.col(u) * F.col("size"), (1 - F.col(v)) * F.col("size")
    x0, y0 = F.floor(x - 0.5), F.floor(y - 0.5)
    wx, wy = x - x0 - 0.5, y - y0 - 0.5

    def tap(i, j, w):
        return F.struct(
            wrapped(i, F.col("size"), F.col("wrap")).alias("tx"),
            wrapped(j, F.col("size"), F.col("wrap")).alias("ty"),
            w.cast("double").alias("w"),
        )

    linear = F.array(
        tap(x0, y0, (1 - wx) * (1 - wy)),
        tap(x0 + 1, y0, wx * (1 - wy)),
        tap(x0, y0 + 1, (1 - wx) * wy),
        tap(x0 + 1, y0 + 1, wx * wy),
    )
    return F.when(F.col("filter") == "NEAREST", F.array(tap(F.floor(x), F.floor(y), F.lit(1.0)))).otherwise(linear)


def mip_level(length: Column, size: Column, offset: float = 0.0) -> Column:
    """Level at which a texel spans ``length`` of the texture."""
    return F.log2(length * size) + offset


def sample(points: DataFrame, texels: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Sampled channels in 0..1 for points (tex, u, v, filter, wrap, size, mip).

    ``mip`` NULL, non-finite or not above zero reads the image itself; in between two
    levels are blended; nearest sampling never leaves the image. Coarse levels have
    few texels for many points, so their texels are replicated and the points spread
    over the copies, four times more per level up to the third; beyond that, and for popular texels of
    the image itself, the points' side of the join is the one that adaptive execution splits. A point
    with an absent texel keeps its row, with NULL channels.
    Columns named in ``carry`` depend on the keys and come along through the grouping.
    """
    top = F.log2(F.col("size").cast("double")).cast("int")
    flat = (
        F.col("mip").isNull() | F.isnan("mip") | (F.col("mip") <= 0) | (F.abs("mip") == float("inf"))
        | (F.col("filter") == "NEAREST") | (top == 0)
    )
    low = F.floor("mip").cast("int")

    def share(level, weight):
        return F.struct(level.cast("int").alias("level"), weight.cast("double").alias("share"))

    shares = (
        F.when(flat, F.array(share(F.lit(0), F.lit(1.0))))
        .when(F.col("mip") >= top, F.array(share(top, F.lit(1.0))))
        .otherwise(F.array(share(low, 1 - (F.col("mip") - low)), share(low + 1, F.col("mip") - low)))
    )
    levelled = points.withColumn("_s", F.explode(shares)).withColumns(
        {"level": F.col("_s.level"), "size": F.expr("shiftright(size, _s.level)"), "_share": F.col("_s.share")}
    )
    copies = F.expr("shiftleft(1, 2 * least(level, 3))")
    taps = levelled.withColumn("_t", F.explode(_taps("u", "v"))).select(
        *keys, *carry, "tex", "level", "_t.tx", "_t.ty", (F.col("_t.w") * F.col("_share")).alias("_w"),
        F.pmod(F.xxhash64(*keys), copies).cast("int").alias("_copy"),
    )
    spread = texels.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    met = taps.join(spread, ["tex", "level", "tx", "ty", "_copy"], "left")
    read = [F.when(F.count(c) == F.count(F.lit(1)), F.sum(F.col("_w") * F.col(c)) / 255).alias(c) for c in CHANNELS]
    return met.groupBy(*keys).agg(*read, *[F.first(c).alias(c) for c in carry])


def tangent_frame(triangles: DataFrame) -> DataFrame:
    """Tangent tan*, bitangent bit* and texture scale of triangles with corner texture coordinates.

    Texture coordinates without area give fixed axes and a scale so large that the
    full image is read. Expects the unit normal nx, ny, nz.
    """
    edges = {f"_e{k}{ax}": F.col(f"{c}{ax}") - F.col(f"a{ax}") for k, c in ((1, "b"), (2, "c")) for ax in AXES}
    shifts = {f"_d{t}{k}": F.col(f"{c}{t}") - F.col(f"a{t}") for k, c in ((1, "b"), (2, "c")) for t in "uv"}
    out = triangles.withColumns({**edges, **shifts})
    du1, dv1, du2, dv2 = (F.col(f"_d{n}") for n in ("u1", "v1", "u2", "v2"))
    raw = {f"_t{ax}": dv2 * F.col(f"_e1{ax}") - dv1 * F.col(f"_e2{ax}") for ax in AXES}
    raw |= {f"_s{ax}": du1 * F.col(f"_e2{ax}") - du2 * F.col(f"_e1{ax}") for ax in AXES}
    out = out.withColumns({**raw, "_det": du1 * dv2 - dv1 * du2})
    out = out.withColumns({f"_l{k}": F.sqrt(dot(*[[F.col(f"_{k}{ax}") for ax in AXES]] * 2)) for k in "ts"})
    flat = F.abs("_det") < 1e-6
    frame = {}
    for name, k, fixed in (("tan", "t", (1.0, 0.0, 0.0)), ("bit", "s", (0.0, 1.0, 0.0))):
        frame |= {f"{name}{ax}": F.when(flat, fx).otherwise(F.try_divide(F.col(f"_{k}{ax}"), F.col(f"_l{k}"))) for ax, fx in zip(AXES, fixed)}
    frame["uv_scale"] = F.when(flat, 1e6).otherwise(F.sqrt(F.col("_lt") * F.col("_ls")) / F.abs("_det"))
    return out.withColumns(frame).drop(*edges, *shifts, *raw, "_det", "_lt", "_ls")


def with_barycentric(df: DataFrame, point: Sequence[Column]) -> DataFrame:
    """Barycentric coordinates wa, wb, wc of a point dropped onto the triangle's plane, and its signed distance.

    Built up column by column, which keeps the generated code short.
    """
    a, b, c = [[F.col(f"{k}{ax}") for ax in AXES] for k in "abc"]
    n = [F.col(f"n{ax}") for ax in AXES]
    df = df.withColumns({f"_p{ax}": p for ax, p in zip(AXES, point)})
    df = df.withColumn("dist", dot(minus([F.col(f"_p{ax}") for ax in AXES], a), n))
    legs = {f"_b{ax}": y - x for ax, x, y in zip(AXES, a, b)} | {f"_c{ax}": y - x for ax, x, y in zip(AXES, a, c)}
    legs |= {f"_q{ax}": F.col(f"_p{ax}") - F.col("dist") * m - x for ax, m, x in zip(AXES, n, a)}
    df = df.withColumns(legs)
    leg = {k: [F.col(f"_{k}{ax}") for ax in AXES] for k in "bcq"}
    products = {f"_{i}{j}": dot(leg[i], leg[j]) for i, j in ("bb", "bc", "cc", "qb", "qc")}
    df = df.withColumns(products)
    bb, bc, cc, qb, qc = (F.col(k) for k in products)
    df = df.withColumn("_area", bb * cc - bc * bc)
    df = df.withColumns({"wb": F.try_divide(cc * qb - bc * qc, F.col("_area")), "wc": F.try_divide(bb * qc - bc * qb, F.col("_area"))})
    return df.withColumn("wa", 1 - F.col("wb") - F.col("wc")).drop(*legs, *products, "_area", *[f"_p{ax}" for ax in AXES])


def surface_points(triangles: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """One row per (triangle, touched cell): texture coordinates, normal and weight at the cell center.

    The weight is one minus the signed distance to the plane. Expects corner positions
    and texture coordinates; corner normals (anx..cnz) fall back to the face normal.
    """
    framed = tangent_frame(with_normal(triangles)).filter("area2 > 0")
    given = [f"{k}n{ax}" for k in "abc" for ax in AXES]
    framed = stage(framed.withColumns({c: F.col(c[1:]) for c in given if c not in framed.columns}), "triangles")
    # distinct (triangle, cell) pairs first, on narrow rows; the corners are joined to them afterwards
    touched = hit_cells(scan_hits(framed, list(keys), n), list(keys)).select(*keys, *AXES).distinct()
    touched = touched.join(framed.hint("merge"), list(keys))  # a table of all triangles is not sent to the driver
    placed = with_barycentric(touched, [(F.col(ax) + 0.5) / n for ax in AXES])
    mixed = {"u": "u", "v": "v", "inx": "nx", "iny": "ny", "inz": "nz"}
    values = {
        out: F.col("wa") * F.col(f"a{src}") + F.col("wb") * F.col(f"b{src}") + F.col("wc") * F.col(f"c{src}")
        for out, src in mixed.items()
    }
    return placed.select(
        *keys, "material", *AXES, (1 - F.col("dist")).alias("weight"), (F.lit(1.0 / n) / F.col("uv_scale")).alias("mip_length"),
        *[c.alias(k) for k, c in values.items()], *[f"{f}{ax}" for f in ("tan", "bit") for ax in AXES],
    )


def cell_attributes(
    points: DataFrame, looks: DataFrame, texels: DataFrame, keys: Sequence[str], batch: str, mip_offset: float = 0.0
) -> DataFrame:
    """Weighted mean attributes per cell, one row per (cell, attribute) with r, g, b.

    ``looks`` is the long material table (material, attr, tex, size, filter, wrap,
    fr, fg, fb, mode, cutoff). An attribute without texture is its factor; masked
    alpha is cut per sample; a normal texture is turned into the surface frame.

    A point reads each texture once, however many of its attributes use it, and on narrow rows: what it reads comes back to
    the point as a list with one entry a texture, and the attributes multiply the rows only after the last join.
    """
    at, spot = [*keys, *AXES], F.struct("tex", "filter", "wrap", "size")
    textured = F.coalesce(F.col("tex").isNotNull() & ~((F.col("attr") == "alpha") & (F.col("mode") == "OPAQUE")), F.lit(True))
    spots = looks.filter(textured).select("material", "tex", "filter", "wrap", "size").distinct()
    placed = points.select(*at, "material", "u", "v", "mip_length").join(spots, "material")
    placed = placed.withColumns({"mip": mip_level(F.col("mip_length"), F.col("size"), mip_offset), "_spot": spot}).drop("material", "mip_length")
    seen = sample(placed, texels, [*at, "_spot"]).groupBy(*at).agg(F.collect_list(F.struct("_spot", *CHANNELS)).alias("_seen"))
    asked = points.drop("u", "v", "mip_length").join(seen, at, "left").join(looks, "material").withColumns({"textured": textured, "_spot": spot})
    own = F.get(F.filter("_seen", lambda s: s["_spot"].eqNullSafe(F.col("_spot"))), F.lit(0))
    read = asked.withColumn("_own", F.when(F.col("textured"), own))
    read = read.withColumns({c: F.when(F.col("textured"), F.col(f"_own.{c}")).otherwise(F.lit(1.0)) for c in CHANNELS})
    raw = {c: F.col(c) * F.col(f"f{c}") for c in CHANNELS}
    alpha = effective_alpha(F.col("mode"), raw["r"], F.col("cutoff"))
    m = [F.col(c) * 2 - 1 for c in CHANNELS]
    turned = [m[0] * F.col(f"tan{ax}") + m[1] * F.col(f"bit{ax}") + m[2] * F.col(f"in{ax}") for ax in AXES]
    length = F.sqrt(dot(turned, turned))
    value = {}
    for i, (c, ax) in enumerate(zip(CHANNELS, AXES)):
        normal = F.when(F.col("textured"), F.try_divide(turned[i], length)).otherwise(F.col(f"in{ax}"))
        value[c] = F.when(F.col("attr") == "normal", normal).when(F.col("attr") == "alpha", alpha).otherwise(raw[c])
    weighed = read.select(batch, *AXES, "attr", "weight", *[v.alias(c) for c, v in value.items()])
    total = F.sum("weight")
    return weighed.groupBy(batch, *AXES, "attr").agg(
        *[F.try_divide(F.sum(F.col(c) * F.col("weight")), total).alias(c) for c in CHANNELS]
    )


def attribute_bytes(c: Column, attr: Column) -> Column:
    """Attributes as bytes: normals mapped from [-1, 1], all clamped, fractions dropped."""
    scaled = F.when(attr == "normal", c * 0.5 + 0.5).otherwise(c) * 255
    return F.floor(F.greatest(F.least(scaled, F.lit(255.0)), F.lit(0.0))).cast("int")
