"""Meshes to sparse dual grids: scan-line hits, overlap and segment joins, error quadrics.

Triangles live in the unit box [0, 1]^3 as corner columns ax..cz (see
:func:`sparcel.operators.mesh.gather`) and the grid has ``n`` cells per axis. Hits,
overlaps and crossings are explodes of index sequences; all contributions of a cell
meet in one grouping by cell key, and only the small constrained solve runs in Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.operators.mesh import with_normal
from sparcel.session import spread, stage

AXES = ("x", "y", "z")
QUADRIC = [f"q{i}{j}" for i in range(4) for j in range(i, 4)]


def _cell(value: str, n: int) -> str:
    return f"cast({value} * {n} as int)"


def _clamped(value: str, n: int) -> str:
    return f"greatest(least({_cell(value, n)}, {n - 1}), 0)"


def _mix(name: str, p: str, q: str) -> str:
    """Value ``name`` on the segment p-q at height y."""
    alpha = f"((y - {p}.y) / ({q}.y - {p}.y))"
    return f"if({p}.y = {q}.y, {p}.{name}, (1 - {alpha}) * {p}.{name} + {alpha} * {q}.{name})"


def scan_hits(triangles: DataFrame, keep: Sequence[str], n: int) -> DataFrame:
    """Points where grid lines of each direction cross a triangle.

    One row per hit: the line direction ``axis`` (0, 1, 2), the cell (i, j, k) below
    the hit in x, y, z and the point (hx, hy, hz).
    """
    views = []
    for axis in range(3):
        u, v, w = AXES[(axis + 1) % 3], AXES[(axis + 2) % 3], AXES[axis]
        points = ", ".join(f"named_struct('y', {c}{v}, 'x', {c}{u}, 'z', {c}{w})" for c in "abc")
        views.append(f"named_struct('axis', {axis}, 't', array_sort(array({points})))")
    t = spread(triangles).select(*keep, F.expr(f"explode(array({', '.join(views)})) as view"))
    t = t.selectExpr(*keep, "view.axis as axis", "view.t[0] as t0", "view.t[1] as t1", "view.t[2] as t2")
    t = t.withColumns({f"r{i}": F.expr(_clamped(f"t{i}.y", n)) for i in range(3)})
    rows = t.filter("r0 < r2").withColumn("row", F.expr("explode(sequence(r0, r2 - 1))"))
    # lower half hangs from the lowest corner, upper half from the highest
    rows = rows.selectExpr(
        *keep, "axis", "row", f"(row + 1) / {float(n)}D as y",
        "if(row < r1, t0, t2) as p", "t1 as q", "if(row < r1, t2, t0) as r",
    )
    rows = rows.selectExpr(
        *keep, "axis", "row", "y",
        f"array_sort(array(named_struct('x', {_mix('x', 'p', 'q')}, 'z', {_mix('z', 'p', 'q')}), "
        f"named_struct('x', {_mix('x', 'p', 'r')}, 'z', {_mix('z', 'p', 'r')}))) as ends",
    )
    rows = rows.selectExpr(*keep, "axis", "row", "y", "ends[0] as l", "ends[1] as r")
    rows = rows.withColumns({"c0": F.expr(_clamped("l.x", n)), "c1": F.expr(_clamped("r.x", n))})
    hits = rows.filter("c0 < c1").withColumn("col", F.expr("explode(sequence(c0, c1 - 1))"))
    hits = hits.selectExpr(
        *keep, "axis", "row", "col", "y", f"(col + 1) / {float(n)}D as x",
        "l", "r",
    )
    alpha = "((x - l.x) / (r.x - l.x))"
    hits = hits.withColumn("z", F.expr(f"if(l.x = r.x, l.z, (1 - {alpha}) * l.z + {alpha} * r.z)"))
    hits = hits.withColumn("depth", F.expr(_cell("z", n))).filter(f"depth >= 0 and depth < {n}")

    def by_axis(u: str, v: str, w: str, real: int) -> str:
        """The column that plays real axis ``real`` when (u, v, w) are the roles along, across, deep."""
        roles = {0: w, 1: v, 2: u}  # axis == real: deep; axis == real + 1: across; else along
        return f"case axis when {real} then {roles[0]} when {(real + 1) % 3} then {roles[1]} else {roles[2]} end"

    cells = [f"{by_axis('col', 'row', 'depth', a)} as {k}" for a, k in enumerate("ijk")]
    at = [f"{by_axis('x', 'y', 'z', a)} as h{ax}" for a, ax in enumerate(AXES)]
    return hits.selectExpr(*keep, "axis", *cells, *at)


def hit_cells(hits: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The four cells around each hit's grid line; ``own`` marks the one the hit flags."""
    around = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in product((0, 1), repeat=2)])
    spread = hits.withColumn("_o", F.explode(around))
    step = {
        "x": "i + case axis when 2 then _o.u when 1 then _o.v else 0 end",
        "y": "j + case axis when 0 then _o.u when 2 then _o.v else 0 end",
        "z": "k + case axis when 1 then _o.u when 0 then _o.v else 0 end",
    }
    return spread.selectExpr(*keep, "axis", *[f"{e} as {a}" for a, e in step.items()], "hx", "hy", "hz", "_o.u + _o.v = 0 as own")


def plane_quadric(weight: Column | float = 1.0) -> dict[str, Column]:
    p = [F.col("nx"), F.col("ny"), F.col("nz"), F.col("nd")]
    return {f"q{i}{j}": p[i] * p[j] * weight for i in range(4) for j in range(i, 4)}


def line_quadric(weight: float) -> dict[str, Column]:
    """Squared distance to the line through s along the unit direction d."""
    d, s = [F.col(f"d{a}") for a in AXES], [F.col(f"s{a}") for a in AXES]
    along = sum((x * y for x, y in zip(d[1:], s[1:])), d[0] * s[0])
    out = {f"q{i}{j}": ((1.0 if i == j else 0.0) - d[i] * d[j]) * weight for i in range(3) for j in range(i, 3)}
    out.update({f"q{i}3": (d[i] * along - s[i]) * weight for i in range(3)})
    out["q33"] = (sum((x * x for x in s[1:]), s[0] * s[0]) - along * along) * weight
    return out


def overlap_cells(triangles: DataFrame, keep: Sequence[str], n: int) -> DataFrame:
    """Cells that overlap a triangle: its box's cells, cut by the plane and by its three projections.

    The projection onto x, y is tested before z is enumerated, so a large slanted
    triangle does not enumerate its whole box.
    """
    size = 1.0 / n
    lo = {a: f"greatest(cast(least(a{a}, b{a}, c{a}) * {n} as int), 0)" for a in AXES}
    hi = {a: f"least(cast(greatest(a{a}, b{a}, c{a}) * {n} + 1 as int), {n})" for a in AXES}
    keep_tri = list(dict.fromkeys([*keep, *[f"{c}{a}" for c in "abc" for a in AXES], "nx", "ny", "nz"]))

    def column(df: DataFrame, axis: str) -> DataFrame:
        return df.filter(f"{lo[axis]} < {hi[axis]}").withColumn(axis, F.expr(f"explode(sequence({lo[axis]}, {hi[axis]} - 1))"))

    def projected(u: str, v: str, w: str) -> Column:
        """The cell's square reaches the inner side of all three projected edges."""
        turn = F.when(F.col(f"n{w}") < 0, -1.0).otherwise(1.0)
        ok = F.lit(True)
        for s, e in (("a", "b"), ("b", "c"), ("c", "a")):
            du, dv = F.col(f"{e}{u}") - F.col(f"{s}{u}"), F.col(f"{e}{v}") - F.col(f"{s}{v}")
            mu, mv = -turn * dv, turn * du
            reach = mu * (F.col(u) * size - F.col(f"{s}{u}")) + mv * (F.col(v) * size - F.col(f"{s}{v}"))
            reach = reach + (F.greatest(mu, F.lit(0.0)) + F.greatest(mv, F.lit(0.0))) * size
            ok = ok & (reach >= 0)
        return ok

    normal = [F.col(f"n{a}") for a in AXES]
    base = sum((m * (F.col(a) * size - F.col(f"a{a}")) for m, a in list(zip(normal, AXES))[1:]), normal[0] * (F.col("x") * size - F.col("ax")))
    far = sum((F.greatest(m, F.lit(0.0)) for m in normal[1:]), F.greatest(normal[0], F.lit(0.0))) * size
    near = sum((F.least(m, F.lit(0.0)) for m in normal[1:]), F.least(normal[0], F.lit(0.0))) * size
    flat = column(column(spread(triangles.select(*keep_tri)), "x"), "y").filter(projected("x", "y", "z"))
    deep = column(flat, "z").filter((base + far) * (base + near) <= 0)
    return deep.filter(projected("y", "z", "x") & projected("z", "x", "y")).select(*keep, *AXES)


def segment_cells(segments: DataFrame, keep: Sequence[str], n: int) -> DataFrame:
    """Cells a segment s-e walks through, with its unit direction d.

    Every crossing of a grid plane is one row; the cell entered there follows from
    how many crossings of each axis come no later, so no walk is needed. Crossings at
    the same length are taken z first, then y, then x.
    """
    length = F.sqrt(sum(((F.col(f"e{a}") - F.col(f"s{a}")) ** 2 for a in AXES[1:]), (F.col("ex") - F.col("sx")) ** 2))
    s = spread(segments).withColumn("len", length).filter("len >= 1e-6")
    for a in AXES:
        s = s.withColumn(f"d{a}", (F.col(f"e{a}") - F.col(f"s{a}")) / F.col("len"))
        s = s.withColumn(f"b{a}", F.floor(F.col(f"s{a}") * n).cast("int"))
        s = s.withColumn(f"g{a}", F.when(F.col(f"d{a}") > 0, 1).otherwise(-1))
        border = (F.col(f"b{a}") + F.when(F.col(f"d{a}") > 0, 1).otherwise(0)) / float(n)
        s = s.withColumn(f"t{a}", F.try_divide(border - F.col(f"s{a}"), F.col(f"d{a}")))
        s = s.withColumn(f"p{a}", F.try_divide(F.lit(1.0 / n), F.abs(f"d{a}")))

    def passed(a: str, t: str, inclusive: bool) -> str:
        """Crossings of axis ``a`` no later than ``t`` (or before it), judged on the same lengths the events carry."""
        late = ">" if inclusive else ">="
        guess = f"cast(floor(({t} - t{a}) / p{a}) as int)"
        near = f"filter(array({guess} - 1, {guess}, {guess} + 1), m -> m >= 0 and not (t{a} + m * p{a} {late} {t}))"
        return f"if(t{a} is null or t{a} {late} {t}, 0, coalesce(array_max({near}), -1) + 1)"

    events = ["named_struct('axis', -1, 'm', 0, 't', 0D)"]
    lists = [f"array({events[0]})"]
    for i, a in enumerate(AXES):
        total = passed(a, "len", True)
        lists.append(
            f"if({total} > 0, transform(sequence(1, {total}), m -> named_struct('axis', {i}, 'm', m, 't', t{a} + (m - 1) * p{a})), "
            "cast(array() as array<struct<axis:int,m:int,t:double>>))"
        )
    walked = s.withColumn("c", F.expr(f"explode(concat({', '.join(lists)}))"))
    cell = []
    for i, a in enumerate(AXES):
        others = " ".join(f"when {o} then {passed(a, 'c.t', i > o)}" for o in range(3) if o != i)
        cell.append(f"b{a} + g{a} * (case c.axis when -1 then 0 when {i} then c.m {others} end) as {a}")
    inside = " and ".join(f"{a} >= 0 and {a} < {n}" for a in AXES)
    return walked.selectExpr(*keep, "sx", "sy", "sz", "dx", "dy", "dz", *cell).filter(inside)


def dual_grid_cells(
    triangles: DataFrame, boundary: DataFrame | None, batch: str, n: int, face_term: bool = True, boundary_weight: float = 0.2
) -> DataFrame:
    """Active cells with hit counts, position sums, axis flags and summed quadrics.

    Hits, overlaps and boundary crossings are stacked and grouped once by cell; cells
    that no grid line hit are dropped, which is the join to the active cells.
    """
    t = stage(with_normal(triangles), "triangles")  # scanned twice: for hits and for overlaps
    plane = ["nx", "ny", "nz", "nd"]
    hits = hit_cells(scan_hits(t, [batch, *plane], n), [batch, *plane])
    zero, no = F.lit(0.0), F.lit(False)
    parts = [
        hits.select(
            batch, *AXES, F.lit(1).alias("cnt"), "hx", "hy", "hz",
            *[(F.col("own") & (F.col("axis") == i)).alias(f"f{a}") for i, a in enumerate(AXES)],
            *[c.alias(k) for k, c in plane_quadric().items()],
        )
    ]
    rest = [F.lit(0).alias("cnt"), *[zero.alias(f"h{a}") for a in AXES], *[no.alias(f"f{a}") for a in AXES]]
    if face_term:
        faces = overlap_cells(t, [batch, *plane], n)
        parts.append(faces.select(batch, *AXES, *rest, *[c.alias(k) for k, c in plane_quadric().items()]))
    if boundary is not None and boundary_weight > 0:
        walked = segment_cells(boundary, [batch], n)
        parts.append(walked.select(batch, *AXES, *rest, *[c.alias(k) for k, c in line_quadric(boundary_weight).items()]))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    grouped = stacked.groupBy(batch, *AXES).agg(
        F.sum("cnt").alias("cnt"),
        *[F.sum(f"h{a}").alias(f"h{a}") for a in AXES],
        *[F.bool_or(f"f{a}").alias(f"f{a}") for a in AXES],
        *[F.sum(q).alias(q) for q in QUADRIC],
    )
    return grouped.filter("cnt > 0")


def constrained_minimum(q: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Minimise p'Qp (p homogeneous) per row inside a box.

    The free minimum wins if it lies inside; otherwise the best minimum over the box's
    sides, edges and corners, each solved with the other coordinates pinned.
    """
    best = np.full(len(q), np.inf)
    out = np.zeros((len(q), 3))
    settled = np.zeros(len(q), dtype=bool)
    for pins in sorted(product((None, 0, 1), repeat=3), key=lambda p: sum(v is not None for v in p)):
        free = [a for a in range(3) if pins[a] is None]
        point = np.ones((len(q), 4))
        for a in range(3):
            if pins[a] is not None:
                point[:, a] = (lower, upper)[pins[a]][:, a]
        if free:
            pinned = [a for a in range(4) if a not in free]
            rhs = -np.einsum("nij,nj->ni", q[:, free][:, :, pinned], point[:, pinned])
            point[:, free] = np.einsum("nij,nj->ni", np.linalg.pinv(q[:, free][:, :, free]), rhs)
        inside = ((point[:, :3] >= lower) & (point[:, :3] <= upper)).all(axis=1)
        if len(free) == 3:
            out[inside], settled = point[inside, :3], inside
            continue
        error = np.einsum("ni,nij,nj->n", point, q, point)
        better = ~settled & inside & (error < best)
        best[better] = error[better]
        out[better] = point[better, :3]
    return out


def solve_cells(cells: DataFrame, batch: str, n: int, regularization: float = 1e-2) -> DataFrame:
    """Dual vertex of each cell: quadric plus a pull towards the mean hit, kept inside the cell."""
    kind = dict(cells.dtypes)[batch]

    def solve(batches):
        for pdf in batches:
            q = np.zeros((len(pdf), 4, 4))
            for name in QUADRIC:
                i, j = int(name[1]), int(name[2])
                q[:, i, j] = q[:, j, i] = pdf[name]
            count = pdf["cnt"].to_numpy(float)
            mean = pdf[["hx", "hy", "hz"]].to_numpy() / count[:, None]
            pull = regularization * count
            q[:, [0, 1, 2], [0, 1, 2]] += pull[:, None]
            q[:, :3, 3] -= pull[:, None] * mean
            q[:, 3, :3] -= pull[:, None] * mean
            q[:, 3, 3] += pull * (mean * mean).sum(axis=1)
            corner = pdf[list(AXES)].to_numpy(float)
            v = constrained_minimum(q, corner / n, (corner + 1) / n) * n - corner
            yield pd.DataFrame(
                {batch: pdf[batch], **{a: pdf[a] for a in AXES}, **{f"v{a}": v[:, i] for i, a in enumerate(AXES)}, **{f"f{a}": pdf[f"f{a}"] for a in AXES}}
            )

    schema = f"{batch} {kind}, x int, y int, z int, vx double, vy double, vz double, fx boolean, fy boolean, fz boolean"
    return cells.mapInPandas(solve, schema)


def boundary_segments(faces: DataFrame, vertices: DataFrame, mesh: str = "mesh") -> DataFrame:
    """End points of the edges that only one face uses."""
    from sparcel.operators.mesh import edge_counts

    edges = edge_counts(faces, mesh).filter("faces = 1")
    for end, name in (("a", "s"), ("b", "e")):
        side = vertices.select(mesh, F.col("vid").alias(end), *[F.col(a).alias(f"{name}{a}") for a in AXES])
        edges = edges.join(side, [mesh, end])
    return edges


def mesh_to_dual_grid(vertices: DataFrame, faces: DataFrame, n: int, mesh: str = "mesh") -> DataFrame:
    """Normalised mesh to dual grid: cell, dual vertex in cell units, edge flags."""
    from sparcel.operators.mesh import gather, normalize

    unit = stage(normalize(vertices, mesh).withColumns({a: F.col(a) + 0.5 for a in AXES}), "unit")
    triangles = gather(faces, unit, mesh=mesh)
    grid = dual_grid_cells(triangles, boundary_segments(faces, unit, mesh), mesh, n)
    return solve_cells(grid, mesh, n)
