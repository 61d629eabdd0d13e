"""Mesh, texture and voxelisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparcel.operators import cells as C
from sparcel.operators import mesh as M
from sparcel.operators import raster, texture, voxelize
from sparcel.plans.catalog import query
from sparcel.plans.cells import _ring_sql, with_cells
from sparcel.session import stage
from sparcel.tables import CELL_KEYS, cells, load

GRID = 16

# strips of triangles: 64 vectors make one mesh, three consecutive ones a face
MESH_SQL = """
vert AS (SELECT vec_id // 64 AS mesh, vec_id AS vid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
face AS (SELECT a.mesh, a.vid AS fid, a.vid AS v0, a.vid + 1 AS v1, a.vid + 2 AS v2 FROM vert a JOIN vert b ON b.vid = a.vid + 2 AND b.mesh = a.mesh)
"""

BOX_SQL = """
box AS (SELECT mesh, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz,
  0.99999::DOUBLE / greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS scale FROM vert GROUP BY mesh),
unit AS (SELECT v.mesh, vid, (x - cx) * scale AS x, (y - cy) * scale AS y, (z - cz) * scale AS z FROM vert v JOIN box b ON v.mesh = b.mesh)
"""


def vertices(spark, d):
    e = [F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")]
    return load(spark, d, "embeddings").select(F.expr("vec_id div 64").alias("mesh"), F.col("vec_id").alias("vid"), *e)


def faces(spark, d):
    vid = F.col("vec_id")
    third = load(spark, d, "embeddings").select((vid - 2).alias("vec_id"), F.expr("vec_id div 64").alias("mesh"))
    first = load(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 64").alias("mesh"))
    return first.join(third, ["vec_id", "mesh"]).select(
        "mesh", vid.alias("fid"), vid.alias("v0"), (vid + 1).alias("v1"), (vid + 2).alias("v2")
    )


def unit_triangles(spark, d):
    unit = M.normalize(vertices(spark, d)).withColumns({a: F.col(a) + 0.5 for a in "xyz"})
    return M.gather(faces(spark, d), unit)


@query(
    "edge_counts",
    "A15 M8",
    """
    WITH f AS (SELECT l_returnflag AS mesh, l_partkey AS v0, l_suppkey + 100000 AS v1, CAST(l_linenumber AS BIGINT) + 200000 AS v2 FROM lineitem),
    e AS (SELECT mesh, v0 AS p, v1 AS q FROM f UNION ALL SELECT mesh, v1, v2 FROM f UNION ALL SELECT mesh, v2, v0 FROM f)
    SELECT mesh, least(p, q) AS a, greatest(p, q) AS b, count(*) AS faces FROM e GROUP BY 1, 2, 3
    """,
)
def edge_counts(spark, d):
    f = load(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("mesh"), F.col("l_partkey").alias("v0"), (F.col("l_suppkey") + 100000).alias("v1"),
        (F.col("l_linenumber").cast("bigint") + 200000).alias("v2"),
    )
    return M.edge_counts(f)


@query(
    "boundary_edges",
    "A15",
    f"""WITH {MESH_SQL}, e AS (SELECT mesh, v0 AS p, v1 AS q FROM face UNION ALL SELECT mesh, v1, v2 FROM face UNION ALL SELECT mesh, v2, v0 FROM face)
    SELECT mesh, least(p, q) AS a, greatest(p, q) AS b FROM e GROUP BY 1, 2, 3 HAVING count(*) = 1""",
)
def boundary_edges(spark, d):
    return M.edge_counts(faces(spark, d)).filter("faces = 1").select("mesh", "a", "b")


@query("normalized_vertices", "A16 P12", f"WITH {MESH_SQL}, {BOX_SQL} SELECT mesh, vid, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM unit")
def normalized_vertices(spark, d):
    unit = M.normalize(vertices(spark, d))
    return unit.select("mesh", "vid", *[F.round(a, 9).alias(a) for a in "xyz"])


@query(
    "flattened_objects",
    "G3 P13 M9",
    """
    WITH o AS (SELECT o_custkey AS asset, o_orderkey AS obj, 1 + o_orderkey % 4 AS nv FROM orders WHERE o_orderkey % 7 <> 0),
    p AS (SELECT *, CAST(sum(nv) OVER (PARTITION BY asset ORDER BY obj) AS BIGINT) - nv AS off FROM o)
    SELECT asset, CAST(off + i AS BIGINT) AS fid, CAST(off + i AS BIGINT) AS v0, CAST(off + (i + 1) % nv AS BIGINT) AS v1, CAST(off + (i + 2) % nv AS BIGINT) AS v2
    FROM p, range(0, 4) r(i) WHERE i < nv
    """,
)
def flattened_objects(spark, d):
    """Faces of all objects of an asset, vertex numbers shifted by the objects before."""
    nv = "cast(1 + o_orderkey % 4 as int)"
    objects = load(spark, d, "orders").select(
        F.col("o_custkey").alias("asset"), F.col("o_orderkey").alias("obj"),
        F.expr(f"transform(sequence(1, {nv}), i -> named_struct('x', i, 'y', i, 'z', i))").alias("vertices"),
        F.expr(
            f"if(o_orderkey % 7 = 0, cast(array() as array<struct<v0:int,v1:int,v2:int>>), "
            f"transform(sequence(0, {nv} - 1), i -> named_struct('v0', i, 'v1', (i + 1) % {nv}, 'v2', (i + 2) % {nv})))"
        ).alias("faces"),
    )
    _, flat = M.flatten_objects(objects, "asset", "obj")
    return flat


@query(
    "face_normals",
    "J12 F19",
    f"""WITH {MESH_SQL}, g AS (SELECT f.mesh, f.fid, b.x - a.x AS px, b.y - a.y AS py, b.z - a.z AS pz, c.x - b.x AS qx, c.y - b.y AS qy, c.z - b.z AS qz
      FROM face f JOIN vert a ON a.vid = v0 JOIN vert b ON b.vid = v1 JOIN vert c ON c.vid = v2),
    n AS (SELECT mesh, fid, py * qz - pz * qy AS x, pz * qx - px * qz AS y, px * qy - py * qx AS z FROM g)
    SELECT mesh, fid, round(x / sqrt(x * x + y * y + z * z), 6) AS nx, round(y / sqrt(x * x + y * y + z * z), 6) AS ny,
           round(z / sqrt(x * x + y * y + z * z), 6) AS nz, round(sqrt(x * x + y * y + z * z) / 2, 9) AS area FROM n""",
)
def face_normals(spark, d):
    t = M.with_normal(M.gather(faces(spark, d), vertices(spark, d)))
    return t.select("mesh", "fid", *[F.round(f"n{a}", 6).alias(f"n{a}") for a in "xyz"], F.round(F.col("area2") / 2, 9).alias("area"))


TRI_SQL = f"""tri AS (SELECT f.mesh, f.fid, {', '.join(f'{k}.{ax} + 0.5 AS {k}_{ax}' for k in 'abc' for ax in 'xyz')}
  FROM face f JOIN unit a ON a.vid = v0 JOIN unit b ON b.vid = v1 JOIN unit c ON c.vid = v2)"""

NORMAL_SQL = """nn AS (SELECT *, (b_y - a_y) * (c_z - a_z) - (b_z - a_z) * (c_y - a_y) AS mx, (b_z - a_z) * (c_x - a_x) - (b_x - a_x) * (c_z - a_z) AS my,
  (b_x - a_x) * (c_y - a_y) - (b_y - a_y) * (c_x - a_x) AS mz FROM tri),
un AS (SELECT *, mx / sqrt(mx * mx + my * my + mz * mz) AS n_x, my / sqrt(mx * mx + my * my + mz * mz) AS n_y, mz / sqrt(mx * mx + my * my + mz * mz) AS n_z FROM nn)"""


def overlap_sql(n: int) -> str:
    """Overlapping (triangle, cell) pairs by testing every cell of each triangle's box, as CTE ``ovl``."""

    def projected(u: str, v: str, w: str) -> str:
        turn, tests = f"(CASE WHEN n_{w} < 0 THEN -1 ELSE 1 END)", []
        for s, e in (("a", "b"), ("b", "c"), ("c", "a")):
            mu, mv = f"(-{turn} * ({e}_{v} - {s}_{v}))", f"({turn} * ({e}_{u} - {s}_{u}))"
            tests.append(f"{mu} * ({u} / {n} - {s}_{u}) + {mv} * ({v} / {n} - {s}_{v}) + (greatest({mu}, 0) + greatest({mv}, 0)) / {n} >= 0")
        return " AND ".join(tests)

    box = " AND ".join(
        f"{a}.i >= trunc(least(a_{a}, b_{a}, c_{a}) * {n}) AND {a}.i < trunc(greatest(a_{a}, b_{a}, c_{a}) * {n} + 1)" for a in "xyz"
    )
    base = " + ".join(f"n_{a} * ({a} / {n} - a_{a})" for a in "xyz")
    far, near = (" + ".join(f"{f}(n_{a}, 0)" for a in "xyz") for f in ("greatest", "least"))
    return f"""cand AS (SELECT un.*, CAST(x.i AS INTEGER) AS x, CAST(y.i AS INTEGER) AS y, CAST(z.i AS INTEGER) AS z
      FROM un, range(0, {n}) x(i), range(0, {n}) y(i), range(0, {n}) z(i) WHERE {box}),
    ovl AS (SELECT mesh, fid, x, y, z FROM cand WHERE ({base} + ({far}) / {n}) * ({base} + ({near}) / {n}) <= 0
      AND {projected('x', 'y', 'z')} AND {projected('y', 'z', 'x')} AND {projected('z', 'x', 'y')})"""


def segment_sql(n: int) -> str:
    """Cells met by walking every boundary segment plane by plane, as CTE ``seg``; needs WITH RECURSIVE."""
    axes = "xyz"
    start = ", ".join(f"(e_{a} - s_{a}) / len AS d_{a}, CAST(floor(s_{a} * {n}) AS INTEGER) AS b_{a}" for a in axes)
    plan = ", ".join(
        f"CASE WHEN d_{a} > 0 THEN 1 ELSE -1 END AS g_{a}, CASE WHEN d_{a} = 0 THEN 'inf'::DOUBLE ELSE ((b_{a} + CASE WHEN d_{a} > 0 THEN 1 ELSE 0 END) / {float(n)}::DOUBLE - s_{a}) / d_{a} END AS t_{a}, "
        f"CASE WHEN d_{a} = 0 THEN 'inf'::DOUBLE ELSE {1 / n}::DOUBLE / abs(d_{a}) END AS p_{a}"
        for a in axes
    )
    keep = "mesh, a, b, len, " + ", ".join(f"s_{a}, d_{a}, g_{a}, p_{a}" for a in axes)
    axis = "CASE WHEN t_x < t_y THEN (CASE WHEN t_x < t_z THEN 0 ELSE 2 END) ELSE (CASE WHEN t_y < t_z THEN 1 ELSE 2 END) END"
    moved = ", ".join(f"CASE WHEN ax = {i} THEN c_{a} + g_{a} ELSE c_{a} END AS c_{a}, CASE WHEN ax = {i} THEN t_{a} + p_{a} ELSE t_{a} END AS t_{a}" for i, a in enumerate(axes))
    inside = " AND ".join(f"c_{a} BETWEEN 0 AND {n - 1}" for a in axes)
    return f"""ed_ AS (SELECT mesh, v0 AS p, v1 AS q FROM face UNION ALL SELECT mesh, v1, v2 FROM face UNION ALL SELECT mesh, v2, v0 FROM face),
    bo AS (SELECT mesh, least(p, q) AS a, greatest(p, q) AS b FROM ed_ GROUP BY 1, 2, 3 HAVING count(*) = 1),
    en_ AS (SELECT bo.mesh, a, b, {', '.join(f's.{a} + 0.5 AS s_{a}, e.{a} + 0.5 AS e_{a}' for a in axes)} FROM bo JOIN unit s ON s.vid = a JOIN unit e ON e.vid = b),
    le AS (SELECT *, sqrt({' + '.join(f'(e_{a} - s_{a}) * (e_{a} - s_{a})' for a in axes)}) AS len FROM en_),
    di_ AS (SELECT *, {start} FROM le WHERE len >= 1e-6), pl AS (SELECT *, {plan} FROM di_),
    wk AS (SELECT {keep}, {', '.join(f'b_{a} AS c_{a}, t_{a}' for a in axes)} FROM pl
      UNION ALL SELECT {keep}, {moved} FROM (SELECT *, {axis} AS ax FROM wk) WHERE least(t_x, t_y, t_z) <= len),
    seg AS (SELECT * FROM wk WHERE {inside})"""


def scan_sql(n: int) -> str:
    """Scan-line hits of unit-box triangles ``tri`` as CTEs ending in ``hit``."""
    views = " UNION ALL ".join(
        f"SELECT mesh, fid, {axis} AS axis, list_sort([{', '.join(f'struct_pack(y := {c}_{v}, x := {c}_{u}, z := {c}_{w})' for c in 'abc')}]) AS t FROM tri"
        for axis, (u, v, w) in enumerate((("y", "z", "x"), ("z", "x", "y"), ("x", "y", "z")))
    )
    cell = "greatest(least(CAST(trunc({0} * {1}) AS INTEGER), {2}), 0)"

    def clamp(v):
        return cell.format(v, n, n - 1)

    def mix(name, p, q):
        al = f"((y - {p}.y) / ({q}.y - {p}.y))"
        return f"CASE WHEN {p}.y = {q}.y THEN {p}.{name} ELSE (1 - {al}) * {p}.{name} + {al} * {q}.{name} END"

    def real(u, v, w, a):
        return f"CASE axis WHEN {a} THEN {w} WHEN {(a + 1) % 3} THEN {v} ELSE {u} END"

    return f"""{TRI_SQL},
    tv AS ({views}),
    tr AS (SELECT mesh, fid, axis, t[1] AS t0, t[2] AS t1, t[3] AS t2, {', '.join(f'{clamp(f"t[{i + 1}].y")} AS r{i}' for i in range(3))} FROM tv),
    rw AS (SELECT *, CAST(unnest(range(r0, r2)) AS INTEGER) AS row FROM tr WHERE r0 < r2),
    ed AS (SELECT mesh, fid, axis, row, (row + 1) / {float(n)}::DOUBLE AS y, CASE WHEN row < r1 THEN t0 ELSE t2 END AS p, t1 AS q, CASE WHEN row < r1 THEN t2 ELSE t0 END AS r FROM rw),
    en AS (SELECT mesh, fid, axis, row, y, list_sort([struct_pack(x := {mix('x', 'p', 'q')}, z := {mix('z', 'p', 'q')}), struct_pack(x := {mix('x', 'p', 'r')}, z := {mix('z', 'p', 'r')})]) AS e FROM ed),
    lr AS (SELECT mesh, fid, axis, row, y, e[1] AS l, e[2] AS r, {clamp('e[1].x')} AS c0, {clamp('e[2].x')} AS c1 FROM en),
    co AS (SELECT *, CAST(unnest(range(c0, c1)) AS INTEGER) AS col FROM lr WHERE c0 < c1),
    xx AS (SELECT *, (col + 1) / {float(n)}::DOUBLE AS x FROM co),
    zz AS (SELECT *, CASE WHEN l.x = r.x THEN l.z ELSE (1 - ((x - l.x) / (r.x - l.x))) * l.z + ((x - l.x) / (r.x - l.x)) * r.z END AS z FROM xx),
    dd AS (SELECT *, CAST(trunc(z * {n}) AS INTEGER) AS depth FROM zz),
    hit AS (SELECT mesh, fid, axis, {', '.join(f'{real("col", "row", "depth", a)} AS {k}' for a, k in enumerate('ijk'))},
      {', '.join(f'{real("x", "y", "z", a)} AS h{ax}' for a, ax in enumerate('xyz'))} FROM dd WHERE depth >= 0 AND depth < {n})
    """


@query(
    "scan_line_hits",
    "G4 J13",
    f"WITH {MESH_SQL}, {BOX_SQL}, {scan_sql(GRID)} SELECT mesh, fid, axis, i, j, k, round(hx, 9) AS hx, round(hy, 9) AS hy, round(hz, 9) AS hz FROM hit",
)
def scan_line_hits(spark, d):
    hits = voxelize.scan_hits(unit_triangles(spark, d), ["mesh", "fid"], GRID)
    return hits.select("mesh", "fid", "axis", "i", "j", "k", *[F.round(f"h{a}", 9).alias(f"h{a}") for a in "xyz"])


@query(
    "surface_cells",
    "A14 G4",
    f"""WITH {MESH_SQL}, {BOX_SQL}, {scan_sql(GRID)},
    sp AS (SELECT mesh, axis, i + CASE axis WHEN 2 THEN u WHEN 1 THEN v ELSE 0 END AS x, j + CASE axis WHEN 0 THEN u WHEN 2 THEN v ELSE 0 END AS y,
      k + CASE axis WHEN 1 THEN u WHEN 0 THEN v ELSE 0 END AS z, hx, hy, hz, u + v = 0 AS own FROM hit, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(u, v))
    SELECT mesh, x, y, z, count(*) AS cnt, round(sum(hx), 6) AS hx, round(sum(hy), 6) AS hy, round(sum(hz), 6) AS hz,
      bool_or(own AND axis = 0) AS fx, bool_or(own AND axis = 1) AS fy, bool_or(own AND axis = 2) AS fz FROM sp GROUP BY mesh, x, y, z""",
)
def surface_cells(spark, d):
    grid = voxelize.dual_grid_cells(unit_triangles(spark, d), None, "mesh", GRID, face_term=False)
    return grid.select("mesh", "x", "y", "z", "cnt", *[F.round(f"h{a}", 6).alias(f"h{a}") for a in "xyz"], "fx", "fy", "fz").withColumn(
        "cnt", F.col("cnt").cast("bigint")
    )


@query("mesh_to_dual_grid", "G4 J13 J14 A14 F8 F9 P12 P18")
def mesh_to_dual_grid(spark, d):
    """Strip meshes to quantised dual grids: hits, face and boundary terms, constrained solve."""
    from sparcel.functions.quant import pack_flags, to_byte

    grid = voxelize.mesh_to_dual_grid(vertices(spark, d), faces(spark, d), GRID)
    return grid.select(
        "mesh", "x", "y", "z", *[to_byte(F.col(f"v{a}")).alias(f"v{a}") for a in "xyz"],
        pack_flags(*[F.col(f"f{a}") for a in "xyz"]).alias("intersected"),
    )


@query(
    "triangle_cell_overlap", "J13",
    f"WITH {MESH_SQL}, {BOX_SQL}, {TRI_SQL}, {NORMAL_SQL}, {overlap_sql(GRID)} SELECT * FROM ovl",
)
def triangle_cell_overlap(spark, d):
    t = M.with_normal(unit_triangles(spark, d))
    return voxelize.overlap_cells(t, ["mesh", "fid"], GRID)


@query(
    "segment_cell_walk", "J14",
    f"WITH RECURSIVE {MESH_SQL}, {BOX_SQL}, {segment_sql(GRID)} SELECT mesh, a, b, c_x AS x, c_y AS y, c_z AS z FROM seg",
)
def segment_cell_walk(spark, d):
    unit = M.normalize(vertices(spark, d)).withColumns({a: F.col(a) + 0.5 for a in "xyz"})
    segments = voxelize.boundary_segments(faces(spark, d), unit)
    return voxelize.segment_cells(segments, ["mesh", "a", "b"], GRID).select("mesh", "a", "b", "x", "y", "z")


def quadric_sql() -> str:
    plane = {"q03": "n_x * nd", "q13": "n_y * nd", "q23": "n_z * nd", "q33": "nd * nd"}
    plane |= {f"q{i}{j}": f"n_{'xyz'[i]} * n_{'xyz'[j]}" for i in range(3) for j in range(i, 3)}
    along = "(s_x * d_x + s_y * d_y + s_z * d_z)"
    line = {f"q{i}{j}": f"0.2::DOUBLE * ({int(i == j)} - d_{'xyz'[i]} * d_{'xyz'[j]})" for i in range(3) for j in range(i, 3)}
    line |= {f"q{i}3": f"0.2::DOUBLE * (d_{a} * {along} - s_{a})" for i, a in enumerate("xyz")}
    line["q33"] = f"0.2::DOUBLE * (s_x * s_x + s_y * s_y + s_z * s_z - {along} * {along})"
    names = sorted(plane)
    return f"""WITH RECURSIVE {MESH_SQL}, {BOX_SQL}, {scan_sql(GRID)}, {NORMAL_SQL}, {overlap_sql(GRID)}, {segment_sql(GRID)},
    pn AS (SELECT *, -(n_x * a_x + n_y * a_y + n_z * a_z) AS nd FROM un),
    hc AS (SELECT mesh, fid, i + CASE axis WHEN 2 THEN u WHEN 1 THEN v ELSE 0 END AS x, j + CASE axis WHEN 0 THEN u WHEN 2 THEN v ELSE 0 END AS y,
      k + CASE axis WHEN 1 THEN u WHEN 0 THEN v ELSE 0 END AS z FROM hit, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(u, v)),
    al AS (SELECT hc.mesh, x, y, z, 1 AS cnt, {', '.join(f'{plane[q]} AS {q}' for q in names)} FROM hc JOIN pn ON pn.mesh = hc.mesh AND pn.fid = hc.fid
      UNION ALL SELECT ovl.mesh, x, y, z, 0, {', '.join(plane[q] for q in names)} FROM ovl JOIN pn ON pn.mesh = ovl.mesh AND pn.fid = ovl.fid
      UNION ALL SELECT mesh, c_x, c_y, c_z, 0, {', '.join(line[q] for q in names)} FROM seg)
    SELECT mesh, x, y, z, CAST(sum(cnt) AS BIGINT) AS cnt, {', '.join(f'round(sum({q}), 6) AS {q}' for q in names)} FROM al GROUP BY mesh, x, y, z HAVING sum(cnt) > 0"""


@query("dual_grid_quadrics", "A14 G4 J13 J14", quadric_sql())
def dual_grid_quadrics(spark, d):
    """Error quadrics of the active cells, before they are solved."""
    unit = M.normalize(vertices(spark, d)).withColumns({a: F.col(a) + 0.5 for a in "xyz"})
    grid = voxelize.dual_grid_cells(M.gather(faces(spark, d), unit), voxelize.boundary_segments(faces(spark, d), unit), "mesh", GRID)
    return grid.select("mesh", "x", "y", "z", "cnt", *[F.round(q, 6).alias(q) for q in voxelize.QUADRIC])


VERTEX = "((CAST(batch AS BIGINT) * 64 + x) * 512 + y * 8 + z)"


def dual_vertices(spark, d, together=CELL_KEYS):
    """Cells with a dual vertex in each, spread by quantity, and a split weight."""
    return cells(spark, d, together).select(
        "batch", "x", "y", "z", F.expr(VERTEX).alias("id"),
        *[(F.col(f) == 1).alias(f) for f in ("fa", "fb", "fc")],
        F.expr("x + pmod(qty * 0.37D, 1D)").alias("vx"),
        F.expr("y + pmod(qty * 0.73D, 1D)").alias("vy"),
        F.expr("z + pmod(qty * 0.91D, 1D)").alias("vz"),
        F.expr("1 + disc * 7.3D + qty / 100").alias("w"),
    )


def quads(spark, d):
    q = C.edge_quads(dual_vertices(spark, d), {"x": "fa", "y": "fb", "z": "fc"}, ["id", "vx", "vy", "vz", "w"])
    named = "named_struct('id', c{0}.id, 'x', c{0}.vx, 'y', c{0}.vy, 'z', c{0}.vz, 'w', c{0}.w)"
    return q.select("batch", "axis", "x", "y", "z", *[F.expr(named.format(k)).alias(f"c{k}") for k in range(4)])


DUAL_SQL = f"""c2 AS (SELECT batch, x, y, z, fa, fb, fc, struct_pack(id := {VERTEX}, x := x + (qty * 0.37::DOUBLE) % 1, y := y + (qty * 0.73::DOUBLE) % 1,
    z := z + (qty * 0.91::DOUBLE) % 1, w := 1 + disc * 7.3::DOUBLE + qty / 100) AS p FROM cells), quads AS (""" + " UNION ALL ".join(
    _ring_sql(axis, flag, "p", "c").replace("cells c", "c2 c") for axis, flag in (("x", "fa"), ("y", "fb"), ("z", "fc"))
) + ")"


def _fold_sql(i: int, j: int, k: int, m: int) -> str:
    def sub(a, b):
        return [f"(c{a}.{ax} - c{b}.{ax})" for ax in "xyz"]

    def crs(a, b):
        return [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]

    p, q = crs(sub(j, i), sub(k, i)), crs(sub(k, j), sub(m, j))
    return "abs(" + " + ".join(f"{a} * {b}" for a, b in zip(p, q)) + ")"


def _tri_sql(first: str) -> str:
    return f"""d AS (SELECT *, {first} AS first FROM quads)
    SELECT batch, axis, x, y, z, 0 AS half, c0.id AS v0, c1.id AS v1, CASE WHEN first THEN c2.id ELSE c3.id END AS v2 FROM d
    UNION ALL SELECT batch, axis, x, y, z, 1, CASE WHEN first THEN c0.id ELSE c3.id END, CASE WHEN first THEN c2.id ELSE c1.id END, CASE WHEN first THEN c3.id ELSE c2.id END FROM d"""


@query("dual_grid_triangles", "G5 J7", with_cells(f", {DUAL_SQL}, {_tri_sql(_fold_sql(0, 1, 2, 0) + ' > ' + _fold_sql(0, 1, 3, 3))}"))
def dual_grid_triangles(spark, d):
    return M.quads_to_triangles(quads(spark, d), ["batch", "axis", "x", "y", "z"])


@query("weighted_triangles", "G5", with_cells(f", {DUAL_SQL}, {_tri_sql('c0.w * c2.w > c1.w * c3.w')}"))
def weighted_triangles(spark, d):
    return M.quads_to_triangles(quads(spark, d), ["batch", "axis", "x", "y", "z"], split="weight")


@query(
    "quad_midpoints",
    "G5",
    with_cells(
        f""", {DUAL_SQL} SELECT batch, axis, x, y, z, {', '.join(f'round((c0.w * c2.w * (c0.{a} + c2.{a}) / 2 + c1.w * c3.w * (c1.{a} + c3.{a}) / 2) / (c0.w * c2.w + c1.w * c3.w), 6) AS m{a}' for a in 'xyz')} FROM quads"""
    ),
)
def quad_midpoints(spark, d):
    keys = ["batch", "axis", *[F.col(a).alias(f"k{a}") for a in "xyz"]]
    mid = M.quad_midpoints(quads(spark, d).withColumnsRenamed({a: f"k{a}" for a in "xyz"}), ["batch", "axis", "kx", "ky", "kz"])
    return mid.select("batch", "axis", *[F.col(f"k{a}").alias(a) for a in "xyz"], *[F.round(a, 6).alias(f"m{a}") for a in "xyz"])


TRAINING_SQL = f"""n AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY x, y, z) - 1 AS number FROM cells), {DUAL_SQL.replace(VERTEX, "number").replace("FROM cells)", "FROM n)")},
  sizes AS (SELECT batch, count(*) AS n FROM cells GROUP BY batch),
  k AS (SELECT q.*, s.n + row_number() OVER (PARTITION BY batch ORDER BY x, y, z, axis) - 1 AS mid FROM quads q JOIN sizes s USING (batch))"""


@query(
    "training_triangles",
    "G5",
    with_cells(f", {TRAINING_SQL} " + " UNION ALL ".join(f"SELECT batch, c{i}.id AS v0, c{(i + 1) % 4}.id AS v1, mid AS v2 FROM k" for i in range(4))),
)
def training_triangles(spark, d):
    """Four triangles around each quad's middle vertex, whose numbers follow those of the cells."""
    return M.training_mesh(dual_vertices(spark, d, ["batch"]).drop("id"), {"x": "fa", "y": "fb", "z": "fc"})[1]


@query(
    "training_vertices",
    "G5",
    with_cells(
        f""", {TRAINING_SQL} SELECT batch, p.id AS id, {', '.join(f'round(p.{a}, 6) AS {a}' for a in 'xyz')} FROM c2
        UNION ALL SELECT batch, mid, {', '.join(f'round((c0.w * c2.w * (c0.{a} + c2.{a}) / 2 + c1.w * c3.w * (c1.{a} + c3.{a}) / 2) / (c0.w * c2.w + c1.w * c3.w), 6)' for a in 'xyz')} FROM k"""
    ),
)
def training_vertices(spark, d):
    vertices, _ = M.training_mesh(dual_vertices(spark, d, ["batch"]).drop("id"), {"x": "fa", "y": "fb", "z": "fc"})
    return vertices.select("batch", "id", *[F.round(a, 6).alias(a) for a in "xyz"])


# textures: every vector is an 8 x 8 image of bytes
TEXEL_SQL = """texel0 AS (SELECT vec_id AS tex, CAST((i - 1) % 8 AS INTEGER) AS tx, CAST((i - 1) // 8 AS INTEGER) AS ty,
  CAST(floor(greatest(least(CAST(embedding[i] AS DOUBLE) + 0.5, 1), 0) * 255) AS INTEGER) AS r FROM embeddings, range(1, 65) q(i))"""


def texels(spark, d):
    value = load(spark, d, "embeddings").select(F.col("vec_id").alias("tex"), F.posexplode("embedding").alias("i", "v"))
    byte = F.floor(F.greatest(F.least(F.col("v").cast("double") + 0.5, F.lit(1.0)), F.lit(0.0)) * 255).cast("int")
    return value.select(
        "tex", (F.col("i") % 8).alias("tx"), F.expr("cast(i div 8 as int)").alias("ty"), byte.alias("r"), (255 - byte).alias("g"), (byte % 16).alias("b")
    )


PYRAMID_SQL = f"""{TEXEL_SQL},
t1 AS (SELECT tex, tx // 2 AS tx, ty // 2 AS ty, CAST(sum(r) // 4 AS INTEGER) AS r, CAST(sum(255 - r) // 4 AS INTEGER) AS g FROM texel0 GROUP BY 1, 2, 3),
t2 AS (SELECT tex, tx // 2 AS tx, ty // 2 AS ty, CAST(sum(r) // 4 AS INTEGER) AS r, CAST(sum(g) // 4 AS INTEGER) AS g FROM t1 GROUP BY 1, 2, 3),
t3 AS (SELECT tex, tx // 2 AS tx, ty // 2 AS ty, CAST(sum(r) // 4 AS INTEGER) AS r, CAST(sum(g) // 4 AS INTEGER) AS g FROM t2 GROUP BY 1, 2, 3),
texel AS (SELECT 0 AS level, tex, tx, ty, r, 255 - r AS g FROM texel0 UNION ALL SELECT 1, tex, tx, ty, r, g FROM t1 UNION ALL SELECT 2, tex, tx, ty, r, g FROM t2 UNION ALL SELECT 3, tex, tx, ty, r, g FROM t3)"""


@query("mip_pyramid", "F23", f"WITH {PYRAMID_SQL} SELECT CAST(level AS INTEGER) AS level, tex, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, r, g FROM texel")
def mip_pyramid(spark, d):
    return texture.pyramid(texels(spark, d), 8).select("level", "tex", "tx", "ty", "r", "g")


@query(
    "texture_samples",
    "F20 F21 F22 P16",
    f"""WITH {PYRAMID_SQL},
    pt AS (SELECT o_orderkey AS pid, o_custkey % (SELECT count(*) FROM embeddings) AS tex, ((o_orderkey * 37) % 1009) / 501.7::DOUBLE - 0.5 AS u, ((o_custkey * 53) % 997) / 499.3::DOUBLE - 0.5 AS v,
       CASE o_orderkey % 5 WHEN 0 THEN 'NEAREST' ELSE 'LINEAR' END AS f, CASE o_custkey % 3 WHEN 0 THEN 'REPEAT' WHEN 1 THEN 'CLAMP' ELSE 'MIRROR' END AS w,
       log2((1 + o_orderkey % 97) / 60.0::DOUBLE * 8) AS mip FROM orders),
    lv AS (SELECT pid, tex, u, v, f, w, CASE WHEN f = 'NEAREST' OR mip <= 0 THEN 0 WHEN mip >= 3 THEN 3 ELSE CAST(floor(mip) AS INTEGER) + up END AS level,
       CASE WHEN f = 'NEAREST' OR mip <= 0 OR mip >= 3 THEN 1 - up WHEN up = 1 THEN mip - floor(mip) ELSE 1 - (mip - floor(mip)) END AS share
       FROM pt, (VALUES (0), (1)) k(up)),
    sz AS (SELECT *, 8 >> level AS size, u * (8 >> level) AS x, (1 - v) * (8 >> level) AS y FROM lv WHERE share > 0),
    tp AS (SELECT pid, tex, level, size, w, share,
       CAST(CASE WHEN f = 'NEAREST' THEN floor(x) ELSE floor(x - 0.5) + dx END AS INTEGER) AS ix, CAST(CASE WHEN f = 'NEAREST' THEN floor(y) ELSE floor(y - 0.5) + dy END AS INTEGER) AS iy,
       CASE WHEN f = 'NEAREST' THEN (1 - dx) * (1 - dy) ELSE (CASE WHEN dx = 1 THEN x - floor(x - 0.5) - 0.5 ELSE 1 - (x - floor(x - 0.5) - 0.5) END) * (CASE WHEN dy = 1 THEN y - floor(y - 0.5) - 0.5 ELSE 1 - (y - floor(y - 0.5) - 0.5) END) END AS tw
       FROM sz, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) o(dx, dy)),
    wr AS (SELECT pid, tex, level, share * tw AS q, {', '.join(f"CASE w WHEN 'CLAMP' THEN greatest(least({c}, size - 1), 0) WHEN 'REPEAT' THEN (({c} % size) + size) % size ELSE (CASE WHEN (({c} % (2 * size)) + 2 * size) % (2 * size) < size THEN (({c} % (2 * size)) + 2 * size) % (2 * size) ELSE 2 * size - 1 - (({c} % (2 * size)) + 2 * size) % (2 * size) END) END AS {n}" for c, n in (('ix', 'tx'), ('iy', 'ty')))} FROM tp)
    SELECT pid, round(sum(q * r) / 255, 6) AS r, round(sum(q * g) / 255, 6) AS g FROM wr JOIN texel t ON t.tex = wr.tex AND t.level = wr.level AND t.tx = wr.tx AND t.ty = wr.ty GROUP BY pid""",
)
def texture_samples(spark, d):
    n = load(spark, d, "embeddings").count()
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    points = load(spark, d, "orders").select(
        k.alias("pid"), (c % n).alias("tex"), (k * 37 % 1009 / 501.7 - 0.5).alias("u"), (c * 53 % 997 / 499.3 - 0.5).alias("v"),
        texture.rename_values(F.when(k % 5 == 0, "Closest").otherwise("Cubic"), texture.FILTERS).alias("filter"),
        texture.rename_values(F.when(c % 3 == 0, "REPEAT").when(c % 3 == 1, "EXTEND").otherwise("MIRROR"), texture.WRAPS).alias("wrap"),
        F.lit(8).alias("size"), texture.mip_level((1 + k % 97) / F.lit(60.0), F.lit(8)).alias("mip"),
    )
    sampled = texture.sample(points, texture.pyramid(texels(spark, d), 8), ["pid"])
    return sampled.select("pid", F.round("r", 6).alias("r"), F.round("g", 6).alias("g"))


@query(
    "material_defaults",
    "P14 P15 P16 F24",
    """
    WITH m AS (SELECT p_partkey, p_brand AS tex, CASE WHEN p_size % 3 = 0 THEN 'MASK' ELSE 'OPAQUE' END AS mode, p_size / 50.0::DOUBLE AS alpha FROM part WHERE p_size > 10)
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(alpha, 1.0::DOUBLE) AS alpha,
      coalesce(CASE WHEN mode = 'OPAQUE' AND tex <> 'Brand#1' THEN 'BLEND' ELSE mode END, 'OPAQUE') AS alpha_mode,
      CASE coalesce(CASE WHEN mode = 'OPAQUE' AND tex <> 'Brand#1' THEN 'BLEND' ELSE mode END, 'OPAQUE') WHEN 'OPAQUE' THEN 1.0::DOUBLE
        WHEN 'MASK' THEN CASE WHEN coalesce(alpha, 1.0::DOUBLE) < 0.5 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE coalesce(alpha, 1.0::DOUBLE) END AS opacity
    FROM lineitem LEFT JOIN m ON l_partkey = p_partkey
    """,
)
def material_defaults(spark, d):
    tex = F.when(F.col("p_brand") != "Brand#1", F.col("p_brand"))
    mode = F.when(F.col("p_size") % 3 == 0, "MASK").otherwise("OPAQUE")
    materials = load(spark, d, "part").filter("p_size > 10").select(
        F.col("p_partkey").alias("l_partkey"), texture.fixed_alpha_mode(mode, tex).alias("alpha_mode"), (F.col("p_size") / 50).alias("alpha")
    )
    items = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    faced = texture.with_material(items, materials, ["l_partkey"])
    return faced.withColumn("opacity", texture.effective_alpha(F.col("alpha_mode"), F.col("alpha"), F.lit(0.5)))


def surface_points(spark, d):
    uv = load(spark, d, "embeddings").select(
        F.expr("vec_id div 64").alias("mesh"), F.col("vec_id").alias("vid"),
        F.get("embedding", F.lit(3)).cast("double").alias("u"), F.get("embedding", F.lit(4)).cast("double").alias("v"),
    )
    unit = M.normalize(vertices(spark, d)).withColumns({a: F.col(a) + 0.5 for a in "xyz"}).join(uv, ["mesh", "vid"])
    t = M.gather(faces(spark, d), unit, ["x", "y", "z", "u", "v"]).withColumn("material", F.col("fid"))
    return texture.surface_points(t, ["mesh", "fid"], GRID)


SURFACE_SQL = f"""{MESH_SQL}, {BOX_SQL}, {scan_sql(GRID)}, {NORMAL_SQL},
    tc AS (SELECT DISTINCT mesh, fid, i + CASE axis WHEN 2 THEN p WHEN 1 THEN q ELSE 0 END AS x, j + CASE axis WHEN 0 THEN p WHEN 2 THEN q ELSE 0 END AS y,
      k + CASE axis WHEN 1 THEN p WHEN 0 THEN q ELSE 0 END AS z FROM hit, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(p, q)),
    ce AS (SELECT tc.*, un.* EXCLUDE (mesh, fid), (tc.x + 0.5) / {GRID} AS qx, (tc.y + 0.5) / {GRID} AS qy, (tc.z + 0.5) / {GRID} AS qz FROM tc JOIN un ON un.mesh = tc.mesh AND un.fid = tc.fid),
    di AS (SELECT *, (qx - a_x) * n_x + (qy - a_y) * n_y + (qz - a_z) * n_z AS dist FROM ce),
    ba AS (SELECT *, (b_x - a_x) * (b_x - a_x) + (b_y - a_y) * (b_y - a_y) + (b_z - a_z) * (b_z - a_z) AS d00, (b_x - a_x) * (c_x - a_x) + (b_y - a_y) * (c_y - a_y) + (b_z - a_z) * (c_z - a_z) AS d01,
      (c_x - a_x) * (c_x - a_x) + (c_y - a_y) * (c_y - a_y) + (c_z - a_z) * (c_z - a_z) AS d11,
      (qx - dist * n_x - a_x) * (b_x - a_x) + (qy - dist * n_y - a_y) * (b_y - a_y) + (qz - dist * n_z - a_z) * (b_z - a_z) AS d20,
      (qx - dist * n_x - a_x) * (c_x - a_x) + (qy - dist * n_y - a_y) * (c_y - a_y) + (qz - dist * n_z - a_z) * (c_z - a_z) AS d21 FROM di),
    vw AS (SELECT *, (d11 * d20 - d01 * d21) / (d00 * d11 - d01 * d01) AS v, (d00 * d21 - d01 * d20) / (d00 * d11 - d01 * d01) AS w FROM ba),
    uv AS (SELECT s.*, e0.embedding[4]::DOUBLE AS u0, e1.embedding[4]::DOUBLE AS u1, e2.embedding[4]::DOUBLE AS u2, e0.embedding[5]::DOUBLE AS v0, e1.embedding[5]::DOUBLE AS v1, e2.embedding[5]::DOUBLE AS v2
      FROM vw s JOIN embeddings e0 ON e0.vec_id = s.fid JOIN embeddings e1 ON e1.vec_id = s.fid + 1 JOIN embeddings e2 ON e2.vec_id = s.fid + 2),
    sp AS (SELECT mesh, fid, x, y, z, 1 - dist AS weight, n_x, n_y, n_z, (1 - v - w) * u0 + v * u1 + w * u2 AS tu, (1 - v - w) * v0 + v * v1 + w * v2 AS tv,
      (u1 - u0) * (v2 - v0) - (v1 - v0) * (u2 - u0) AS det,
      sqrt({' + '.join(f'pow((v2 - v0) * (b_{a} - a_{a}) - (v1 - v0) * (c_{a} - a_{a}), 2)' for a in 'xyz')}) AS lt,
      sqrt({' + '.join(f'pow((u1 - u0) * (c_{a} - a_{a}) - (u2 - u0) * (b_{a} - a_{a}), 2)' for a in 'xyz')}) AS ls FROM uv)"""


@query(
    "surface_points",
    "F19 G6",
    f"WITH {SURFACE_SQL} SELECT mesh, fid, x, y, z, round(weight, 6) AS weight, round(tu, 5) AS u FROM sp",
)
def surface_point_rows(spark, d):
    return surface_points(spark, d).select("mesh", "fid", "x", "y", "z", F.round("weight", 6).alias("weight"), F.round("u", 5).alias("u"))


def attribute_sql(final: str) -> str:
    """Weighted cell attributes; ``final`` turns a mean m of attribute attr into the output value."""
    key = "mesh, fid, x, y, z"
    taps = ", ".join(
        f"(((CAST(floor({c} - 0.5) AS INTEGER) + d{c}) % size) + size) % size AS t{c}" for c in ("px", "py")
    )
    weight = " * ".join(f"(CASE WHEN d{c} = 1 THEN {c} - floor({c} - 0.5) - 0.5 ELSE 1 - ({c} - floor({c} - 0.5) - 0.5) END)" for c in ("px", "py"))
    values = {
        "base_color": ("0.9::DOUBLE * r", "0.9::DOUBLE * g"),
        "roughness": ("0.9::DOUBLE * r", "0.9::DOUBLE * g"),
        "metallic": ("0.9::DOUBLE", "0.9::DOUBLE"),
        "alpha": ("al", "al"),
        "normal": ("n_x", "n_y"),
    }
    union = " UNION ALL ".join(f"SELECT mesh, x, y, z, weight, '{n}' AS attr, {r} AS r, {g} AS g FROM cu" for n, (r, g) in values.items())
    return f"""WITH {SURFACE_SQL}, {PYRAMID_SQL},
    mp AS (SELECT *, CASE WHEN abs(det) < 1e-6 THEN log2({1 / GRID}::DOUBLE / 1e6 * 8) ELSE log2({1 / GRID}::DOUBLE / (sqrt(lt * ls) / abs(det)) * 8) END AS mip FROM sp),
    lv AS (SELECT {key}, tu, tv, CASE WHEN mip <= 0 THEN 0 WHEN mip >= 3 THEN 3 ELSE CAST(floor(mip) AS INTEGER) + up END AS level,
      CASE WHEN mip <= 0 OR mip >= 3 THEN 1 - up WHEN up = 1 THEN mip - floor(mip) ELSE 1 - (mip - floor(mip)) END AS share FROM mp, (VALUES (0), (1)) k(up)),
    sz AS (SELECT *, 8 >> level AS size, tu * (8 >> level) AS px, (1 - tv) * (8 >> level) AS py FROM lv WHERE share > 0),
    tp AS (SELECT {key}, level, share * {weight} AS q, {taps} FROM sz, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) o(dpx, dpy)),
    sm AS (SELECT tp.mesh, tp.fid, tp.x, tp.y, tp.z, sum(q * r) / 255 AS r, sum(q * g) / 255 AS g FROM tp JOIN texel t ON t.tex = tp.fid AND t.level = tp.level AND t.tx = tpx AND t.ty = tpy GROUP BY 1, 2, 3, 4, 5),
    cu AS (SELECT sp.mesh, sp.x, sp.y, sp.z, weight, n_x, n_y, r, g, CASE WHEN sp.fid % 2 = 1 THEN 0.9::DOUBLE * r WHEN 0.9::DOUBLE * r < 0.45 THEN 0 ELSE 1 END AS al
      FROM sp JOIN sm ON sm.mesh = sp.mesh AND sm.fid = sp.fid AND sm.x = sp.x AND sm.y = sp.y AND sm.z = sp.z),
    av AS ({union}),
    me AS (SELECT mesh, x, y, z, attr, sum(r * weight) / sum(weight) AS r, sum(g * weight) / sum(weight) AS g FROM av GROUP BY mesh, x, y, z, attr)
    SELECT mesh, x, y, z, attr, {final.format(m='r')} AS r, {final.format(m='g')} AS g FROM me"""


def textured_cells(spark, d):
    """Cell attributes of the textured strips: every face has its own material and image."""
    ids = load(spark, d, "embeddings").select("vec_id")
    textured = ids.select(
        F.col("vec_id").alias("material"),
        F.explode(F.array(*[F.lit(a) for a in ("base_color", "roughness", "metallic", "alpha", "normal")])).alias("attr"),
    )
    has_texture = F.col("attr").isin("base_color", "roughness", "alpha")
    looks = textured.select(
        "material", "attr", F.when(has_texture, F.col("material")).alias("tex"), F.lit(8).alias("size"), F.lit("LINEAR").alias("filter"),
        F.lit("REPEAT").alias("wrap"), *[F.lit(0.9).alias(f"f{c}") for c in "rgb"],
        F.when(F.col("material") % 2 == 0, "MASK").otherwise("BLEND").alias("mode"), F.lit(0.45).alias("cutoff"),
    )
    pyramid = stage(texture.pyramid(texels(spark, d), 8), "pyramid")
    return texture.cell_attributes(surface_points(spark, d), looks, pyramid, ["mesh", "fid"], "mesh")


@query("mesh_attributes", "G6 F19 F20 F21 F22 F24 A13", attribute_sql("round({m}, 5)"))
def mesh_attributes(spark, d):
    return textured_cells(spark, d).select("mesh", "x", "y", "z", "attr", F.round("r", 5).alias("r"), F.round("g", 5).alias("g"))


@query(
    "mesh_attribute_bytes",
    "G6 F8",
    attribute_sql("CAST(floor(greatest(least(CASE WHEN attr = 'normal' THEN {m} * 0.5 + 0.5 ELSE {m} END * 255, 255), 0)) AS INTEGER)"),
)
def mesh_attribute_bytes(spark, d):
    """The same attributes as bytes, one row per (cell, attribute)."""
    attrs = textured_cells(spark, d)
    return attrs.select("mesh", "x", "y", "z", "attr", *[texture.attribute_bytes(F.col(c), F.col("attr")).alias(c) for c in "rg"])


TILES_SQL = """b AS (SELECT CAST(l_orderkey // 2000 AS INTEGER) AS view_, l_orderkey * 100000 + l_partkey AS item, CAST(l_partkey % 120 AS INTEGER) AS x0, CAST(l_partkey % 120 + 1 + l_linenumber * 3 AS INTEGER) AS x1,
        CAST(l_suppkey % 90 AS INTEGER) AS y0, CAST(l_suppkey % 90 + 1 + l_linenumber AS INTEGER) AS y1, l_extendedprice AS depth FROM lineitem),
    t AS (SELECT view_, item, depth, y.i * 8 + x.i AS tile FROM b, range(0, 8) x(i), range(0, 6) y(i)
      WHERE x.i BETWEEN x0 // 16 AND (x1 - 1) // 16 AND y.i BETWEEN y0 // 16 AND (y1 - 1) // 16)"""


@query(
    "tile_lists",
    "W8",
    f"""WITH {TILES_SQL}
    SELECT view_, CAST(tile AS INTEGER) AS tile, item, depth, row_number() OVER (PARTITION BY view_, tile ORDER BY depth, item) - 1 AS rank FROM t""",
)
def tile_lists(spark, d):
    return raster.tile_list(tile_overlaps(spark, d), "view_", "item")


def tile_overlaps(spark, d):
    boxes = load(spark, d, "lineitem").select(
        F.expr("cast(l_orderkey div 2000 as int)").alias("view_"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("item"),
        F.expr("cast(l_partkey % 120 as int)").alias("x0"), F.expr("cast(l_partkey % 120 + 1 + l_linenumber * 3 as int)").alias("x1"),
        F.expr("cast(l_suppkey % 90 as int)").alias("y0"), F.expr("cast(l_suppkey % 90 + 1 + l_linenumber as int)").alias("y1"),
        F.col("l_extendedprice").alias("depth"),
    )
    return raster.tile_overlaps(boxes, 16, 128, 96, "view_", "item")


@query(
    "tile_ranges",
    "W8",
    f"""WITH {TILES_SQL} SELECT *, start + len AS stop FROM (
      SELECT *, CAST(coalesce(sum(len) OVER (PARTITION BY view_ ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (
        SELECT view_, CAST(tile AS INTEGER) AS tile, count(*) AS len, min(depth) AS nearest FROM t GROUP BY 1, 2))""",
)
def tile_ranges(spark, d):
    return raster.tile_ranges(tile_overlaps(spark, d), "view_")


@query(
    "first_hits",
    "G7 W8",
    with_cells(
        """SELECT batch, CAST(y * 2 + a.i AS INTEGER) AS py, CAST(x * 2 + b.i AS INTEGER) AS px, min(z) AS z, arg_min(qty, z) AS qty
        FROM cells, range(0, 2) a(i), range(0, 2) b(i) GROUP BY 1, 2, 3"""
    ),
)
def first_hits(spark, d):
    return raster.first_hits(cells(spark, d, ["batch"]), "batch", ["qty"], 64, 128)


WIDE, HIGH, TILE = 40, 24, 8


def _cameras(spark, d):
    """A camera per batch, some of them among the cells."""
    batches = load(spark, d, "lineitem").select(F.expr("cast(l_orderkey div 2000 as int)").alias("batch")).distinct()
    at = batches.select(
        "batch", F.expr("-30D + 25 * (batch % 3)").alias("px"), F.expr("-20D + 7 * (batch % 5)").alias("py"), F.expr("2.5D + 9 * (batch % 2)").alias("pz"), F.lit(32.0).alias("focal"),
    )
    return raster.look_at(at, [F.lit(32.0), F.lit(30.5), F.lit(4.0)])


def _projected(spark, d):
    centers = cells(spark, d, ["batch"]).select("batch", F.expr("x * 1000L + y * 10 + z").alias("item"), *[(F.col(a) + 0.5).alias(a) for a in "xyz"])
    return raster.project_cells(centers, _cameras(spark, d), "batch", "item", 1.0, WIDE, HIGH)


def _dot(a: str, b: str, minus: str = "") -> str:
    return " + ".join(f"({a}{c}{f' - {minus}{c}' if minus else ''}) * {b}{c}" for c in "xyz")


CAMERA_SQL = f"""
  c0 AS (SELECT DISTINCT batch, -30.0::DOUBLE + 25 * (batch % 3) AS px, -20.0::DOUBLE + 7 * (batch % 5) AS py, 2.5::DOUBLE + 9 * (batch % 2) AS pz FROM cells),
  c1 AS (SELECT *, sqrt((32 - px) * (32 - px) + (30.5 - py) * (30.5 - py) + (4 - pz) * (4 - pz)) AS l FROM c0),
  c2 AS (SELECT batch, px, py, pz, (32 - px) / l AS fx, (30.5 - py) / l AS fy, (4 - pz) / l AS fz FROM c1),
  c3 AS (SELECT *, sqrt(fx * fx + fy * fy) AS m FROM c2),
  c4 AS (SELECT *, fy / m AS rx, -fx / m AS ry, 0.0::DOUBLE AS rz FROM c3),
  cameras AS (SELECT *, fy * rz - fz * ry AS dx, fz * rx - fx * rz AS dy, fx * ry - fy * rx AS dz FROM c4),
  v AS (SELECT batch, CAST(x AS BIGINT) * 1000 + y * 10 + z AS item, x + 0.5::DOUBLE AS x, y + 0.5::DOUBLE AS y, z + 0.5::DOUBLE AS z FROM cells),
  s AS (SELECT v.*, c.* EXCLUDE (batch), {_dot('v.', 'c.f', 'c.p')} AS depth FROM v JOIN cameras c USING (batch)),
  s2 AS (SELECT * FROM s WHERE depth > 0.2)"""


@query(
    "camera_first_hits",
    "G7 W8 F18",
    with_cells(
        f""", {CAMERA_SQL},
  pix AS (SELECT batch, px, py, pz, u.i AS ix, w.i AS iy, {', '.join(f'f{a} + (u.i + 0.5 - {WIDE / 2}) / 32 * r{a} + (w.i + 0.5 - {HIGH / 2}) / 32 * d{a} AS g{a}' for a in 'xyz')} FROM cameras, range({WIDE}) u(i), range({HIGH}) w(i)),
  unit AS (SELECT batch, ix, iy, {', '.join(f'CASE WHEN abs(g{a} / sqrt(gx * gx + gy * gy + gz * gz)) < 1e-12 THEN 1e-12 ELSE g{a} / sqrt(gx * gx + gy * gy + gz * gz) END AS q{a}' for a in 'xyz')} FROM pix),
  t AS (SELECT s2.batch, iy, ix, item, depth, {', '.join(f'({a} - 0.5 - p{a}) / q{a} AS n{a}, ({a} + 0.5 - p{a}) / q{a} AS o{a}' for a in 'xyz')} FROM s2 JOIN unit USING (batch)),
  h AS (SELECT batch, iy, ix, item, depth, greatest(0, {', '.join(f'least(n{a}, o{a})' for a in 'xyz')}) AS enter, least({', '.join(f'greatest(n{a}, o{a})' for a in 'xyz')}) AS leave FROM t)
  SELECT batch, CAST(iy AS INTEGER) AS py, CAST(ix AS INTEGER) AS px, arg_min(item, (depth, item)) AS item, round(arg_min(enter, (depth, item)), 6) AS distance FROM h WHERE leave > enter GROUP BY 1, 2, 3"""
    ),
)
def camera_first_hits(spark, d):
    """First cell along the ray of every pixel of a perspective camera; the twin tests every cell against every pixel."""
    hits = raster.camera_hits(_projected(spark, d), "batch", "item", 1.0, WIDE, HIGH)
    return hits.select("batch", "py", "px", "item", F.round("distance", 6).alias("distance"))


def _box_sql() -> str:
    corners = [(i, j, k) for i in (-0.5, 0.5) for j in (-0.5, 0.5) for k in (-0.5, 0.5)]
    values = ", ".join(f"({i}::DOUBLE, {j}::DOUBLE, {k}::DOUBLE)" for i, j, k in corners)
    f = " + ".join(f"(s2.{a} + e.{a} - p{a}) * f{a}" for a in "xyz")
    u, w = (f"32 * ({' + '.join(f'(s2.{a} + e.{a} - p{a}) * {n}{a}' for a in 'xyz')}) / greatest({f}, 1e-9) + {size / 2 - 0.5}" for n, size in (("r", WIDE), ("d", HIGH)))
    return f"""
  b AS (SELECT batch, item, depth, min({f}) < 1e-6 AS behind, min({u}) AS u0, max({u}) AS u1, min({w}) AS w0, max({w}) AS w1 FROM s2, (VALUES {values}) e(x, y, z) GROUP BY 1, 2, 3),
  box AS (SELECT batch, item, depth, CASE WHEN behind THEN 0 ELSE greatest(floor(u0), 0) END AS x0, CASE WHEN behind THEN {WIDE} ELSE least(ceil(u1) + 1, {WIDE}) END AS x1,
    CASE WHEN behind THEN 0 ELSE greatest(floor(w0), 0) END AS y0, CASE WHEN behind THEN {HIGH} ELSE least(ceil(w1) + 1, {HIGH}) END AS y1 FROM b),
  t AS (SELECT batch, y.i * {WIDE // TILE} + x.i AS tile, depth FROM box, range({WIDE // TILE}) x(i), range({HIGH // TILE}) y(i)
    WHERE x0 < x1 AND y0 < y1 AND x.i BETWEEN CAST(x0 AS BIGINT) // {TILE} AND CAST(x1 - 1 AS BIGINT) // {TILE} AND y.i BETWEEN CAST(y0 AS BIGINT) // {TILE} AND CAST(y1 - 1 AS BIGINT) // {TILE}),
  g AS (SELECT batch, CAST(tile AS INTEGER) AS tile, count(*) AS len, min(depth) AS nearest FROM t GROUP BY 1, 2)"""


@query(
    "projected_tile_ranges",
    "W8",
    with_cells(
        f""", {CAMERA_SQL}, {_box_sql()} SELECT batch, tile, len, round(nearest, 6) AS nearest, start, start + len AS stop FROM (
        SELECT *, CAST(coalesce(sum(len) OVER (PARTITION BY batch ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM g)"""
    ),
)
def projected_tile_ranges(spark, d):
    """Tiles of a perspective camera: where each one's items begin and end in the view's list."""
    overlaps = raster.tile_overlaps(_projected(spark, d), TILE, WIDE, HIGH, "batch", "item")
    ranges = raster.tile_ranges(overlaps, "batch")
    return ranges.select("batch", "tile", "len", F.round("nearest", 6).alias("nearest"), "start", "stop")
