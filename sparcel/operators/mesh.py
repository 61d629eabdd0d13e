"""Triangle meshes as vertex and face tables: edges, normalisation, flattening, gathering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.operators.cells import edge_quads
from sparcel.operators.ordered import group_position, largest_group, running
from sparcel.session import stage

AXES = ("x", "y", "z")


def flatten_objects(objects: DataFrame, asset: str, obj: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of an asset's objects, numbered through by a running vertex offset.

    Objects without vertices or without faces are skipped. ``vertices`` is an array of
    structs (x, y, z), ``faces`` an array of (v0, v1, v2) local to the object.
    """
    filled = objects.filter((F.size("vertices") > 0) & (F.size("faces") > 0))
    placed = running(
        filled, [asset], [obj], {"v_off": F.size("vertices").cast("bigint"), "f_off": F.size("faces").cast("bigint")}, exclusive=True
    )
    vertices = placed.select(asset, "v_off", F.posexplode("vertices").alias("i", "v")).select(
        asset, (F.col("v_off") + F.col("i")).alias("vid"), "v.*"
    )
    faces = placed.select(asset, "v_off", "f_off", F.posexplode("faces").alias("i", "f")).select(
        asset,
        (F.col("f_off") + F.col("i")).alias("fid"),
        *[(F.col(f"f.v{k}") + F.col("v_off")).alias(f"v{k}") for k in range(3)],
    )
    return vertices, faces


def edge_counts(faces: DataFrame, mesh: str = "mesh") -> DataFrame:
    """Undirected edges with the number of faces that use them; 1 marks a boundary."""
    sides = F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    return faces.select(mesh, F.explode(sides).alias("e")).groupBy(mesh, "e.a", "e.b").agg(F.count(F.lit(1)).alias("faces"))


def boxes(vertices: DataFrame, mesh: str = "mesh") -> DataFrame:
    """Center and uniform scale that fit each mesh just inside a unit cube."""
    ends = vertices.groupBy(mesh).agg(*[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    extent = F.greatest(*[F.col(f"hi{a}") - F.col(f"lo{a}") for a in AXES])
    return ends.select(
        mesh, *[((F.col(f"lo{a}") + F.col(f"hi{a}")) / 2).alias(f"c{a}") for a in AXES], (F.lit(0.99999) / extent).alias("scale")
    )


def normalize(vertices: DataFrame, mesh: str = "mesh") -> DataFrame:
    """Vertices moved and scaled into [-0.5, 0.5]."""
    fitted = vertices.join(boxes(vertices, mesh), mesh)
    return fitted.withColumns({a: (F.col(a) - F.col(f"c{a}")) * F.col("scale") for a in AXES}).select(*vertices.columns)


def gather(faces: DataFrame, vertices: DataFrame, values: Sequence[str] = AXES, mesh: str = "mesh") -> DataFrame:
    """Corner values of every face, as columns a*, b*, c*.

    The three corners of a face are looked up in one join and put back side by side
    by one grouping; a join per corner would shuffle faces and vertices three times. Faces that name
    an unknown vertex are left to ``broken_faces``.
    """
    corner = F.array(*[F.struct(F.lit(k).alias("slot"), F.col(v).alias("vid")) for k, v in enumerate(("v0", "v1", "v2"))])
    sent = faces.withColumn("_c", F.explode(corner)).select(*faces.columns, "_c.slot", F.col("_c.vid").alias("vid"))
    met = sent.join(vertices.select(mesh, "vid", *values), [mesh, "vid"])
    sides = [F.max(F.when(F.col("slot") == k, F.col(v))).alias(f"{name}{v}") for k, name in enumerate("abc") for v in values]
    # a bitmap instead of a distinct count, which would shuffle once more
    return met.groupBy(*faces.columns).agg(F.bit_or(F.expr("shiftleft(1, slot)")).alias("_n"), *sides).filter("_n = 7").drop("_n")


def broken_faces(faces: DataFrame, vertices: DataFrame, mesh: str = "mesh") -> DataFrame:
    """Faces that name a vertex which their mesh does not have."""
    corner = F.explode(F.array("v0", "v1", "v2")).alias("vid")
    lost = faces.select("*", corner).join(vertices.select(mesh, "vid"), [mesh, "vid"], "left_anti")
    return lost.select(*faces.columns).distinct()


def minus(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def corners() -> list[list[Column]]:
    """Column triples of the three gathered corners."""
    return [[F.col(f"{n}{a}") for a in AXES] for n in "abc"]


def with_normal(triangles: DataFrame) -> DataFrame:
    """Add the unit normal nx, ny, nz, the doubled area, and the plane offset nd.

    A degenerate triangle has no normal: zeros.
    """
    a, b, c = corners()
    n = cross(minus(b, a), minus(c, b))
    raw = triangles.withColumns({f"_n{ax}": v for ax, v in zip(AXES, n)})
    raw = raw.withColumn("area2", F.sqrt(F.col("_nx") ** 2 + F.col("_ny") ** 2 + F.col("_nz") ** 2))
    unit = {f"n{ax}": F.coalesce(F.try_divide(F.col(f"_n{ax}"), F.col("area2")), F.lit(0.0)) for ax in AXES}
    raw = raw.withColumns(unit).drop("_nx", "_ny", "_nz")
    return raw.withColumn("nd", -dot([F.col("nx"), F.col("ny"), F.col("nz")], a))


def quads_to_triangles(quads: DataFrame, keys: Sequence[str], split: str = "shape", corner_id: str = "id") -> DataFrame:
    """Two triangles per quad with corners c0..c3 (structs of id, x, y, z and, for weights, w).

    ``shape`` takes the diagonal whose two triangle normals agree most, measured on the
    unnormalised normals, the second diagonal on a tie; ``weight`` the one with the
    larger product of corner weights.
    """
    p = [[F.col(f"c{k}.{a}") for a in AXES] for k in range(4)]
    if split == "weight":
        first = F.col("c0.w") * F.col("c2.w") > F.col("c1.w") * F.col("c3.w")
    else:
        # fold of the strip (i, j, k, l): |n(i,j,k) . n(j,k,l)|
        def fold(i, j, k, m):
            return F.abs(dot(cross(minus(p[j], p[i]), minus(p[k], p[i])), cross(minus(p[k], p[j]), minus(p[m], p[j]))))

        first = fold(0, 1, 2, 0) > fold(0, 1, 3, 3)
    ids = [F.col(f"c{k}.{corner_id}") for k in range(4)]

    def tri(i, j, k):
        return F.struct(ids[i].alias("v0"), ids[j].alias("v1"), ids[k].alias("v2"))

    pair = F.when(first, F.array(tri(0, 1, 2), tri(0, 2, 3))).otherwise(F.array(tri(0, 1, 3), tri(3, 1, 2)))
    return quads.select(*keys, F.posexplode(pair).alias("half", "t")).select(*keys, "half", "t.*")


def quad_midpoints(quads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Middle vertex of each quad: the two diagonals' midpoints mixed by their weight products."""
    w02, w13 = F.col("c0.w") * F.col("c2.w"), F.col("c1.w") * F.col("c3.w")
    mid = [
        F.try_divide(
            w02 * (F.col(f"c0.{a}") + F.col(f"c2.{a}")) / 2 + w13 * (F.col(f"c1.{a}") + F.col(f"c3.{a}")) / 2, w02 + w13
        ).alias(a)
        for a in AXES
    ]
    return quads.select(*keys, *mid)


def training_mesh(cells: DataFrame, flags: Mapping[str, str], batch: str = "batch") -> tuple[DataFrame, DataFrame]:
    """Vertices (batch, id, x, y, z) and triangles (batch, v0, v1, v2) of a dual grid with four triangles around each quad's middle.

    ``cells`` has the dual vertex vx, vy, vz and the split weight w. A batch's cells are numbered in the order of their coordinates, and
    the middle vertices of its quads go on behind them in the order of the cell that owns the edge and of the axis.
    """
    numbered = stage(group_position(cells, [batch], list(AXES), "id"), "numbered")
    most = len(flags) * largest_group(numbered, [batch])  # a cell owns an edge an axis; counting the rings would make them twice
    rings = edge_quads(numbered, flags, ["id", "vx", "vy", "vz", "w"])
    named = [F.struct(F.col(f"c{k}.id"), *[F.col(f"c{k}.v{a}").alias(a) for a in AXES], F.col(f"c{k}.w")).alias(f"c{k}") for k in range(4)]
    rings = rings.select(batch, "axis", *[F.col(a).alias(f"_{a}") for a in AXES], *named)
    sizes = numbered.groupBy(batch).agg(F.count(F.lit(1)).alias("_cells"))
    placed = group_position(rings, [batch], [*[f"_{a}" for a in AXES], "axis"], "_k", most=most).join(sizes, batch).withColumn("id", F.col("_cells") + F.col("_k"))
    middles = quad_midpoints(placed, [batch, "id"])
    vertices = numbered.select(batch, "id", *[F.col(f"v{a}").alias(a) for a in AXES]).unionByName(middles)
    fan = F.array(*[F.struct(F.col(f"c{k}.id").alias("v0"), F.col(f"c{(k + 1) % 4}.id").alias("v1"), F.col("id").alias("v2")) for k in range(4)])
    return vertices, placed.select(batch, F.explode(fan).alias("t")).select(batch, "t.*")
