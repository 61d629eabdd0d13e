"""Curve keys, octrees, quantisation and delta codings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparcel.functions import curves, quant
from sparcel.operators import octree
from sparcel.operators.ordered import global_position, largest_group
from sparcel.plans.catalog import query
from sparcel.plans.cells import with_cells
from sparcel.session import stage
from sparcel.tables import CELL_KEYS, cells, load

POINTS_SQL = """points AS (SELECT CAST(l_partkey % 1024 AS INTEGER) AS x, CAST((l_suppkey * 7) % 1024 AS INTEGER) AS y,
  CAST(l_orderkey % 1024 AS INTEGER) AS z FROM lineitem)"""


def interleave_sql(x: str, y: str, z: str, bits: int) -> str:
    terms = [
        f"((CAST({c} AS BIGINT) >> {b}) & 1) * {1 << (3 * b + s)}" for b in range(bits) for c, s in ((x, 2), (y, 1), (z, 0))
    ]
    return "(" + " + ".join(terms) + ")"


def points(spark, d):
    return load(spark, d, "lineitem").select(
        F.expr("cast(l_partkey % 1024 as int)").alias("x"),
        F.expr("cast((l_suppkey * 7) % 1024 as int)").alias("y"),
        F.expr("cast(l_orderkey % 1024 as int)").alias("z"),
    )


# The curve visits the octants (x, y, z) of a cube in this order, and inside each of them it is the
# whole curve again, seen along axes taken in another order and some of them reversed.
OCTANTS = ["000", "001", "011", "010", "110", "111", "101", "100"]
INSIDE = [("zxy", "000"), ("yxz", "000"), ("xyz", "000"), ("zyx", "101"), ("zyx", "000"), ("xyz", "000"), ("yxz", "110"), ("zxy", "110")]


def hilbert_steps() -> list[int]:
    """For each view of the curve and each octant: 8 times the view inside it, plus the octant's place on the curve."""

    def seen(view: tuple[str, str], octant: str) -> str:
        return "".join("01"[octant["xyz".index(axis)] != turned] for axis, turned in zip(*view))

    def within(inner: tuple[str, str], outer: tuple[str, str]) -> tuple[str, str]:
        axes = [(outer[0]["xyz".index(axis)], "01"[outer[1]["xyz".index(axis)] != turned]) for axis, turned in zip(*inner)]
        return "".join(a for a, _ in axes), "".join(t for _, t in axes)

    views, steps = [("xyz", "000")], []
    for view in views:  # grows until every view has been met
        for octant in sorted(OCTANTS):
            place = OCTANTS.index(seen(view, octant))
            inner = within(INSIDE[place], view)
            if inner not in views:
                views.append(inner)
            steps.append(views.index(inner) * 8 + place)
    return steps


def hilbert_sql() -> str:
    """The recursive definition: octant by octant from the largest cube down, one subquery a level."""
    src = "(SELECT x, y, z, 0 AS step, CAST(0 AS BIGINT) AS code FROM points)"
    for level in range(9, -1, -1):
        octant = f"((x >> {level}) & 1) * 4 + ((y >> {level}) & 1) * 2 + ((z >> {level}) & 1)"
        src = f"(SELECT x, y, z, {hilbert_steps()}[(step >> 3) * 8 + {octant} + 1] AS step, code FROM {src})"
        src = f"(SELECT x, y, z, step, code * 8 + (step & 7) AS code FROM {src})"
    return f"WITH {POINTS_SQL} SELECT x, y, z, CAST(code AS BIGINT) AS hilbert FROM {src}"


@query("z_order_keys", "F1", f"WITH {POINTS_SQL} SELECT x, y, z, {interleave_sql('x', 'y', 'z', 10)} AS code FROM points")
def z_order_keys(spark, d):
    return points(spark, d).withColumn("code", curves.z_order(F.col("x"), F.col("y"), F.col("z")))


@query("z_order_round_trip", "F2", f"WITH {POINTS_SQL} SELECT x, y, z FROM points")
def z_order_round_trip(spark, d):
    coded = points(spark, d).select(curves.z_order(F.col("x"), F.col("y"), F.col("z")).alias("code"))
    return coded.select(*[c.alias(a) for a, c in zip("xyz", curves.from_z_order(F.col("code")))])


@query(
    "z_order_permuted",
    "F4",
    f"WITH {POINTS_SQL} SELECT x, y, z, {interleave_sql('z', 'y', 'x', 10)} AS code FROM points",
)
def z_order_permuted(spark, d):
    return points(spark, d).withColumn("code", curves.permuted(curves.z_order, (2, 1, 0)))


@query("hilbert_keys", "F3", hilbert_sql())
def hilbert_keys(spark, d):
    return curves.with_hilbert(points(spark, d))


@query("hilbert_round_trip", "F3", f"WITH {POINTS_SQL} SELECT x, y, z FROM points")
def hilbert_round_trip(spark, d):
    coded = curves.with_hilbert(points(spark, d)).select("hilbert")
    return curves.with_hilbert_position(coded).select("x", "y", "z")


@query(
    "curve_order_zip",
    "J10",
    with_cells(
        f""", a AS (SELECT batch, {interleave_sql('x', 'y', 'z', 10)} AS code, qty FROM cells),
        b AS (SELECT batch, {interleave_sql('x', 'y', 'z', 10)} AS code, price FROM cells WHERE disc > 0.02)
        SELECT a.batch, a.code, a.qty, b.price FROM a JOIN b ON a.batch = b.batch AND a.code = b.code"""
    ),
)
def curve_order_zip(spark, d):
    code = curves.z_order(F.col("x"), F.col("y"), F.col("z")).alias("code")
    table = cells(spark, d)
    return table.select("batch", code, "qty").join(
        table.filter("disc > 0.02").select("batch", code, "price"), ["batch", "code"]
    )


def coded_cells(spark, d):
    code = curves.z_order(F.col("x"), F.col("y"), F.col("z")).alias("code")
    return cells(spark, d, ["batch"]).select("batch", code, F.expr("cast(qty * 7 as bigint) % 256").cast("int").alias("value"))


CODED = f"coded AS (SELECT batch, {interleave_sql('x', 'y', 'z', 6)} AS code, CAST(CAST(qty * 7 AS BIGINT) % 256 AS INTEGER) AS value FROM cells)"
NODES = """nodes AS (SELECT batch, CAST(l.i AS INTEGER) AS level, code >> CAST(3 * (6 - l.i) AS INTEGER) AS prefix,
  CAST(bit_or(1 << CAST((code >> CAST(3 * (5 - l.i) AS INTEGER)) & 7 AS INTEGER)) AS INTEGER) AS children FROM coded, range(0, 6) l(i) GROUP BY 1, 2, 3)"""


@query(
    "octree_stream",
    "F5",
    with_cells(
        f""", {CODED}, {NODES} SELECT batch, level, prefix, children,
        row_number() OVER (PARTITION BY batch ORDER BY prefix << (3 * (6 - level)), level) - 1 AS "offset" FROM nodes"""
    ),
)
def octree_stream(spark, d):
    leaves = coded_cells(spark, d)
    return octree.node_stream(octree.octree_nodes(leaves, 6), 6, most=6 * largest_group(leaves, ["batch"]))


@query("octree_leaves", "F5", with_cells(f", {CODED} SELECT batch, code FROM coded"))
def octree_leaves(spark, d):
    return octree.node_leaves(octree.octree_nodes(coded_cells(spark, d), 6), 6)


@query(
    "parent_deltas",
    "F7",
    with_cells(
        f""", {CODED},
        v AS (SELECT batch, CAST(l.i AS INTEGER) AS level, code >> CAST(3 * (6 - l.i) AS INTEGER) AS prefix, arg_min(value, code) AS value FROM coded, range(0, 7) l(i) GROUP BY 1, 2, 3),
        s AS (SELECT *, lag(value) OVER (PARTITION BY batch, level, prefix >> 3 ORDER BY prefix) AS prev FROM v),
        k AS (SELECT batch, level, prefix, CASE WHEN level = 0 THEN value ELSE (value - prev + 256) % 256 END AS delta,
              CASE WHEN level = 0 THEN -1 ELSE (prefix >> 3) << (3 * (7 - level)) END AS parent FROM s WHERE level = 0 OR prev IS NOT NULL)
        SELECT batch, level, prefix, CAST(delta AS INTEGER) AS delta, row_number() OVER (PARTITION BY batch ORDER BY parent, level, prefix) - 1 AS slot FROM k"""
    ),
)
def parent_deltas(spark, d):
    return octree.parent_deltas(coded_cells(spark, d), 6, "value")


@query("parent_delta_round_trip", "F7", with_cells(f", {CODED} SELECT batch, code, value FROM coded"))
def parent_delta_round_trip(spark, d):
    coded = coded_cells(spark, d)
    deltas = stage(octree.parent_deltas(coded, 6, "value"), "deltas")
    nodes = stage(octree.octree_nodes(coded, 6), "nodes")
    return octree.from_parent_deltas(nodes, deltas, 6)


BYTES = "bytes AS (SELECT batch, x, y, z, CAST(CAST(qty * 7 AS BIGINT) % 256 AS INTEGER) AS v0, CAST(CAST(floor(price) AS BIGINT) % 256 AS INTEGER) AS v1 FROM cells)"


def byte_cells(spark, d):
    return cells(spark, d, ["batch"]).select(
        *CELL_KEYS,
        F.expr("cast(cast(qty * 7 as bigint) % 256 as int)").alias("v0"),
        F.expr("cast(cast(floor(price) as bigint) % 256 as int)").alias("v1"),
    )


@query(
    "neighbor_deltas",
    "F6",
    with_cells(
        f""", {BYTES}, o(dx, dy, dz, rank) AS (VALUES (1,0,0,1), (0,1,0,2), (0,0,1,3), (1,1,0,4), (1,0,1,5), (0,1,1,6), (1,1,1,7)),
        r AS (SELECT a.batch, a.x, a.y, a.z, max(rank) AS rank, arg_max(b.v0, rank) AS r0, arg_max(b.v1, rank) AS r1
              FROM bytes a, o, bytes b WHERE b.batch = a.batch AND b.x = a.x - dx AND b.y = a.y - dy AND b.z = a.z - dz
              AND (dx = 0 OR a.x % 32 > 0) AND (dy = 0 OR a.y % 32 > 0) AND (dz = 0 OR a.z % 32 > 0) GROUP BY 1, 2, 3, 4)
        SELECT a.batch, a.x, a.y, a.z, coalesce(r.rank, 0) AS reference, CAST((v0 - coalesce(r0, 0) + 256) % 256 AS INTEGER) AS v0,
               CAST((v1 - coalesce(r1, 0) + 256) % 256 AS INTEGER) AS v1
        FROM bytes a LEFT JOIN r ON a.batch = r.batch AND a.x = r.x AND a.y = r.y AND a.z = r.z"""
    ),
)
def neighbor_deltas(spark, d):
    return octree.neighbor_deltas(byte_cells(spark, d), ["v0", "v1"], 32)


@query("neighbor_delta_round_trip", "F6", with_cells(f", {BYTES} SELECT * FROM bytes"))
def neighbor_delta_round_trip(spark, d):
    deltas = octree.neighbor_deltas(byte_cells(spark, d), ["v0", "v1"], 32)
    return octree.from_neighbor_deltas(deltas, ["v0", "v1"], 32)


@query(
    "quantize_vectors",
    "F8",
    """
    SELECT vec_id, CAST(i - 1 AS INTEGER) AS channel, CAST(floor(greatest(least(CAST(embedding[i] AS DOUBLE) * 2, 1), 0) * 255) AS INTEGER) AS byte,
           round(floor(greatest(least(CAST(embedding[i] AS DOUBLE) * 2, 1), 0) * 255) / 255.0::DOUBLE * 2 - 1, 9) AS back
    FROM embeddings, range(1, 65) r(i)
    """,
)
def quantize_vectors(spark, d):
    values = load(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("channel", "v"))
    byte = quant.to_byte(F.col("v").cast("double") * 2)
    return values.select("vec_id", "channel", byte.alias("byte")).withColumn(
        "back", F.round(quant.signed_from_byte(F.col("byte")), 9)
    )


@query(
    "flag_packing",
    "F9",
    """
    SELECT l_orderkey, l_linenumber, CAST((l_returnflag = 'R')::INTEGER + 2 * (l_linestatus = 'O')::INTEGER + 4 * (l_discount > 0.05)::INTEGER AS INTEGER) AS packed,
           l_returnflag = 'R' AS a, l_linestatus = 'O' AS b, l_discount > 0.05 AS c FROM lineitem
    """,
)
def flag_packing(spark, d):
    packed = quant.pack_flags(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_discount") > 0.05)
    items = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", packed.alias("packed"))
    return items.withColumns({n: quant.unpack_flag(F.col("packed"), i) for i, n in enumerate("abc")})


@query(
    "coordinate_rescale",
    "F11 F25",
    """
    SELECT p_partkey, CAST(floor((p_partkey % 512 + 0.5::DOUBLE) / 512 * 72) AS INTEGER) AS c,
           CAST(CASE WHEN p_size - pow(2, floor(log2(p_size))) < pow(2, floor(log2(p_size)) + 1) - p_size THEN pow(2, floor(log2(p_size)))
                ELSE pow(2, floor(log2(p_size)) + 1) END AS BIGINT) AS pot
    FROM part
    """,
)
def coordinate_rescale(spark, d):
    return load(spark, d, "part").select(
        "p_partkey",
        quant.rescale_coordinate(F.expr("p_partkey % 512"), 512, 1152).alias("c"),
        quant.nearest_power_of_two(F.col("p_size")).alias("pot"),
    )


@query(
    "curve_positions",
    "W7 F3",
    f"""WITH {POINTS_SQL}, u AS (SELECT DISTINCT {interleave_sql('x', 'y', 'z', 10)} AS code FROM points)
    SELECT code, row_number() OVER (ORDER BY code) - 1 AS pos FROM u""",
)
def curve_positions(spark, d):
    code = curves.z_order(F.col("x"), F.col("y"), F.col("z")).alias("code")
    return global_position(points(spark, d).select(code).distinct(), ["code"])


@query(
    "clustered_box_scan",
    "F1 S12",
    f"""WITH {POINTS_SQL}, c AS (SELECT x, y, z, {interleave_sql('x', 'y', 'z', 10)} AS code FROM points)
    SELECT * FROM c WHERE code >= 134217728 AND code < 268435456 AND x < 512 AND y < 512 AND z >= 512""",
)
def clustered_box_scan(spark, d):
    """Points laid out along the curve; a box becomes a key range that files and row groups are skipped by."""
    coded = points(spark, d).withColumn("code", curves.z_order(F.col("x"), F.col("y"), F.col("z")))
    laid = stage(curves.cluster_by(coded, "code"), "clustered")
    low, high = 1 << 27, 1 << 28
    return laid.filter((F.col("code") >= low) & (F.col("code") < high) & (F.col("x") < 512) & (F.col("y") < 512) & (F.col("z") >= 512))
