"""Sparse cell queries over the line-item cells."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from sparcel.operators import cells as C
from sparcel.operators.ordered import global_position
from sparcel.plans.catalog import query
from sparcel.session import staged_path
from sparcel.tables import CELL_KEYS, CELLS_SQL, cells, load

CHILD_SQL = "(x % 2 + 2 * (y % 2) + 4 * (z % 2))"
SIZES = {"x": 64, "y": 64, "z": 8}


def with_cells(body: str) -> str:
    return f"WITH {CELLS_SQL} {body}"


@query(
    "cell_pooling",
    "A5 A6 F10",
    with_cells(
        f"""SELECT batch, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, CAST(z // 2 AS INTEGER) AS z,
        round(avg(qty), 6) AS mean_qty, max(price) AS max_price, CAST(bit_or(1 << {CHILD_SQL}) AS INTEGER) AS occupancy
        FROM cells GROUP BY batch, x // 2, y // 2, z // 2"""
    ),
)
def cell_pooling(spark, d):
    return C.pool(
        cells(spark, d, ["batch"]), 2, {"mean_qty": F.round(F.avg("qty"), 6), "max_price": F.max("price")}, occupancy=True
    )


@query(
    "vector_pooling",
    "A5",
    """
    SELECT label, CAST(i - 1 AS INTEGER) AS channel, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean
    FROM embeddings, range(1, 65) r(i) GROUP BY label, i
    """,
)
def vector_pooling(spark, d):
    pooled = C.pool_vectors(load(spark, d, "embeddings"), ["label"], "embedding", 64)
    return pooled.select("label", F.posexplode("embedding").alias("channel", "mean")).withColumn(
        "mean", F.round("mean", 6)
    )


@query(
    "cell_expansion",
    "G1 A6",
    with_cells("SELECT batch, x, y, z, CAST(x % 2 + 2 * (y % 2) + 4 * (z % 2) AS INTEGER) AS child FROM cells"),
)
def cell_expansion(spark, d):
    """Pool, then expand by the occupancy bitmap: exactly the original cells come back."""
    pooled = C.pool(cells(spark, d, ["batch"]), 2, {"n": F.sum("n")}, occupancy=True)
    return C.expand(pooled, 2).select(*CELL_KEYS, "child")


@query(
    "space_to_channel",
    "A7",
    with_cells(
        "SELECT batch, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, CAST(z // 2 AS INTEGER) AS z, "
        + ", ".join(f"coalesce(max(qty) FILTER (WHERE {CHILD_SQL} = {k}), 0) AS q{k}" for k in range(8))
        + " FROM cells GROUP BY batch, x // 2, y // 2, z // 2"
    ),
)
def space_to_channel(spark, d):
    wide = C.space_to_channel(cells(spark, d, ["batch"]), 2, ["qty"])
    return wide.select(*CELL_KEYS, *[F.get("channels", F.lit(k)).alias(f"q{k}") for k in range(8)])


@query("channel_to_space", "G2 A7", with_cells("SELECT batch, x, y, z, qty, price FROM cells"))
def channel_to_space(spark, d):
    wide = C.space_to_channel(cells(spark, d, ["batch"]), 2, ["qty", "price"])
    back = C.channel_to_space(wide, 2, 2)
    return back.select(*CELL_KEYS, F.get("values", F.lit(0)).alias("qty"), F.get("values", F.lit(1)).alias("price"))


@query(
    "distinct_cell_ids",
    "A8 A9 F10",
    """
    SELECT cx, cy, cz, rank() OVER (ORDER BY cx, cy, cz) - 1 AS id FROM (
      SELECT DISTINCT l_partkey // 8 AS cx, l_suppkey // 8 AS cy, l_orderkey // 64 AS cz FROM lineitem)
    """,
)
def distinct_cell_ids(spark, d):
    chunk = load(spark, d, "lineitem").select(
        F.expr("l_partkey div 8").alias("cx"), F.expr("l_suppkey div 8").alias("cy"), F.expr("l_orderkey div 64").alias("cz")
    )
    return C.dense_ids(chunk, ["cx", "cy", "cz"])


@query(
    "inverse_index",
    "A9",
    """
    WITH u AS (SELECT c_nationkey, c_mktsegment, rank() OVER (ORDER BY c_nationkey, c_mktsegment) - 1 AS id
               FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer))
    SELECT c_custkey, id FROM customer JOIN u USING (c_nationkey, c_mktsegment)
    """,
)
def inverse_index(spark, d):
    customers = load(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    keys = ["c_nationkey", "c_mktsegment"]
    return customers.join(C.dense_ids(customers, keys), keys).select("c_custkey", "id")


@query(
    "flat_index_round_trip",
    "F10",
    with_cells("SELECT batch, x, y, z, (CAST(batch AS BIGINT) * 64 + x) * 512 + y * 8 + z AS code FROM cells"),
)
def flat_index_round_trip(spark, d):
    coded = cells(spark, d).select(C.flat_index(SIZES).alias("code"))
    return coded.select(*[c.alias(n) for n, c in C.from_flat_index(F.col("code"), SIZES).items()], "code")


@query(
    "coordinate_lookup",
    "J6",
    with_cells(
        """, probes AS (SELECT DISTINCT CAST(l_orderkey // 2000 AS INTEGER) AS batch, CAST(l_partkey % 80 AS INTEGER) AS x,
            CAST(l_suppkey % 80 AS INTEGER) AS y, l_linenumber AS z FROM lineitem)
        SELECT p.batch, p.x, p.y, p.z, c.qty FROM probes p LEFT JOIN cells c
          ON p.batch = c.batch AND p.x = c.x AND p.y = c.y AND p.z = c.z"""
    ),
)
def coordinate_lookup(spark, d):
    probes = load(spark, d, "lineitem").select(
        F.expr("cast(l_orderkey div 2000 as int)").alias("batch"),
        F.expr("cast(l_partkey % 80 as int)").alias("x"),
        F.expr("cast(l_suppkey % 80 as int)").alias("y"),
        F.col("l_linenumber").alias("z"),
    ).distinct()
    return C.lookup(cells(spark, d), probes, "qty")


@query(
    "neighbor_join",
    "J7",
    with_cells(
        """SELECT a.batch, a.x, a.y, a.z, a.qty, o.dx, o.dy, o.dz, b.qty AS neighbor
        FROM cells a, (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1)) o(dx, dy, dz), cells b
        WHERE b.batch = a.batch AND b.x = a.x + o.dx AND b.y = a.y + o.dy AND b.z = a.z + o.dz"""
    ),
)
def neighbor_join(spark, d):
    table = cells(spark, d).select(*CELL_KEYS, "qty")
    return C.neighbors(table, [(1, 0, 0), (0, 1, 0), (0, 0, 1)], "qty")


def _ring_sql(axis: str, flag: str, payload: str, out: str) -> str:
    joins = ""
    for k, offset in enumerate(C.EDGE_RING[axis][1:], 1):
        on = " AND ".join(f"c{k}.{a} = c0.{a} + {o}" for a, o in zip("xyz", offset))
        joins += f" JOIN cells c{k} ON c{k}.batch = c0.batch AND {on}"
    cols = ", ".join(f"c{k}.{payload} AS {out}{k}" for k in range(4))
    return f"SELECT c0.batch, '{axis}' AS axis, c0.x, c0.y, c0.z, {cols} FROM cells c0{joins} WHERE c0.{flag} = 1"


QUADS_SQL = ", quads AS (" + " UNION ALL ".join(
    _ring_sql(axis, flag, "qty", "q") for axis, flag in (("x", "fa"), ("y", "fb"), ("z", "fc"))
) + ") "


@query("edge_quads", "J7 G5", with_cells(QUADS_SQL + "SELECT * FROM quads"))
def edge_quads(spark, d):
    flagged = cells(spark, d).withColumns({f: F.col(f) == 1 for f in ("fa", "fb", "fc")})
    quads = C.edge_quads(flagged, {"x": "fa", "y": "fb", "z": "fc"}, ["qty"])
    return quads.select("batch", "axis", "x", "y", "z", *[F.col(f"c{k}.qty").alias(f"q{k}") for k in range(4)])


@query(
    "trilinear_sample",
    "J8 M10",
    with_cells(
        """, pts AS (SELECT o_orderkey AS pid, CAST(o_orderkey // 2000 AS INTEGER) AS batch, (o_custkey % 443) / 7.3::DOUBLE AS px,
            (o_orderkey % 443) / 7.3::DOUBLE AS py, 0.5::DOUBLE + (o_orderkey % 52) / 7.3::DOUBLE AS pz FROM orders),
        b AS (SELECT *, CAST(floor(px - 0.5) AS INTEGER) AS bx, CAST(floor(py - 0.5) AS INTEGER) AS by_, CAST(floor(pz - 0.5) AS INTEGER) AS bz FROM pts),
        k AS (SELECT pid, batch, bx + i AS x, by_ + j AS y, bz + l AS z,
            (CASE WHEN i = 1 THEN px - 0.5 - bx ELSE 1 - (px - 0.5 - bx) END) * (CASE WHEN j = 1 THEN py - 0.5 - by_ ELSE 1 - (py - 0.5 - by_) END)
            * (CASE WHEN l = 1 THEN pz - 0.5 - bz ELSE 1 - (pz - 0.5 - bz) END) AS w
            FROM b, range(2) a(i), range(2) c(j), range(2) e(l))
        SELECT k.pid, round(sum(w * qty) / nullif(sum(w) FILTER (WHERE qty IS NOT NULL), 0), 6) AS qty,
               round(sum(w * price) / nullif(sum(w) FILTER (WHERE qty IS NOT NULL), 0), 4) AS price, count(qty) AS corners
        FROM k LEFT JOIN cells c ON k.batch = c.batch AND k.x = c.x AND k.y = c.y AND k.z = c.z GROUP BY k.pid"""
    ),
)
def trilinear_sample(spark, d):
    points = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("pid"),
        F.expr("cast(o_orderkey div 2000 as int)").alias("batch"),
        F.expr("(o_custkey % 443) / 7.3D").alias("px"),
        F.expr("(o_orderkey % 443) / 7.3D").alias("py"),
        F.expr("0.5D + (o_orderkey % 52) / 7.3D").alias("pz"),
    )
    sampled = C.trilinear(points, cells(spark, d), ["qty", "price"], ["pid"])
    return sampled.withColumn("qty", F.round("qty", 6)).withColumn("price", F.round("price", 4))


@query(
    "aligned_join",
    "J9 J10",
    with_cells(
        """, other AS (SELECT batch, x, y, z, price FROM cells WHERE n < 3)
        SELECT c.batch, c.x, c.y, c.z, c.qty, o.price, o.price IS NOT NULL AS aligned
        FROM cells c LEFT JOIN other o ON c.batch = o.batch AND c.x = o.x AND c.y = o.y AND c.z = o.z"""
    ),
)
def aligned_join(spark, d):
    table = cells(spark, d)
    return C.aligned(table.select(*CELL_KEYS, "qty"), table.filter("n < 3"), ["price"])


@query(
    "batch_broadcast",
    "J11 F27",
    with_cells(
        """SELECT c.batch, x, y, z, round(qty / total, 9) AS share FROM cells c
        JOIN (SELECT batch, sum(qty) AS total FROM cells GROUP BY batch) t ON c.batch = t.batch"""
    ),
)
def batch_broadcast(spark, d):
    table = cells(spark, d)
    totals = table.groupBy("batch").agg(F.sum("qty").alias("total"))
    return table.join(totals, "batch").select(*CELL_KEYS, F.round(F.col("qty") / F.col("total"), 9).alias("share"))


@query(
    "batch_layout",
    "W2 A12 M5",
    with_cells(
        """SELECT batch, len, CAST(sum(len) OVER (ORDER BY batch) AS BIGINT) - len AS start, CAST(sum(len) OVER (ORDER BY batch) AS BIGINT) AS stop
        FROM (SELECT batch, count(*) AS len FROM cells GROUP BY batch)"""
    ),
)
def batch_layout(spark, d):
    return C.batch_layout(cells(spark, d))


@query(
    "order_layout",
    "W2",
    """
    SELECT o_custkey, len, CAST(sum(len) OVER (ORDER BY o_custkey) AS BIGINT) - len AS start, CAST(sum(len) OVER (ORDER BY o_custkey) AS BIGINT) AS stop
    FROM (SELECT o_custkey, count(*) AS len FROM orders GROUP BY o_custkey)
    """,
)
def order_layout(spark, d):
    return C.batch_layout(load(spark, d, "orders"), "o_custkey")


@query(
    "padded_turns",
    "W3",
    """
    WITH t AS (SELECT conv_id, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
    m AS (SELECT max(pos) + 1 AS len FROM t),
    g AS (SELECT c.conv_id, p.pos FROM (SELECT DISTINCT conv_id FROM conversations) c, m, range(0, 10000) p(pos) WHERE p.pos < m.len)
    SELECT g.conv_id, CAST(g.pos AS INTEGER) AS pos, CAST(t.chars AS INTEGER) AS chars, t.pos IS NOT NULL AS mask
    FROM g LEFT JOIN t ON g.conv_id = t.conv_id AND g.pos = t.pos
    """,
)
def padded_turns(spark, d):
    turns = load(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    return C.to_padded(turns, "conv_id", ["turn"], "chars")


@query(
    "dense_grid",
    "W4 W5",
    with_cells(
        """SELECT b.batch, CAST(gx.i AS INTEGER) AS x, CAST(gy.i AS INTEGER) AS y, CAST(gz.i AS INTEGER) AS z, coalesce(c.qty, 0) AS qty
        FROM (SELECT DISTINCT batch FROM cells) b, range(0, 32) gx(i), range(0, 16) gy(i), range(1, 8) gz(i)
        LEFT JOIN (SELECT batch, x // 2 AS x, y // 4 AS y, z, sum(qty) AS qty FROM cells GROUP BY 1, 2, 3, 4) c
          ON c.batch = b.batch AND c.x = gx.i AND c.y = gy.i AND c.z = gz.i"""
    ),
)
def dense_grid(spark, d):
    table = cells(spark, d, ["batch"])
    rough = table.groupBy(
        "batch", C.floor_div(F.col("x"), 2).alias("x"), C.floor_div(F.col("y"), 4).alias("y"), "z"
    ).agg(F.sum("qty").alias("qty"))
    box = C.grid(spark, (0, 0, 1), (31, 15, 7), table.select("batch").distinct())
    return C.densify(rough, box, ["qty"])


@query(
    "sparse_from_dense",
    "W4 A18",
    with_cells(
        """SELECT DISTINCT batch, CAST(x // 2 AS INTEGER) AS x, CAST(y // 4 AS INTEGER) AS y, z FROM cells WHERE qty > 0.5"""
    ),
)
def sparse_from_dense(spark, d):
    return C.sparsify(dense_grid(spark, d), F.col("qty") > 0.5).select(*CELL_KEYS)


@query(
    "occupancy_max_pool",
    "A18",
    with_cells(
        """SELECT DISTINCT batch, CAST(x // 4 AS INTEGER) AS x, CAST(y // 4 AS INTEGER) AS y, CAST(z // 4 AS INTEGER) AS z
        FROM cells WHERE disc > 0.05"""
    ),
)
def occupancy_max_pool(spark, d):
    return C.coarse(cells(spark, d).filter("disc > 0.05").select(*CELL_KEYS), 4).distinct()


@query(
    "window_sequence_lengths",
    "W6 A12",
    with_cells(
        """SELECT ((CAST(batch AS BIGINT) * 17 + (x + 2) // 4) * 17 + (y + 2) // 4) * 3 + (z + 2) // 4 AS "window", count(*) AS len
        FROM cells GROUP BY 1"""
    ),
)
def window_sequence_lengths(spark, d):
    placed = C.window_partition(cells(spark, d), 4, 2, SIZES)
    return placed.groupBy("window").agg(F.count(F.lit(1)).alias("len"))


@query(
    "window_permutation",
    "W6 W7",
    with_cells(
        """, w AS (SELECT batch, x, y, z, ((CAST(batch AS BIGINT) * 17 + (x + 2) // 4) * 17 + (y + 2) // 4) * 3 + (z + 2) // 4 AS win FROM cells)
        SELECT row_number() OVER (ORDER BY batch, x, y, z) - 1 AS src, row_number() OVER (ORDER BY win, batch, x, y, z) - 1 AS dst FROM w"""
    ),
)
def window_permutation(spark, d):
    """Forward and backward permutation between cell order and window order."""
    numbered = global_position(cells(spark, d).select(*CELL_KEYS), CELL_KEYS, "src")
    placed = C.window_partition(numbered, 4, 2, SIZES)
    return global_position(placed, ["window", *CELL_KEYS], "dst").select("src", "dst")


@query(
    "batch_concat",
    "U2",
    """
    WITH a AS (SELECT DISTINCT CAST(o_orderkey // 2000 AS INTEGER) AS batch, CAST(o_custkey % 64 AS INTEGER) AS x FROM orders),
         b AS (SELECT DISTINCT CAST(l_orderkey // 4000 AS INTEGER) AS batch, CAST(l_suppkey % 64 AS INTEGER) AS x FROM lineitem)
    SELECT batch, x FROM a UNION ALL SELECT batch + (SELECT max(batch) + 1 FROM a), x FROM b
    """,
)
def batch_concat(spark, d):
    a = load(spark, d, "orders").select(
        F.expr("cast(o_orderkey div 2000 as int)").alias("batch"), F.expr("cast(o_custkey % 64 as int)").alias("x")
    ).distinct()
    b = load(spark, d, "lineitem").select(
        F.expr("cast(l_orderkey div 4000 as int)").alias("batch"), F.expr("cast(l_suppkey % 64 as int)").alias("x")
    ).distinct()
    return C.concat_batches([a, b])


@query(
    "feature_concat",
    "U3",
    with_cells("SELECT batch, x, y, z, qty AS f0, price AS f1, disc AS f2 FROM cells"),
)
def feature_concat(spark, d):
    table = cells(spark, d)
    left = table.select(*CELL_KEYS, F.array("qty").alias("feats"))
    right = table.select(*CELL_KEYS, F.array("price", "disc").alias("feats"))
    both = C.concat_features(left, right)
    return both.select(*CELL_KEYS, *[F.get("feats", F.lit(i)).alias(f"f{i}") for i in range(3)])


@query(
    "batch_selection",
    "U4",
    with_cells(
        """SELECT CAST(w.new AS INTEGER) AS batch, x, y, z, qty FROM cells c JOIN (
          SELECT batch AS old, 2 * batch AS new FROM cells GROUP BY batch UNION ALL SELECT batch, 2 * batch + 1 FROM cells GROUP BY batch) w
        ON c.batch = w.old"""
    ),
)
def batch_selection(spark, d):
    table = cells(spark, d).select(*CELL_KEYS, "qty")
    ids = table.select(F.col("batch").alias("old")).distinct()
    wanted = ids.select("old", F.explode(F.array(F.col("old") * 2, F.col("old") * 2 + 1)).alias("new"))
    return C.pick_batches(table, wanted)


@query(
    "resolution_search",
    "W16 F11 A8",
    """
    WITH pos AS (SELECT CAST(l_orderkey % 8 AS INTEGER) AS batch, (l_partkey % 512 + 0.5::DOUBLE) / 512 AS px, (l_suppkey % 512 + 0.5::DOUBLE) / 512 AS py, (l_linenumber + 0.5::DOUBLE) / 512 AS pz FROM lineitem),
    c AS (SELECT r.res, count(DISTINCT (CAST(floor(px * (r.res // 16)) AS INTEGER), CAST(floor(py * (r.res // 16)) AS INTEGER), CAST(floor(pz * (r.res // 16)) AS INTEGER))) AS n
          FROM pos, (VALUES (1024), (1152), (1280), (1408), (1536)) r(res) GROUP BY r.res)
    SELECT CAST(res AS INTEGER) AS res, n FROM c WHERE res = coalesce((SELECT max(res) FROM c WHERE n < 1500), 1024)
    """,
)
def resolution_search(spark, d):
    """Highest resolution (in steps of 128, at least 1024) whose cell count stays below the budget.

    Cells are reduced to the finest distinct positions first, so candidates multiply
    distinct cells only, and each candidate deduplicates per cell key.
    """
    fine = load(spark, d, "lineitem").select(
        F.expr("cast(l_partkey % 512 as int)").alias("x"),
        F.expr("cast(l_suppkey % 512 as int)").alias("y"),
        F.col("l_linenumber").alias("z"),
    ).distinct()
    candidates = fine.withColumn("res", F.explode(F.array(*[F.lit(r) for r in range(1024, 1537, 128)])))
    moved = {a: F.floor((F.col(a) + 0.5) / 512 * F.expr("res div 16")).cast("int") for a in ("x", "y", "z")}
    counts = candidates.withColumns(moved).distinct().groupBy("res").agg(F.count(F.lit(1)).alias("n"))
    fits = F.when(F.col("n") < 1500, F.col("res"))
    best = counts.agg(
        F.max_by("n", F.coalesce(fits, F.when(F.col("res") == 1024, 0))).alias("n"),
        F.coalesce(F.max(fits), F.lit(1024)).alias("res"),
    )
    return best.select("res", "n")


@query(
    "cell_centers",
    "F12 F13 P17 M7",
    with_cells(
        """SELECT batch, x, y, z, round((x + 0.5) / 64 - 0.5, 9) AS px, round((y + 0.5) / 64 - 0.5, 9) AS py, round((z + 0.5) / 64 - 0.5, 9) AS pz,
        price AS a0, disc AS a1 FROM cells"""
    ),
)
def cell_centers(spark, d):
    """Cell center positions in a unit box, and one attribute cut out of the packed channels by its layout."""
    from sparcel.functions.layout import cell_position, channel_layout, channels_of

    layout = channel_layout([("qty", 1), ("look", 2)])
    table = cells(spark, d).withColumn("attrs", F.array("qty", "price", "disc"))
    look = channels_of("attrs", layout, "look")
    return table.select(
        *CELL_KEYS,
        *[F.round(cell_position(F.col(a), 1 / 64, -0.5), 9).alias(f"p{a}") for a in ("x", "y", "z")],
        F.get(look, F.lit(0)).alias("a0"),
        F.get(look, F.lit(1)).alias("a1"),
    )


@query(
    "batch_lengths",
    "A12",
    """SELECT c_custkey, count(o_orderkey) AS len FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""",
)
def batch_lengths(spark, d):
    """Lengths by batch, empty batches included."""
    orders = load(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return C.batch_lengths(orders, load(spark, d, "customer"), "c_custkey")


@query(
    "grid_geometry",
    "F13 S26",
    with_cells(
        """, e AS (SELECT batch, max(x) AS hx, max(y) AS hy, max(z) AS hz FROM cells GROUP BY batch)
        SELECT batch, CAST(ceil((hx + 1) / 2.5::DOUBLE) AS INTEGER) AS nx, CAST(ceil((hy + 1) / 2.5::DOUBLE) AS INTEGER) AS ny, CAST(ceil((hz + 1) / 2.5::DOUBLE) AS INTEGER) AS nz,
          round(-(ceil((hx + 1) / 2.5::DOUBLE) * 2.5 - (hx + 1)) / 2, 9) AS x0 FROM e"""
    ),
)
def grid_geometry(spark, d):
    """Grid of whole voxels around each batch's box; the voxel size comes from a small file that all tasks share."""
    from sparcel.functions.layout import grid_geometry as geometry
    from sparcel.sources.files import broadcast_file

    path = staged_path(spark, "side")
    spark.range(1).select(F.lit('{"voxel_size": 2.5}').alias("value")).coalesce(1).write.text(path)
    name = spark.read.text(path).select(F.col("_metadata.file_path")).first()[0]
    side = broadcast_file(spark, name)
    boxes = cells(spark, d).groupBy("batch").agg(*[F.max(a).alias(f"h{a}") for a in "xyz"])

    def run(parts):
        size = json.loads(side.value)["voxel_size"]
        for pdf in parts:
            found = [geometry([0.0] * 3, [r.hx + 1.0, r.hy + 1.0, r.hz + 1.0], voxel_size=size, fit=True) for r in pdf.itertuples()]
            yield pd.DataFrame({"batch": pdf["batch"], **{f"n{a}": [g["grid_size"][i] for g in found] for i, a in enumerate("xyz")}, "x0": [round(g["lower"][0], 9) for g in found]})

    return boxes.mapInPandas(run, "batch int, nx int, ny int, nz int, x0 double")
