"""Small cases with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sparcel.functions import curves, nulls, quant, sampling
from sparcel.functions.layout import channel_layout, grid_geometry
from sparcel.operators import cells as C
from sparcel.operators import mesh as M
from sparcel.operators import texture
from sparcel.operators.overlay import compact, overlay, overlay_all
from sparcel.operators.sharding import balanced_groups, contiguous_shards
from tests.conftest import rows


def test_null_truth(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, f boolean")
    got = rows(df.select("id", nulls.is_true(F.col("f")), nulls.not_true(F.col("f"))))
    assert got == [(1, True, False), (2, False, True), (3, False, True)]


def test_overlay(spark):
    left = spark.createDataFrame([("a", 1, None), ("b", None, 5)], "k string, z int, m int")
    right = spark.createDataFrame([("b", 9, 3, 8), ("c", 7, 4, None)], "k string, m int, c int, z int")
    expected = [("a", None, None, 1), ("b", 3, 5, 8), ("c", 4, 7, None)]
    out = overlay(left, right, ["k"])
    assert out.columns == ["k", "c", "m", "z"]
    assert rows(out) == expected
    assert rows(overlay_all([left, right], ["k"])) == expected


def test_overlay_treats_nan_as_missing(spark):
    left = spark.createDataFrame([("a", float("nan"))], "k string, v double")
    right = spark.createDataFrame([("a", 2.0)], "k string, v double")
    assert rows(overlay(left, right, ["k"])) == [("a", 2.0)]
    assert rows(overlay_all([left, right], ["k"])) == [("a", 2.0)]


def test_compact_keeps_older_value_under_newer_null(spark):
    log = spark.createDataFrame([("a", 1, 10, None), ("a", 2, None, 7)], "k string, seq int, u int, v int")
    assert rows(compact(log, ["k"], ["seq"])) == [("a", 10, 7)]


def test_shards(spark):
    out = contiguous_shards(spark.range(10), ["id"], 3)
    sizes = [r["count"] for r in out.groupBy("shard").count().orderBy("shard").collect()]
    assert sizes == [3, 3, 4]
    assert rows(out.select("id")) == rows(spark.range(10))


def test_lpt(spark):
    loads = [8, 7, 6, 5, 4, 3, 3, 2]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(loads)], "w int, i int, v int")
    out = balanced_groups(df, ["w"], "v", "i", 3, 8)
    totals = sorted((r["s"] for r in out.groupBy("grp").agg(F.sum("v").alias("s")).collect()), reverse=True)
    assert totals == [14, 13, 11]


CURVE_POINTS = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1), (5, 9, 3), (1023, 1023, 1023)]


def test_z_order(spark):
    df = spark.createDataFrame(CURVE_POINTS, "x int, y int, z int")
    got = [r[0] for r in df.select(curves.z_order(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert got[1:4] == [4, 2, 1] and got[-1] == 2**30 - 1


def test_hilbert(spark):
    df = spark.createDataFrame(CURVE_POINTS, "x int, y int, z int")
    got = [r["hilbert"] for r in curves.with_hilbert(df).collect()]
    assert got == [0, 7, 3, 1, 5, 2011, 766958445]


def test_pool_and_expand_full_block(spark):
    block = spark.createDataFrame([(0, x, y, z) for x in (2, 3) for y in (4, 5) for z in (0, 1)], "batch int, x int, y int, z int")
    pooled = C.pool(block, 2, {"n": F.count(F.lit(1))}, occupancy=True)
    assert rows(pooled) == [(0, 1, 2, 0, 8, 255)]
    assert rows(C.expand(pooled, 2).select(*block.columns)) == rows(block)


def test_child_index(spark):
    df = spark.createDataFrame([(1, 0, 0), (0, 1, 0), (0, 0, 1), (-1, 0, 0)], "x int, y int, z int")
    assert [r[0] for r in df.select(C.child_index(2)).collect()] == [1, 2, 4, 1]


def test_window_of_negative_coordinate_floors(spark):
    df = spark.createDataFrame([(-3,)], "x int")
    assert df.select(C.floor_div(F.col("x"), 2)).first()[0] == -2


def test_flags(spark):
    df = spark.createDataFrame([(True, False, True)], "a boolean, b boolean, c boolean")
    assert df.select(quant.pack_flags(F.col("a"), F.col("b"), F.col("c"))).first()[0] == 5


def test_quantise_clamps_and_truncates(spark):
    df = spark.createDataFrame([(-0.2,), (0.999,), (1.7,)], "v double")
    assert [r[0] for r in df.select(quant.to_byte(F.col("v"))).collect()] == [0, 254, 255]


# fixed values: an axis-aligned cube, outward faces
CUBE = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def faces_of(spark, tris):
    return spark.createDataFrame([("m", i, *t) for i, t in enumerate(tris)], "mesh string, fid int, v0 int, v1 int, v2 int")


def test_edges(spark):
    closed = M.edge_counts(faces_of(spark, CUBE))
    assert closed.count() == 18 and closed.filter("faces = 1").count() == 0
    quad = M.edge_counts(faces_of(spark, [(0, 1, 2), (0, 2, 3)]))
    assert quad.count() == 5 and quad.filter("faces = 1").count() == 4


def test_normalize(spark):
    v = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0), ("m", 1, 2.0, 1.0, 1.0)], "mesh string, vid int, x double, y double, z double")
    assert M.boxes(v).first()["scale"] == pytest.approx(0.99999 / 2)
    for r in M.normalize(v).collect():
        assert all(-0.5 <= r[a] <= 0.5 for a in "xyz")


def test_power_of_two(spark):
    df = spark.createDataFrame([(n,) for n in (1, 3, 5, 6, 7)], "n int")
    assert [r[0] for r in df.select(quant.nearest_power_of_two(F.col("n"))).collect()] == [1, 4, 4, 8, 8]


def test_wrap(spark):
    df = spark.createDataFrame([("REPEAT",), ("CLAMP",), ("MIRROR",)], "m string")
    got = [r[0] for r in df.select(texture.wrapped(F.lit(-1), F.lit(4), F.col("m"))).collect()]
    assert got == [3, 0, 0]


def test_alpha_modes(spark):
    df = spark.createDataFrame([("OPAQUE", 0.2), ("MASK", 0.2), ("MASK", 0.7), ("BLEND", 0.2)], "m string, a double")
    assert [r[0] for r in df.select(texture.effective_alpha(F.col("m"), F.col("a"), F.lit(0.5))).collect()] == [1.0, 0.0, 1.0, 0.2]


def test_pyramid_drops_fractions(spark):
    texels = spark.createDataFrame([(0, x, y, v, v, v) for (x, y), v in {(0, 0): 1, (1, 0): 2, (0, 1): 2, (1, 1): 2}.items()], "tex int, tx int, ty int, r int, g int, b int")
    top = texture.pyramid(texels, 2).filter("level = 1").first()
    assert (top["r"], top["tx"], top["ty"]) == (1, 0, 0)
    with pytest.raises(ValueError):
        texture.pyramid(texels, 3)


def test_radical_inverse(spark):
    df = spark.createDataFrame([(6,)], "n int")
    assert df.select(sampling.radical_inverse(F.col("n"), 2)).first()[0] == 0.375
    assert df.select(sampling.radical_inverse(F.col("n"), 3)).first()[0] == pytest.approx(2 / 9)


def test_grid_geometry():
    assert grid_geometry((0, 0, 0), (1, 1, 1), grid_size=4)["voxel_size"] == [0.25] * 3
    fit = grid_geometry((0, 0, 0), (1, 1, 1), voxel_size=0.4, fit=True)
    assert fit["grid_size"] == [3] * 3 and fit["upper"][0] - fit["lower"][0] == pytest.approx(1.2)
    assert grid_geometry((0, 0, 0), (1, 1, 1), grid_size=5, fit=True)["upper"][0] == pytest.approx(1.125)
    assert channel_layout([("a", 3), ("b", 1)]) == {"a": (0, 3), "b": (3, 1)}
