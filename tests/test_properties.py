"""Operators against brute force on small random input, hot keys included."""

import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparcel.functions import curves
from sparcel.operators import cells as C
from sparcel.operators import mesh as M
from sparcel.operators import octree, ordered, texture, voxelize
from sparcel.operators.ordered import global_position, group_position, running, trailing
from sparcel.operators.sharding import balanced_epoch, balanced_groups, epoch_order
from tests.conftest import rows


@pytest.fixture(scope="module")
def hot(spark):
    """1,200 rows of which two thirds share one group, and some groups are NULL."""
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.66 else rng.choice(["a", "b", None]), i, rng.randrange(100)) for i in range(1200)]
    return data, spark.createDataFrame(data, "g string, i int, v int").repartition(5)


def test_running_sums_span_slices(hot, monkeypatch):
    monkeypatch.setattr(ordered, "WINDOW_ROWS", 0)
    data, df = hot
    expected, totals = [], {}
    for g, i, v in sorted(data, key=lambda r: r[1]):
        totals[g] = totals.get(g, 0) + v
        expected.append((g, i, totals[g]))
    got = running(df, ["g"], ["i"], {"s": F.col("v").cast("bigint")}).select("g", "i", "s")
    assert rows(got) == sorted(expected, key=repr)


def test_positions(hot):
    data, df = hot
    got = {r["i"]: r["pos"] for r in global_position(df, ["i"]).collect()}
    assert got == {i: i for i in range(1200)}
    count, expected = {}, {}
    for g, i, _ in sorted(data, key=lambda r: r[1]):
        expected[i] = count.get(g, 0)
        count[g] = expected[i] + 1
    assert {r["i"]: r["pos"] for r in group_position(df, ["g"], ["i"]).collect()} == expected


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_trailing(spark, width):
    values = [random.Random(1).randrange(50) for _ in range(9000)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(4)
    out = trailing(df, ["i"], width, {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("count", F.col("v"))}).collect()
    got = {r["i"]: r["s"] for r in out}
    assert all(r["m"] == max(values[max(0, r["i"] + 1 - width) : r["i"] + 1]) for r in out if r["i"] % 97 == 0)
    assert all(r["n"] == min(r["i"] + 1, width) for r in out)
    prefix = np.r_[0, np.cumsum(values)]
    assert got == {i: prefix[i + 1] - prefix[max(0, i + 1 - width)] for i in range(9000)}


def test_hilbert_steps_are_adjacent(spark):
    df = curves.with_hilbert_position(spark.range(20000).withColumnRenamed("id", "hilbert"))
    p = np.array([[r["x"], r["y"], r["z"]] for r in df.orderBy("hilbert").collect()])
    assert (np.abs(np.diff(p, axis=0)).sum(axis=1) == 1).all()


def greedy(loads, groups, equal=False):
    order = sorted(range(len(loads)), key=lambda i: (-loads[i], -i))
    total, members = [0.0] * groups, [[] for _ in range(groups)]
    for i in order:
        g = min(range(groups), key=lambda k: (total[k], k))
        members[g].append(i)
        total[g] = math.inf if equal and len(members[g]) == len(loads) // groups else total[g] + loads[i]
    return members


@pytest.mark.parametrize("equal", [False, True])
def test_balanced_groups(spark, equal):
    rng = random.Random(2)
    windows = {w: [rng.randrange(1, 20) for _ in range(24)] for w in range(6)}
    df = spark.createDataFrame([(w, i, v) for w, vs in windows.items() for i, v in enumerate(vs)], "w int, i int, v int")
    got = {}
    for r in balanced_groups(df, ["w"], "v", "i", 4, 24, equal).collect():
        got.setdefault(r["w"], [[] for _ in range(4)])[r["grp"]].append(r["i"])
    for w, loads in windows.items():
        assert [sorted(g) for g in got[w]] == [sorted(g) for g in greedy(loads, 4, equal)]


@pytest.mark.parametrize("n,world", [(10, 3), (2, 5), (12, 4)])
def test_epoch(spark, n, world):
    size = math.ceil(n / world) * world
    drawn = epoch_order(spark.range(n), "id", world).collect()
    assert sorted(r["slot"] for r in drawn) == list(range(size))
    by_slot = {r["slot"]: r["id"] for r in drawn}
    assert all(by_slot[s] == by_slot[s % n] for s in range(size))
    assert sorted({by_slot[s] for s in range(n)}) == list(range(n))
    cut = epoch_order(spark.range(n), "id", world, drop_last=True).collect()
    assert len(cut) == n // world * world


def test_balanced_epoch_keeps_whole_windows(spark):
    out = balanced_epoch(spark.range(50).withColumn("load", F.col("id") % 7), "id", "load", 4, 3)
    sizes = {(r["win"], r["grp"]): r["count"] for r in out.groupBy("win", "grp").count().collect()}
    assert set(sizes.values()) == {3} and len(sizes) == 4 * (52 // 12)


def random_cells(seed, n, edge, batches=2):
    rng = random.Random(seed)
    return sorted({(rng.randrange(batches), *[rng.randrange(edge) for _ in range(3)]) for _ in range(n)})


def test_octree_bytes_match_the_codec(spark):
    from sparcel.sources.codec import Octree, morton

    pts = random_cells(3, 150, 16)
    df = spark.createDataFrame(pts, "batch int, x int, y int, z int").withColumn("code", curves.z_order(F.col("x"), F.col("y"), F.col("z")))
    stream = octree.node_stream(octree.octree_nodes(df, 4), 4)
    for b in (0, 1):
        mine = bytes(r["children"] for r in stream.filter(F.col("batch") == b).orderBy("offset").collect())
        codes = np.sort(morton(np.array([p[1:] for p in pts if p[0] == b]), 4))
        assert Octree.of_codes(codes, 4).to_bytes() == mine
        assert (Octree.of_bytes(mine, 4).codes() == codes).all()


def naive_stream(codes, depth):
    """Depth-first child bitmaps and first-child differences, by recursion over code lists."""
    nodes, slots = [], {0: None}

    def visit(members, level):
        kids = {}
        for c in members:
            kids.setdefault((c >> (3 * (depth - level - 1))) & 7, []).append(c)
        nodes.append(sum(1 << k for k in kids))
        reserved = [max(slots) + 1 + i for i in range(len(kids) - 1)]
        slots.update(dict.fromkeys(reserved))
        order = sorted(kids)
        for i in range(1, len(order)):
            slots[reserved[i - 1]] = (min(kids[order[i]]), min(kids[order[i - 1]]))
        if level < depth - 1:
            for k in order:
                visit(kids[k], level + 1)

    visit(codes, 0)
    return nodes, slots


def test_parent_differences_by_recursion(spark):
    from sparcel.sources.codec import Octree

    rng = random.Random(8)
    codes = sorted(rng.sample(range(4096), 90))
    value = {c: rng.randrange(256) for c in codes}
    nodes, slots = naive_stream(codes, 4)
    expected = [value[codes[0]]] + [(value[slots[i][0]] - value[slots[i][1]]) % 256 for i in range(1, len(codes))]
    tree = Octree.of_codes(np.array(codes), 4)
    attrs = np.array([[value[c]] for c in codes], np.uint8)
    assert list(tree.to_bytes()) == nodes
    stored = tree.encode_parent(np.array(codes), attrs)
    assert stored[:, 0].tolist() == expected
    assert (tree.decode_parent(stored) == attrs).all()
    df = spark.createDataFrame([(0, c, value[c]) for c in codes], "batch int, code bigint, value int")
    got = octree.parent_deltas(df, 4, "value").orderBy("slot").collect()
    assert [r["delta"] for r in got] == expected and [r["slot"] for r in got] == list(range(len(codes)))


def test_neighbor_differences(spark):
    pts = random_cells(4, 300, 8)
    rng = random.Random(1)
    value = {p: rng.randrange(256) for p in pts}
    expected = []
    for p in pts:
        ref = None
        for o in octree.REFERENCE_ORDER:
            q = (p[0], *[c - d for c, d in zip(p[1:], o)])
            if q in value and all(c % 4 >= d for c, d in zip(p[1:], o)):
                ref = q
        expected.append((*p, (value[p] - (value[ref] if ref else 0)) % 256))
    df = spark.createDataFrame([(*p, v) for p, v in value.items()], "batch int, x int, y int, z int, v int")
    deltas = octree.neighbor_deltas(df, ["v"], 4)
    assert rows(deltas.drop("reference")) == sorted(expected, key=repr)
    assert rows(octree.from_neighbor_deltas(deltas, ["v"], 4)) == rows(df)


def triangles(spark, seed, n):
    rng = np.random.default_rng(seed)
    data = [("m", i, *rng.random(9).tolist()) for i in range(n)]
    cols = ", ".join(f"{c}{a} double" for c in "abc" for a in "xyz")
    return data, spark.createDataFrame(data, f"mesh string, fid int, {cols}")


def clip(poly, axis, bound, keep_below):
    out = []
    for p, q in zip(poly, poly[1:] + poly[:1]):
        inside = [(v[axis] <= bound) if keep_below else (v[axis] >= bound) for v in (p, q)]
        if inside[0]:
            out.append(p)
        if inside[0] != inside[1]:
            t = (bound - p[axis]) / (q[axis] - p[axis])
            out.append(p + t * (q - p))
    return out


def test_overlap_matches_polygon_clipping(spark):
    n = 6
    data, df = triangles(spark, 1, 25)
    expected = set()
    for r in data:
        corner = np.array(r[2:]).reshape(3, 3)
        for cell in itertools.product(range(n), repeat=3):
            poly = list(corner)
            for a in range(3):
                poly = clip(poly, a, (cell[a] + 1) / n, True) if poly else poly
                poly = clip(poly, a, cell[a] / n, False) if poly else poly
            if poly:
                expected.add((r[1], *cell))
    got = voxelize.overlap_cells(M.with_normal(df), ["fid"], n)
    assert {tuple(r) for r in got.collect()} == expected


def test_scan_hits_lie_on_grid_lines_and_triangles(spark):
    n = 8
    data, df = triangles(spark, 2, 20)
    expected = set()
    for r in data:
        a, b, c = np.array(r[2:]).reshape(3, 3)
        for axis in range(3):
            u, v = (axis + 1) % 3, (axis + 2) % 3
            m = np.array([[b[u] - a[u], c[u] - a[u]], [b[v] - a[v], c[v] - a[v]]])
            for i, j in itertools.product(range(n - 1), repeat=2):
                s, t = np.linalg.solve(m, [(i + 1) / n - a[u], (j + 1) / n - a[v]])
                if s >= 0 and t >= 0 and s + t <= 1:
                    cell = [0, 0, 0]
                    cell[u], cell[v], cell[axis] = i, j, int((a + s * (b - a) + t * (c - a))[axis] * n)
                    expected.add((r[1], axis, *cell))
    got = voxelize.scan_hits(df, ["fid"], n).select("fid", "axis", "i", "j", "k")
    assert {tuple(r) for r in got.collect()} == expected


def walk(s, e, n):
    d = e - s
    length = np.linalg.norm(d)
    d = d / length
    cell = np.floor(s * n).astype(int)
    out = [tuple(cell)]
    step = np.where(d > 0, 1, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(d != 0, ((cell + (step > 0)) / n - s) / d, np.inf)
        dt = np.where(d != 0, 1 / n / np.abs(d), np.inf)
    while True:
        axis = (0 if t[0] < t[2] else 2) if t[0] < t[1] else (1 if t[1] < t[2] else 2)
        if t[axis] > length:
            return [c for c in out if all(0 <= v < n for v in c)]
        cell[axis] += step[axis]
        t[axis] += dt[axis]
        out.append(tuple(cell))


def test_segment_cells_match_a_walk(spark):
    rng = np.random.default_rng(3)
    ends = [(i, *rng.random(6).tolist()) for i in range(60)]
    ends += [(100, 0.1, 0.1, 0.1, 0.9, 0.9, 0.9), (101, 0.05, 0.55, 0.3, 0.95, 0.55, 0.3), (102, 0.8, 0.2, 0.5, 0.8, 0.2, 0.5)]
    df = spark.createDataFrame(ends, "id int, sx double, sy double, sz double, ex double, ey double, ez double")
    got = {}
    for r in voxelize.segment_cells(df, ["id"], 8).collect():
        got.setdefault(r["id"], []).append((r["x"], r["y"], r["z"]))
    assert 102 not in got  # no length, no cells
    for i, *p in ends[:-1]:
        assert sorted(got[i]) == sorted(walk(np.array(p[:3]), np.array(p[3:]), 8)), i


def test_constrained_minimum_beats_sampling():
    rng = np.random.default_rng(4)
    m = rng.normal(size=(40, 4, 4))
    q = np.einsum("nij,nkj->nik", m, m)
    lower = rng.random((40, 3))
    upper = lower + 0.2
    best = voxelize.constrained_minimum(q, lower, upper)
    assert ((best >= lower - 1e-9) & (best <= upper + 1e-9)).all()

    def error(p):
        h = np.concatenate([p, np.ones((*p.shape[:-1], 1))], axis=-1)
        return np.einsum("n...i,nij,n...j->n...", h, q, h)

    tries = lower[:, None] + rng.random((40, 4000, 3)) * 0.2
    assert (error(best) <= error(tries).min(axis=1) + 1e-9).all()


def test_dual_grid_vertices_stay_in_their_cells(spark):
    from tests.test_goldens import CUBE, faces_of

    v = spark.createDataFrame(
        [("m", i, float(i >> 2 & 1), float(i >> 1 & 1), float(i & 1)) for i in range(8)], "mesh string, vid int, x double, y double, z double"
    )
    grid = voxelize.mesh_to_dual_grid(v, faces_of(spark, CUBE), 6).collect()
    assert grid and all(-1e-9 <= r[f"v{a}"] <= 1 + 1e-9 for r in grid for a in "xyz")
    assert {(r["x"], r["y"], r["z"]) for r in grid} == {
        c for c in itertools.product(range(6), repeat=3) if any(v in (0, 5) for v in c)
    }


def test_texture_sampling_by_hand(spark):
    rng = np.random.default_rng(6)
    image = rng.integers(0, 256, (4, 4))
    texels = spark.createDataFrame(
        [(0, x, y, int(image[y, x]), int(image[y, x]), 0) for x in range(4) for y in range(4)], "tex int, tx int, ty int, r int, g int, b int"
    )
    points = [(i, 0, *rng.uniform(-1, 2, 2).tolist(), "LINEAR", "REPEAT", 4, float(m)) for i, m in enumerate([-1, 0.5, 1, 1.25, 2, 7])]
    df = spark.createDataFrame(points, "pid int, tex int, u double, v double, filter string, wrap string, size int, mip double")
    levels = [image]
    while len(levels[-1]) > 1:
        t = levels[-1]
        levels.append((t[::2, ::2] + t[1::2, ::2] + t[::2, 1::2] + t[1::2, 1::2]) // 4)

    def bilinear(t, u, v):
        n = len(t)
        x, y = u * n - 0.5, (1 - v) * n - 0.5
        i, j = math.floor(x), math.floor(y)
        return sum(
            t[(j + b) % n, (i + a) % n] * (x - i if a else 1 - x + i) * (y - j if b else 1 - y + j) for a in (0, 1) for b in (0, 1)
        )

    got = {r["pid"]: r["r"] for r in texture.sample(df, texture.pyramid(texels, 4), ["pid"]).collect()}
    for pid, _, u, v, _, _, _, mip in points:
        lo = min(max(mip, 0), 2)
        f = lo - math.floor(lo)
        want = (1 - f) * bilinear(levels[math.floor(lo)], u, v) + (f * bilinear(levels[math.floor(lo) + 1], u, v) if f else 0)
        assert got[pid] == pytest.approx(want / 255)


def test_space_to_channel_is_undone(spark):
    pts = random_cells(7, 200, 10)
    df = spark.createDataFrame([(*p, float(sum(p)), float(p[1])) for p in pts], "batch int, x int, y int, z int, u double, w double")
    back = C.channel_to_space(C.space_to_channel(df, 3, ["u", "w"]), 3, 2)
    assert rows(back.select("batch", "x", "y", "z", F.get("values", F.lit(0)), F.get("values", F.lit(1)))) == rows(df)


def test_sparse_dense_sparse(spark):
    pts = random_cells(9, 60, 5, 2)
    df = spark.createDataFrame([(*p, 1.0) for p in pts], "batch int, x int, y int, z int, v double")
    box = C.grid(spark, (0, 0, 0), (4, 4, 4), df.select("batch").distinct())
    dense = C.densify(df, box, ["v"])
    assert dense.count() == 250
    assert rows(C.sparsify(dense, F.col("v") > 0)) == rows(df)


def test_principal_colors_match_svd(spark):
    from sparcel.operators.reduce import principal_colors

    m = np.random.default_rng(11).normal(size=(50, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id int, v array<double>").repartition(3)
    got = np.array([[r["c0"], r["c1"], r["c2"]] for r in principal_colors(df, "id", "v", 6).orderBy("id").collect()])
    u = np.linalg.svd(m, full_matrices=False)[0][:, :3]
    want = (u - u.min(axis=0)) / (u.max(axis=0) - u.min(axis=0))
    for c in range(3):  # the sign of a component is free
        assert np.allclose(got[:, c], want[:, c], atol=1e-6) or np.allclose(got[:, c], 1 - want[:, c], atol=1e-6)


def test_positions_beyond_double_precision(spark):
    from sparcel.operators.cells import flat_index, from_flat_index

    sizes = {"x": 1 << 17, "y": 1 << 17, "z": 1 << 17}
    df = spark.createDataFrame([(511, (1 << 17) - 1, (1 << 17) - 1, (1 << 17) - 1), (256, 0, 1, 0)], "batch int, x int, y int, z int")
    back = df.withColumn("code", flat_index(sizes)).select("code", *[c.alias(a) for a, c in from_flat_index(F.col("code"), sizes).items()])
    assert rows(back, "batch", "x", "y", "z") == rows(df, "batch", "x", "y", "z")
    assert max(r["code"] for r in back.collect()) == (1 << 60) - 1


def test_running_sum_of_nulls(spark):
    from sparcel.operators.ordered import running

    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "i int, v int")
    assert rows(running(df, [], ["i"], {"s": F.col("v").cast("long")}, exclusive=True), "i", "s") == [(1, 0), (2, 5), (3, 5)]


@pytest.mark.parametrize("n,width", [(4, 6), (4, 10), (8, 5), (4, 8)])
def test_first_hits_cover_every_pixel(spark, n, width):
    from sparcel.operators.raster import first_hits

    df = spark.createDataFrame([(0, x, y, 0, x) for x in range(n) for y in range(n)], "b int, x int, y int, z int, v int")
    found = {(r["py"], r["px"]): r["v"] for r in first_hits(df, "b", ["v"], n, width).collect()}
    assert set(found) == {(i, j) for i in range(width) for j in range(width)}
    assert all(v * width // n <= px < (v + 1) * width // n for (_, px), v in found.items())


def test_window_and_padding_limits(spark):
    from sparcel.operators.cells import to_padded

    df = spark.createDataFrame([(0, i, float(i)) for i in range(5)], "w int, i int, v double")
    with pytest.raises(Exception, match="more than 4"):
        balanced_groups(df, ["w"], "v", "i", 2, 4).collect()
    with pytest.raises(ValueError, match="more than 3"):
        to_padded(df, "w", ["i"], "v", length=3)


def test_long_products(spark):
    from sparcel.operators.reduce import segment_reduce

    df = spark.createDataFrame([(0, [0.5, -0.5])] * 3001 + [(1, [0.0, 2.0])], "b int, v array<double>")
    a, z = sorted(segment_reduce(df, "b", F.col("v")).collect())
    assert a.sign == -1 and abs(a.log_prod + 6002 * 0.6931471805599453) < 1e-6 and (z.sign, z.log_prod) == (0, None)


def test_hilbert_twin_visits_neighbours():
    import duckdb

    from sparcel.plans.curves import hilbert_sql

    walk = hilbert_sql()
    sql = walk[walk.index("SELECT x, y, z, CAST(code") :]
    con = duckdb.connect()
    con.execute("CREATE TABLE points AS SELECT CAST(x AS INTEGER) x, CAST(y AS INTEGER) y, CAST(z AS INTEGER) z FROM range(8) a(x), range(8) b(y), range(8) c(z)")
    seen = con.execute(sql + " ORDER BY hilbert").fetchall()
    assert [r[3] for r in seen] == list(range(512))
    assert all(sum(abs(p - q) for p, q in zip(a[:3], b[:3])) == 1 for a, b in zip(seen, seen[1:]))


def test_faces_with_unknown_vertices(spark):
    v = spark.createDataFrame([("m", i, float(i), 0.0, 0.0) for i in range(3)], "mesh string, vid int, x double, y double, z double")
    f = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 0, 1, 9)], "mesh string, fid int, v0 int, v1 int, v2 int")
    assert [r["fid"] for r in M.gather(f, v).collect()] == [0]
    assert [r["fid"] for r in M.broken_faces(f, v).collect()] == [1]


def test_samples_without_a_texel_stay(spark):
    texels = spark.createDataFrame([("t", x, y, 0, 51, 102, 153) for x in range(2) for y in range(2)], f"tex string, tx int, ty int, level int, {', '.join(c + ' int' for c in texture.CHANNELS)}")
    points = spark.createDataFrame([(1, "t", 0.5, 0.5), (2, "absent", 0.5, 0.5)], "id int, tex string, u double, v double")
    points = points.select("*", F.lit("NEAREST").alias("filter"), F.lit("REPEAT").alias("wrap"), F.lit(2).alias("size"), F.lit(None).cast("double").alias("mip"))
    found = {r["id"]: r for r in texture.sample(points, texels, ["id"]).collect()}
    assert set(found) == {1, 2} and found[2][texture.CHANNELS[0]] is None and found[1][texture.CHANNELS[0]] == pytest.approx(0.2)


@pytest.mark.parametrize("kind", ["double", "string", "array<int>", "struct<a:int,b:string>", "timestamp", "boolean"])
@pytest.mark.parametrize("window_rows", [0, 1 << 20])
def test_running_over_groups_of_any_type(spark, monkeypatch, kind, window_rows):
    monkeypatch.setattr(ordered, "WINDOW_ROWS", window_rows)
    rnd = random.Random(3)
    values = {
        "double": [float("nan"), 0.0, -0.0, 1.5, None], "string": ["a", "", None, "b\"c"], "array<int>": [[1], [1, 2], [], None], "struct<a:int,b:string>": [(1, None), (1, "x"), None],
        "timestamp": [datetime.datetime(2020, 1, d) for d in (1, 2)] + [None], "boolean": [True, False, None],
    }[kind]
    data = [(rnd.choice(values), i, rnd.randrange(-5, 50), rnd.random()) for i in range(700)]
    df = spark.createDataFrame(data, f"g {kind}, i int, v int, d double").repartition(4)
    got = running(df, ["g"], ["i"], {"s": F.col("v"), "t": F.col("d")}).collect()
    totals, expected = {}, {}
    for g, i, v, d in data:
        key = repr(None if g is None else "nan" if g != g else g + 0.0 if isinstance(g, float) else g)
        a, b = totals.get(key, (0, 0.0))
        totals[key] = expected[i] = (a + v, b + d)
    assert len(got) == 700
    for r in got:
        assert r.s == expected[r.i][0] and abs(r.t - expected[r.i][1]) < 1e-9
    assert running(df.limit(0), ["g"], ["i"], {"s": F.col("v")}).collect() == []


def test_running_takes_one_exchange(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id AS i")
    assert running(df, ["g"], ["i"], {"s": F.lit(1)})._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    monkeypatch.setattr(ordered, "WINDOW_ROWS", 0)
    made = []
    keep = ordered.stage
    ordered.stage = lambda d, label: made.append(d._jdf.queryExecution().executedPlan().toString()) or keep(d, label)
    try:
        after = running(df, ["g"], ["i"], {"s": F.lit(1)})
    finally:
        ordered.stage = keep
    assert made[0].count("Exchange") == 1 and "Exchange" not in after._jdf.queryExecution().executedPlan().toString()


def test_sampler_state_is_stored_once(spark, tmp_path):
    from sparcel.operators.sharding import SamplerState, last_state, resumed_order, save_state
    from sparcel.sources.stages import Folder

    folder = str(tmp_path / "state")
    docs = spark.range(20)
    assert last_state(spark, folder) == SamplerState()
    whole = {(r.step, r["rank"]): r.id for r in epoch_order(docs, "id", 3, 1, 0).collect()}
    save_state(spark, folder, SamplerState(0, 5))
    with pytest.raises(Exception, match="exists"):
        save_state(spark, folder, SamplerState(0, 5))
    rest = {(r.step, r["rank"]): r.id for r in resumed_order(docs, "id", 3, folder, seed=1).collect()}
    assert rest == {k: v for k, v in whole.items() if k[0] >= 5} and len(rest) == 6
    Folder(spark, folder).create(f"{0:012d}-{6:012d}.json", '{"epoch": 0,')  # cut short
    assert last_state(spark, folder) == SamplerState(0, 5)
    save_state(spark, folder, SamplerState(0, 7))
    after = resumed_order(docs, "id", 3, folder, seed=1)
    assert after.count() == 21 and {r.epoch for r in after.collect()} == {1}


def test_micro_batches_of_few_rows(spark):
    from sparcel.operators.sharding import micro_batches

    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), *[("b", i) for i in range(7)]], "g string, i int")
    found = {}
    for r in micro_batches(df, ["g"], ["i"], 3).collect():
        found.setdefault((r.g, r.part), []).append(r.i)
    assert {k: sorted(v) for k, v in found.items()} == {(None, 1): [1], (None, 2): [2], ("a", 2): [3], ("b", 0): [0, 1], ("b", 1): [2, 3], ("b", 2): [4, 5, 6]}


def test_open_roots_reads_what_is_there(spark, tmp_path):
    from pyspark.sql import types as T

    from sparcel.operators.instances import open_roots

    schema = T.StructType().add("k", "string").add("a", "double").add("b", "long")
    for name, text in {"one": "k,a\nx,1\ny,\n", "two": "b,k,other\n5,x,q\nbad,y,q\n", "three": "a\n1\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.csv").write_text(text)
    config = f'{{"both": {{"r": "{tmp_path}/one", "s": "{tmp_path}/two"}}}}'
    kept, counts = open_roots(spark, config, schema, "k", [("has_b", F.col("b").isNotNull())])
    assert [(r.dataset, r.k, r.a, r.b) for r in kept.collect()] == [("both", "x", 1.0, 5)]
    assert [(r.total, r.has_b) for r in counts.collect()] == [(2, 1)]
    kept, _ = open_roots(spark, f"{tmp_path}/one, {tmp_path}/two/", schema, "k", [])
    assert sorted((r.dataset, r.k) for r in kept.collect()) == [("one", "x"), ("one", "y"), ("two", "x"), ("two", "y")]
    with pytest.raises(ValueError, match="no column k"):
        open_roots(spark, f"{tmp_path}/three", schema, "k", [])
    with pytest.raises(ValueError, match="same name"):
        open_roots(spark, f"{tmp_path}/one,{tmp_path}/one", schema, "k", [])


def test_camera_inside_a_cell_and_behind(spark):
    from sparcel.operators import raster

    cells = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.4), (0, 2, 0.0, 0.0, 5.0), (0, 3, 0.0, 0.0, -5.0), (0, 4, 90.0, 0.0, 1.0)], "v int, item int, x double, y double, z double")
    cameras = raster.look_at(spark.createDataFrame([(0, 0.0, 0.0, 0.0, 8.0)], "v int, px double, py double, pz double, focal double"), [F.lit(0.0), F.lit(0.0), F.lit(9.0)], (0.0, 1.0, 0.0))
    seen = raster.project_cells(cells, cameras, "v", "item", 1.0, 6, 4)
    boxes = {r.item: (r.x0, r.x1, r.y0, r.y1) for r in seen.collect()}
    assert boxes[1] == (0, 6, 0, 4) and set(boxes) == {1, 2}  # one reaches behind the camera; one is behind, one outside
    hits = {(r.px, r.py): (r.item, r.distance) for r in raster.camera_hits(seen, "v", "item", 1.0, 6, 4).collect()}
    assert len(hits) == 24 and set(hits.values()) == {(1, 0.0)}


def test_dense_box_is_not_broadcast(spark):
    """The box is many times its batch ids; it must not be sent whole to the driver."""
    batches = spark.range(40).selectExpr("cast(id as int) as batch").distinct()
    df = batches.selectExpr("batch", "1 as x", "2 as y", "3 as z", "1.5D as v")
    dense = C.sparsify(C.densify(df, C.grid(spark, (0, 0, 0), (9, 9, 9), batches), ["v"]), F.col("v") > 0.5)
    assert dense.count() == 40
    dense.collect()
    assert "BroadcastHashJoin" not in dense._jdf.queryExecution().executedPlan().toString()


def test_cells_grow_in_partitions(spark, tmp_path, monkeypatch):
    """A task's share of the cells does not grow with the table, and nothing is shuffled again to group by batch and more."""
    from sparcel import session
    from sparcel.plans import load_all

    monkeypatch.setattr(session, "MOST_ROWS", 500)
    made = "id as l_orderkey, id * 7 % 20000 as l_partkey, id * 13 % 1000 as l_suppkey, cast(1 + id % 7 as int) as l_linenumber, cast(id % 50 as double) as l_quantity"
    items = spark.range(60000).selectExpr(*made.split(", "), "1D as l_extendedprice", "0.1D as l_discount", "'R' as l_returnflag", "'O' as l_linestatus")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("neighbor_deltas", "first_hits", "space_to_channel", "channel_to_space", "parent_deltas", "octree_stream"):
        df = load_all()[name].build(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() == 120, name
        assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("Exchange hashpartitioning") == 1, name


def test_tight_pixels_lose_no_hit(spark):
    """The rays of a camera against all cells by brute force."""
    from sparcel.operators import raster

    rng = random.Random(3)
    spots = rng.sample(list(itertools.product(range(12), repeat=3)), 300)
    cells = spark.createDataFrame([(1, i, x + 0.5, y + 0.5, z + 0.5) for i, (x, y, z) in enumerate(spots)], "v int, item long, x double, y double, z double")
    at = spark.createDataFrame([(1, -9.0, 2.0, 3.0, 20.0)], "v int, px double, py double, pz double, focal double")
    cameras = raster.look_at(at, [F.lit(6.0)] * 3)
    cam = cameras.first()
    got = {(r.py, r.px): r.item for r in raster.camera_hits(raster.project_cells(cells, cameras, "v", "item", 1.0, 30, 20), "v", "item", 1.0, 30, 20).collect()}
    p, (r, d, f) = np.array([cam.px, cam.py, cam.pz]), [np.array([cam[f"{n}{a}"] for a in "xyz"]) for n in "rdf"]
    mid = np.array(spots) + 0.5
    want = {}
    for v, u in itertools.product(range(20), range(30)):
        ray = f + (u + 0.5 - 15) / 20 * r + (v + 0.5 - 10) / 20 * d
        near, far = (mid - 0.5 - p) / ray, (mid + 0.5 - p) / ray
        enter, leave = np.maximum(np.minimum(near, far).max(1), 0), np.maximum(near, far).min(1)
        met = [(float((mid[i] - p) @ f), i) for i in np.flatnonzero(leave > enter)]
        if met:
            want[v, u] = min(met)[1]
    assert got == want
