"""File formats and streams."""

import io
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparcel.sources import catalogue, codec, files, logs, stages
from sparcel.streaming import records as S
from tests.conftest import rows


@pytest.fixture(scope="module")
def voxels(spark):
    rng = np.random.default_rng(0)
    pts = {(int(b), *map(int, p)) for b, p in zip(rng.integers(0, 3, 400), rng.integers(0, 40, (400, 3)))}
    data = [(*p, [int(v) for v in rng.integers(0, 256, 3)], int(rng.integers(0, 8))) for p in sorted(pts)]
    return spark.createDataFrame(data, "asset int, x int, y int, z int, color array<int>, flags int")


@pytest.mark.parametrize("how", codec.FILTERS)
@pytest.mark.parametrize("method,interleave", [("lzma", "as_is"), ("deflate", "none"), ("zstd", "all"), ("none", "as_is")])
def test_vxz(spark, voxels, tmp_path, how, method, interleave):
    path = str(tmp_path / "out")
    files.write_cells(voxels, path, "vxz", "asset", ["color", "flags"], chunkSize=16, filter=how, compression=method, interleave=interleave)
    back = files.read_cells(spark, path, "vxz").select(F.col("file").cast("int"), "x", "y", "z", "color", "flags")
    assert rows(back) == rows(voxels)


def test_vxz_layout(spark, voxels, tmp_path):
    """The container as another reader would take it apart."""
    path = str(tmp_path / "out")
    one = voxels.filter("asset = 1")
    files.write_cells(one, path, "vxz", "asset", ["color", "flags"], chunkSize=32, compression="none")
    data = (tmp_path / "out" / "1.vxz").read_bytes()
    assert data[:4] == b"VXZ\x00"
    start = struct.unpack(">I", data[4:8])[0]
    head = json.loads(data[8:start])
    assert head["num_voxel"] == one.count() and head["attr"] == [["color", 3], ["flags", 1]]
    assert [c["idx"] for c in head["chunks"]] == sorted(c["idx"] for c in head["chunks"])
    assert head["compressed_size"] == len(data) - start == sum(c["ptr"][1] for c in head["chunks"])
    assert head["raw_size"] == one.count() * 16


def test_vxz_direct_write_and_split_read(spark, voxels, tmp_path):
    path = str(tmp_path / "direct")
    files.register(spark)
    named = voxels.select(F.col("asset").cast("string").alias("file"), "x", "y", "z", "color", "flags")
    named.repartition("file").sortWithinPartitions("file").write.format("vxz").option("chunkSize", 8).mode("append").save(path)
    back = files.read_cells(spark, path, "vxz", maxPartitionBytes=1500)
    assert back.rdd.getNumPartitions() > 3
    assert rows(back) == rows(named)


def test_vxz_refuses_wide_values(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 1, 1, 300)], "asset int, x int, y int, z int, v int")
    with pytest.raises(Exception, match="does not fit a byte"):
        files.write_cells(df, str(tmp_path / "bad"), "vxz", "asset", ["v"])


def test_one_file_per_asset(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 1, 1, 3), (0, 900, 1, 1, 4), (1, 2, 2, 2, 5)], "asset int, x int, y int, z int, v int")
    path = str(tmp_path / "far")
    files.write_cells(df, path, "vxz", "asset", ["v"])
    assert sorted(r["file"] for r in files.read_headers(spark, path).collect()) == ["0", "1"]
    assert rows(files.read_cells(spark, path, "vxz").select("x", "v")) == [(1, 3), (2, 5), (900, 4)]
    assert rows(catalogue.finished_outputs(spark, path, ".vxz").select("key")) == [("0",), ("1",)]
    files.write_cells(df.filter("asset = 1"), path, "vxz", "asset", ["v"], mode="overwrite")
    assert rows(files.read_cells(spark, path, "vxz").select("file", "v")) == [("1", 5)]


def test_failed_job_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 1, 1, 3), (1, 1, 1, 1, 300)], "asset int, x int, y int, z int, v int")
    path = tmp_path / "half"
    with pytest.raises(Exception, match="does not fit a byte"):
        files.write_cells(df, str(path), "vxz", "asset", ["v"])
    assert not path.exists() or [f for f in path.iterdir() if f.suffix == ".vxz"] == []


@pytest.mark.parametrize("kind", ["npz", "voxelply"])
def test_plain_formats(spark, voxels, tmp_path, kind):
    path = str(tmp_path / kind)
    files.write_cells(voxels, path, kind, "asset", ["color", "flags"])
    back = files.read_cells(spark, path, kind).select(F.col("file").cast("int"), "x", "y", "z", "color", "flags")
    assert rows(back) == rows(voxels)


def test_suffix_chooses_the_format(spark):
    with pytest.raises(ValueError):
        files.read_cells(spark, "/tmp/cells.obj")


@pytest.mark.parametrize("text", [False, True])
def test_mesh_ply(spark, tmp_path, text):
    v = spark.createDataFrame([("m", i, float(i), 0.5, 0.25, 7) for i in range(4)], "mesh string, vid int, x double, y double, z double, red int")
    f = spark.createDataFrame([("m", 0, [0, 1, 2]), ("m", 1, [0, 1, 2, 3])], "mesh string, fid int, corners array<int>")
    path = str(tmp_path / "mesh")
    files.write_mesh(v, f, path, text=text, channels={"color": ["red"]})
    files.register(spark)
    back = spark.read.format("meshply").load(path)
    assert back.count() == 6
    assert [r["corners"] for r in back.filter("element != 'vertex'").orderBy("id").collect()] == [[0, 1, 2], [0, 1, 2, 3]]
    assert [r["x"] for r in back.filter("element = 'vertex'").orderBy("id").collect()] == [0.0, 1.0, 2.0, 3.0]
    cells, attrs = files.VoxelPlyFiles({}).decode((tmp_path / "mesh" / "m.ply").read_bytes())
    assert attrs["red"].tolist() == [[7]] * 4


def test_mesh_ply_odd_faces(spark, tmp_path):
    head = "ply\nformat {} 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nelement face 2\nproperty list uchar int vertex_index\nend_header\n"
    (tmp_path / "a.ply").write_text(head.format("ascii") + "0 0 0\n5 0 0 0 0 0\n3 0 0 0\n")
    files.register(spark)
    assert spark.read.format("meshply").load(str(tmp_path / "a.ply")).filter("element != 'vertex'").count() == 1
    (tmp_path / "b.ply").write_bytes(head.format("binary_little_endian").encode() + struct.pack("<fffB5i", 0, 0, 0, 5, *[0] * 5))
    with pytest.raises(Exception, match="unsupported face"):
        spark.read.format("meshply").load(str(tmp_path / "b.ply")).count()


def test_single_camera_files(spark, tmp_path):
    folder = tmp_path / "views" / "abc"
    folder.mkdir(parents=True)
    frame = {"file_path": "000.png", "camera_angle_x": 0.5, "transform_matrix": [[1.0, 0, 0, 2.0]] * 4}
    (folder / "transforms.json").write_text(json.dumps({"aabb": [[0.0] * 3] * 2, "scale": 1.0, "offset": [0.0] * 3, "frames": [frame] * 2}, indent=4))
    out = logs.read_views(spark, str(tmp_path / "views"), single_files=True)
    assert rows(out.select("asset", "idx", "file_path")) == [("abc", 0, "000.png"), ("abc", 1, "000.png")]


def test_stage_tables(spark, tmp_path):
    schema = T.StructType().add("sha256", "string").add("n", "long")
    assert catalogue.read_stage(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "part_0.csv").write_text("sha256,n\na,1\nb,oops\n")
    assert rows(catalogue.read_stage(spark, str(tmp_path / "part_*.csv"), schema, tolerant=True)) == [("a", 1)]
    rejected = catalogue.rejected_rows(spark, str(tmp_path / "part_*.csv"), schema).collect()
    assert [(r["file"].rsplit("/", 1)[-1], r["line"]) for r in rejected] == [("part_0.csv", "b,oops")]
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], schema)
    assert rows(catalogue.pick_instances(table, "sha256", "a,c")) == [("a", 1), ("c", 3)]
    (tmp_path / "list.txt").write_text("b\nc\n")
    assert rows(catalogue.pick_instances(table, "sha256", str(tmp_path / "list.txt"))) == [("b", 2), ("c", 3)]


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("b", "", 2), ("a", "x", 1)], "stage string, part string, n int")
    catalogue.write_report(df, str(tmp_path / "report"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()] == [" - a x 1", " - b  2"]


def test_ingestion_resumes_and_replays(spark, tmp_path):
    schema = "k string, seq int, u int"
    parts, target = str(tmp_path / "parts"), str(tmp_path / "log")
    spark.createDataFrame([("a", 1, 10), ("b", 1, 5)], schema).coalesce(1).write.parquet(parts)
    kind = spark.createDataFrame([], schema).schema
    assert rows(S.ingest_records(spark, parts, kind, target, ["k"], ["seq"])) == [("a", 10), ("b", 5)]
    spark.createDataFrame([("a", 2, None), ("b", 2, 6)], schema).coalesce(1).write.mode("append").parquet(parts)
    assert rows(S.ingest_records(spark, parts, kind, target, ["k"], ["seq"])) == [("a", 10), ("b", 6)]
    assert rows(S.ingest_records(spark, parts, kind, target, ["k"], ["seq"])) == [("a", 10), ("b", 6)]


def test_late_and_repeated_events(spark, tmp_path):
    schema = "id bigint, ts timestamp, kind string, v double"
    parts, target = str(tmp_path / "ev"), str(tmp_path / "win")
    batches = [
        [(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:10:00", "a", 1.0)],
        [(2, "2024-01-01 05:00:00", "a", 2.0)],
        [(3, "2024-01-01 00:20:00", "a", 9.0)],
    ]
    kind = spark.createDataFrame([], schema).schema
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "id bigint, ts string, kind string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(parts)
        stream = S.windowed_counts(S.file_stream(spark, parts, kind), "ts", "1 hour", "1 hour", ["kind"], "v", "id")
        S.run_once(stream, target, str(tmp_path / "cp"), mode="update")
    out = S.latest(spark, target, ["start", "kind"]).orderBy("start").select("n", "total").collect()
    assert [tuple(r) for r in out] == [(1, 1.0), (1, 2.0)]  # the repeat and the late row are gone


def test_broadcast_file_checks_the_size(spark, tmp_path):
    (tmp_path / "lut.bin").write_bytes(b"abc")
    assert files.broadcast_file(spark, str(tmp_path / "lut.bin")).value == b"abc"
    with pytest.raises(ValueError):
        files.broadcast_file(spark, str(tmp_path / "lut.bin"), limit=2)
    with pytest.raises(ValueError):
        files.broadcast_file(spark, str(tmp_path / "none.bin"))


def test_step_log_of_any_depth(spark, tmp_path):
    (tmp_path / "log.txt").write_text('3: {"a": 1, "b": {"c": 2, "d": {"e": {"f": 3}}}, "s": "x"}\nno step\n4: {broken\n')
    path = str(tmp_path / "log.txt")
    assert rows(logs.read_step_log(spark, path)) == [(3, "a", 1.0), (3, "b/c", 2.0), (3, "b/d/e/f", 3.0), (3, "s", None)]
    assert rows(logs.rejected_log_lines(spark, path)) == [("4: {broken",), ("no step",)]


def test_step_log_braces_depth_and_repeated_keys(spark, tmp_path):
    deep = "{" * 0 + '{"a":' * 90 + "7" + "}" * 90
    lines = ["1: " + '{"note":"' + "{" * 4000 + '\\"}","l":{"a":2}}', "2: " + deep, '3: {"a":1,"a":2}', '4: {"x":NaN,"y":-Infinity,"z":{"{":true}}', '5: {"e":{}}', "6: [1]"]
    (tmp_path / "log.txt").write_text("\n".join(lines))
    found = {(r.step, r.key): r.value for r in logs.read_step_log(spark, str(tmp_path)).collect()}
    assert found.pop((2, "/".join("a" * 90))) == 7
    assert str(found.pop((4, "x"))) == "nan"
    assert found == {(1, "note"): None, (1, "l/a"): 2.0, (4, "y"): float("-inf"), (4, "z/{"): None}
    assert [r.value[:2] for r in logs.rejected_log_lines(spark, str(tmp_path)).collect()] == ["3:", "6:"]


def test_step_log_keeps_nulls_and_odd_strings(spark, tmp_path):
    lines = ['1: {"loss": null, "a": {"b": null}}', '2: {"s": "{oops", "t": {"u": "{"}}', '3: {"loss": 1.5}']
    (tmp_path / "log.txt").write_text("\n".join(lines))
    path = str(tmp_path / "log.txt")
    assert rows(logs.read_step_log(spark, path)) == [(1, "a/b", None), (1, "loss", None), (2, "s", None), (2, "t/u", None), (3, "loss", 1.5)]
    assert rows(logs.rejected_log_lines(spark, path)) == []


def test_streamed_windows_over_a_table_longer_than_the_watermark(spark, tmp_path):
    from sparcel.plans.streams import streamed_windows

    days = F.expr("timestamp_ntz'2024-01-01 00:30:00' + make_interval(0, 0, 0, cast(id % 400 as int))")
    events = spark.range(1200).select(
        F.col("id").alias("event_id"), F.when(F.col("id") != 7, days).alias("ts"), F.col("id").alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    out = streamed_windows(spark, str(tmp_path)).collect()
    assert sum(r.n for r in out) == 1200 and len(out) == 401
    assert sorted({(r.n, r.total) for r in out}) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert [(r.n, r.total) for r in out if r.start is None] == [(1, 1.0)]


RECORDS = T.StructType().add("k", "string").add("a", "double").add("b", "string")


def _part(path, name, text, time):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text)
    os.utime(path / name, (time, time))


def _published(spark, root):
    return {r.k: (r.a, r.b) for r in stages.read_stage_table(spark, str(root), RECORDS, ["k"]).collect()}


def test_published_stage_table(spark, tmp_path):
    new = tmp_path / "new_records"
    assert _published(spark, tmp_path) == {}
    _part(new, "part_1.csv", "k,a,b\nx,1,one\ny,2,\n", 1000)
    _part(new, "part_0.csv", "b,k\nnewer,x\n", 2000)  # later though its name is smaller; no column a
    _part(new, "part_2.csv", "nothing at all\n1\n", 3000)
    _part(new, "part_3.csv", "k,a,b\nz,oops,q\nw,4,r\n", 3000)
    first = stages.compact_parts(spark, str(tmp_path), RECORDS, ["k"])
    assert first.version == 1 and _published(spark, tmp_path) == {"x": (1.0, "newer"), "y": (2.0, None), "w": (4.0, "r")}
    assert sorted(p.name for p in new.glob("*.csv")) == ["part_2.csv"]
    assert sorted(p.name for p in tmp_path.glob("merged_records/*/*.csv")) == ["part_0.csv", "part_1.csv", "part_3.csv"]
    # an older record never wins, whenever it arrives; NaN is missing
    _part(new, "late.csv", "k,a,b\nx,9,old\ny,NaN,set\nv,,\n", 500)
    stages.compact_parts(spark, str(tmp_path), RECORDS, ["k"])
    assert _published(spark, tmp_path) == {"x": (1.0, "newer"), "y": (2.0, "set"), "w": (4.0, "r"), "v": (None, None)}
    assert stages.compact_parts(spark, str(tmp_path), RECORDS, ["k"]).version == 2  # only the part that is no CSV is left
    before = set(tmp_path.glob("table/*/bucket=*"))
    stages.vacuum(spark, str(tmp_path))
    assert set(tmp_path.glob("table/*/bucket=*")) < before and _published(spark, tmp_path)["x"] == (1.0, "newer")


def test_published_stage_table_after_crashes(spark, tmp_path, monkeypatch):
    new = tmp_path / "new_records"
    _part(new, "p1.csv", "k,a,b\nx,1,one\n", 1000)
    stages.compact_parts(spark, str(tmp_path), RECORDS, ["k"])

    # before the manifest: the table is as it was, the part waits
    _part(new, "p2.csv", "k,a,b\nx,2,\ny,3,n\n", 2000)
    create = stages.Folder.create
    monkeypatch.setattr(stages.Folder, "create", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        stages.compact_parts(spark, str(tmp_path), RECORDS, ["k"])
    assert _published(spark, tmp_path) == {"x": (1.0, "one")} and (new / "p2.csv").exists()

    # inside the manifest: half a file is no manifest
    monkeypatch.setattr(stages.Folder, "create", lambda self, name, text: create(self, name, text[:20]))
    stages.compact_parts(spark, str(tmp_path), RECORDS, ["k"])
    monkeypatch.setattr(stages.Folder, "create", create)
    assert stages.current(spark, str(tmp_path)).version == 1

    # between manifest and archive: the next merge archives first and changes nothing
    keep = stages.archive
    (tmp_path / "merged_records").mkdir(exist_ok=True)
    for p in tmp_path.glob("merged_records/*/p2.csv"):
        p.rename(new / "p2.csv")
    monkeypatch.setattr(stages, "archive", lambda *a: [])
    made = stages.compact_parts(spark, str(tmp_path), RECORDS, ["k"])
    monkeypatch.setattr(stages, "archive", keep)
    assert made.version == 3 and _published(spark, tmp_path) == {"x": (2.0, "one"), "y": (3.0, "n")} and (new / "p2.csv").exists()
    assert stages.compact_parts(spark, str(tmp_path), RECORDS, ["k"]) == made
    assert not (new / "p2.csv").exists() and _published(spark, tmp_path) == {"x": (2.0, "one"), "y": (3.0, "n")}

    # two writers of one version: the second fails
    with pytest.raises(Exception, match="exists"):
        create(stages.Folder(spark, str(tmp_path)), f"manifest/{made.version:012d}.json", "{}")


def test_merge_touches_only_its_buckets(spark, tmp_path):
    rows = spark.range(500).selectExpr("cast(id as string) AS k", "double(id) AS a", "'s' AS b", "struct(id AS at) AS s")
    stages.merge_records(rows, str(tmp_path), ["k"], "s", buckets=16)
    before = stages.current(spark, str(tmp_path)).places
    one = spark.createDataFrame([("7", 70.0, None)], "k string, a double, b string").selectExpr("*", "struct(9L AS at) AS s")
    after = stages.merge_records(one, str(tmp_path), ["k"], "s")
    assert len(before) == 16 and sum(after.places[b] != before[b] for b in before) == 1
    assert _published(spark, tmp_path)["7"] == (70.0, "s") and len(_published(spark, tmp_path)) == 500


def test_box_scan_reads_only_what_it_needs(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    cells = spark.range(4096).selectExpr("'one' AS f", "int(id % 16) AS x", "int(id div 16 % 16) AS y", "int(id div 256) AS z", "array(int(id % 250), 3) AS c", "int(id % 7) AS d")
    files.write_cells(cells, path, "vxz", "f", ["c", "d"], chunkSize=4, compression="deflate", interleave="none", filter="parent")
    want = {(r.x, r.y, r.z, r.d) for r in cells.filter("x >= 4 and x < 9 and z >= 13").collect()}
    assert {tuple(r) for r in files.scan_cells(spark, path, {"d": "int"}, (4, None, 13), (9, None, None)).drop("file").collect()} == want
    index = files.chunk_index(spark, path)
    assert index.count() == 64 and index.filter("x1 >= 4 and x0 < 9 and z1 >= 13").count() == 8
    # streams: the octree and channel d of each chunk that the conditions leave, nothing of c
    source = files.VxzFiles({"path": path})
    files.register(spark)
    schema = T.StructType.fromDDL("file string, x int, y int, z int, d int")
    reader = source.reader(schema)
    conditions = [files.GreaterThanOrEqual(("x",), 4), files.LessThan(("x",), 8), files.EqualTo(("z",), 15), files.In(("file",), ("one", "two"))]
    assert list(reader.pushFilters(conditions)) == conditions
    opened = []
    unpack = files.codec.expand
    monkeypatch.setattr(files.codec, "expand", lambda data, *a: opened.append(len(data)) or unpack(data, *a))
    found = [b for share in reader.partitions() for b in reader.read(share)]
    assert len(found) == 4 and len(opened) == 8 and sum(b.num_rows for b in found) == 4 * 64
    assert files.scan_cells(spark, path, {"absent": "int"}, (0, 0, 0), (1, 1, 1)).collect()[0].absent is None
    for names in (["c"], ["d"], None):
        for interleave in ("none", "as_is", "all"):
            meta = {"chunk_size": 4, "filter": "neighbor", "compression": "none", "compression_level": 0, "attr": [["c", 2], ["d", 1]], "attr_interleave": interleave}
            local = np.array([[0, 1, 2], [3, 3, 3], [1, 0, 0]])
            attrs = np.array([[1, 2, 3], [4, 5, 6], [7, 8, 9]], np.uint8)
            entry, data = files.codec.encode_chunk([1, 0, 0], local, attrs, meta)
            entry["ptr"] = [0, len(data)]
            packed = files.read_streams(io.BytesIO(b"head" + data), 4, entry, meta, names)
            coord, named = files.codec.decode_streams([1, 0, 0], packed, meta, names)
            order = np.lexsort(coord.T), np.lexsort((local + [4, 0, 0]).T)
            for n, columns in (("c", [0, 1]), ("d", [2])):
                if names is None or n in names:
                    assert (named[n][order[0]] == attrs[order[1]][:, columns]).all()
                else:
                    assert n not in named


def test_mesh_files_stay_whole_when_counts_are_small(spark, tmp_path):
    """Many meshes over many partitions: a file's vertices and faces are written by one task."""
    v = spark.range(0, 12800, 1, 8).selectExpr("id div 64 as mesh", "id % 64 as vid", "id * 0.5D as x", "0D as y", "1D as z")
    f = v.filter("vid < 62").repartition(8).selectExpr("mesh", "vid as fid", "array(cast(vid as int), cast(vid + 1 as int), cast(vid + 2 as int)) as corners")
    path = str(tmp_path / "meshes")
    # as for large tables: a join is planned by sorting and turned into a broadcast once the sizes are known
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, value in conf.items():
        spark.conf.set(k, value)
    try:
        files.write_mesh(v, f, path)
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
    files.register(spark)
    found = {r[0]: r["count"] for r in spark.read.format("meshply").load(path).groupBy("element").count().collect()}
    assert found == {"vertex": 12800, "tri": 200 * 62}
