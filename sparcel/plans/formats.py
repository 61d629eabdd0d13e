"""File format queries: derived tables are written in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparcel.operators.ordered import group_position
from sparcel.plans.catalog import query
from sparcel.plans.cells import with_cells
from sparcel.session import staged_path
from sparcel.sources import catalogue, files, logs, stages
from sparcel.tables import cells, load

VOXEL_SQL = with_cells(
    """SELECT CAST(batch AS VARCHAR) AS file, x, y, z, CAST(CAST(qty * 7 AS BIGINT) % 256 AS INTEGER) AS look0,
    CAST(CAST(floor(price) AS BIGINT) % 256 AS INTEGER) AS look1, CAST(fa + 2 * fb + 4 * fc AS INTEGER) AS flags FROM cells"""
)


def voxels(spark, d):
    return cells(spark, d).select(
        "batch", "x", "y", "z",
        F.array(F.expr("cast(cast(qty * 7 as bigint) % 256 as int)"), F.expr("cast(cast(floor(price) as bigint) % 256 as int)")).alias("look"),
        (F.col("fa") + 2 * F.col("fb") + 4 * F.col("fc")).alias("flags"),
    )


def round_trip(spark, d, kind, **options):
    path = staged_path(spark, kind)
    files.write_cells(voxels(spark, d), path, kind, "batch", ["look", "flags"], **options)
    back = files.read_cells(spark, path, kind)
    return back.select("file", "x", "y", "z", F.get("look", F.lit(0)).alias("look0"), F.get("look", F.lit(1)).alias("look1"), "flags")


@query("vxz_round_trip", "S11 S12 S25 S15", VOXEL_SQL)
def vxz_round_trip(spark, d):
    return round_trip(spark, d, "vxz", chunkSize=32)


@query("vxz_parent_filter", "S11 S12 S25 F7", VOXEL_SQL)
def vxz_parent_filter(spark, d):
    return round_trip(spark, d, "vxz", chunkSize=16, filter="parent", compression="deflate", interleave="all")


@query("vxz_neighbor_filter", "S11 S12 S25 F6", VOXEL_SQL)
def vxz_neighbor_filter(spark, d):
    return round_trip(spark, d, "vxz", chunkSize=64, filter="neighbor", compression="none", interleave="none")


@query("npz_round_trip", "S13 S15 M14", VOXEL_SQL)
def npz_round_trip(spark, d):
    return round_trip(spark, d, "npz")


@query("voxel_ply_round_trip", "S14 S15 F37", VOXEL_SQL)
def voxel_ply_round_trip(spark, d):
    return round_trip(spark, d, "voxelply")


@query(
    "vxz_headers",
    "S10 M7",
    with_cells(
        """SELECT CAST(batch AS VARCHAR) AS file, count(*) AS num_voxel, CAST(32 AS INTEGER) AS chunk_size, 'deflate' AS compression, CAST(9 AS INTEGER) AS compression_level,
        count(*) * 15 AS raw_size, 'as_is' AS attr_interleave, CAST(count(DISTINCT (x // 32, y // 32, z // 32)) AS INTEGER) AS num_chunks, 'look:2,flags:1' AS attr FROM cells GROUP BY batch"""
    ),
)
def vxz_headers(spark, d):
    path = staged_path(spark, "vxz")
    files.write_cells(voxels(spark, d), path, "vxz", "batch", ["look", "flags"], chunkSize=32, compression="deflate")
    names = F.transform("attr", lambda a: F.concat_ws(":", a["name"], a["channels"].cast("string")))
    return files.read_headers(spark, path).select(
        "file", "num_voxel", "chunk_size", "compression", "compression_level", "raw_size", "attr_interleave", "num_chunks",
        F.array_join(names, ",").alias("attr"),
    )


BOX = ((8, 0, 2), (40, 32, None))
BOX_WHERE = "x >= 8 AND x < 40 AND y >= 0 AND y < 32 AND z >= 2"


@query("vxz_box_scan", "S10 S11", f"SELECT file, x, y, z, flags FROM ({VOXEL_SQL}) AS v WHERE {BOX_WHERE}")
def vxz_box_scan(spark, d):
    """One attribute of the cells in a box: of the containers only headers, and the octree and that attribute of chunks that meet the box, are read."""
    path = staged_path(spark, "vxz")
    files.write_cells(voxels(spark, d), path, "vxz", "batch", ["look", "flags"], chunkSize=16, compression="deflate", interleave="none")
    return files.scan_cells(spark, path, {"flags": "int"}, *BOX)


@query("vxz_pushed_filter", "S11", f"SELECT file, x, y, z, flags, look1 FROM ({VOXEL_SQL}) AS v WHERE {BOX_WHERE} AND file IN ('0', '3', '7')")
def vxz_pushed_filter(spark, d):
    """Conditions on a container read as a table: the reader skips files by name and chunks by box."""
    path = staged_path(spark, "vxz")
    files.write_cells(voxels(spark, d), path, "vxz", "batch", ["look", "flags"], chunkSize=16, compression="deflate", filter="parent")
    table = files.read_cells(spark, path, "vxz").filter(F.col("file").isin("0", "3", "7")).filter(BOX_WHERE)
    return table.select("file", "x", "y", "z", "flags", F.get("look", F.lit(1)).alias("look1"))


@query(
    "finished_files",
    "S9 U5 J4",
    with_cells("SELECT CAST(batch * 8 + x // 8 AS INTEGER) AS asset, count(*) AS n FROM cells WHERE (batch * 8 + x // 8) % 2 = 1 GROUP BY 1"),
)
def finished_files(spark, d):
    """Assets (slabs of a batch) without an output file yet: listing by name, then an anti join."""
    path = staged_path(spark, "done")
    table = voxels(spark, d).withColumn("asset", F.expr("cast(batch * 8 + x div 8 as int)"))
    files.write_cells(table.filter("asset % 2 = 0"), path, "npz", "asset", ["flags"])
    done = catalogue.finished_outputs(spark, path, ".npz").select("key")
    todo = table.groupBy("asset").agg(F.count(F.lit(1)).alias("n"))
    return todo.join(done, F.col("asset").cast("string") == F.col("key"), "left_anti")


@query(
    "mesh_ply_round_trip",
    "S16 S17 M8",
    """
    WITH v AS (SELECT vec_id // 64 AS mesh, vec_id % 64 AS id, embedding[1] AS x, embedding[2] AS y, embedding[3] AS z FROM embeddings)
    SELECT CAST(mesh AS VARCHAR) AS file, 'vertex' AS element, id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, '' AS corners FROM v
    UNION ALL
    SELECT CAST(a.mesh AS VARCHAR), 'tri', a.id, NULL, NULL, NULL, concat_ws(',', a.id, a.id + 1, a.id + 2)
    FROM v a JOIN v b ON b.mesh = a.mesh AND b.id = a.id + 2
    """,
)
def mesh_ply_round_trip(spark, d):
    path = staged_path(spark, "meshply")
    e = [F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")]
    table = load(spark, d, "embeddings")
    v = table.select(F.expr("vec_id div 64").alias("mesh"), F.expr("vec_id % 64").alias("vid"), *e)
    third = v.select("mesh", (F.col("vid") - 2).alias("vid"))
    f = v.select("mesh", "vid").join(third, ["mesh", "vid"]).select(
        "mesh", F.col("vid").alias("fid"), F.array(*[(F.col("vid") + i).cast("int") for i in range(3)]).alias("corners")
    )
    files.write_mesh(v, f, path)
    files.register(spark)
    back = spark.read.format("meshply").load(path)
    return back.withColumn("corners", F.coalesce(F.array_join("corners", ","), F.lit("")))


@query(
    "camera_documents",
    "S20 M13",
    """
    SELECT CAST(l_orderkey AS VARCHAR) AS asset, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS INTEGER) AS idx,
           printf('%03d.png', l_linenumber) AS file_path, round(l_discount * 3, 6) AS camera_angle_x, l_extendedprice AS tx
    FROM lineitem
    """,
)
def camera_documents(spark, d):
    items = load(spark, d, "lineitem")
    zero, one = F.lit(0.0), F.lit(1.0)
    views = items.select(
        F.col("l_orderkey").alias("asset"), "l_linenumber", "l_partkey", "l_extendedprice",
        F.format_string("%03d.png", "l_linenumber").alias("file_path"), (F.col("l_discount") * 3).alias("camera_angle_x"),
        F.array(F.array(one, zero, zero, F.col("l_extendedprice")), F.array(zero, one, zero, zero), F.array(zero, zero, one, zero), F.array(zero, zero, zero, one)).alias("transform_matrix"),
    )
    numbered = group_position(views, ["asset"], ["l_linenumber", "l_partkey", "l_extendedprice"], "idx")
    path = staged_path(spark, "views")
    logs.write_views(numbered, "asset", path)
    return logs.read_views(spark, path).select(
        "asset", "idx", "file_path", F.round("camera_angle_x", 6).alias("camera_angle_x"), F.expr("transform_matrix[0][3]").alias("tx")
    )


@query(
    "step_log_round_trip",
    "S24 M15 F34",
    """
    SELECT event_id AS step, 'loss' AS key, value FROM events
    UNION ALL SELECT event_id, 'loss/k', CAST(json_extract(props, '$.k') AS DOUBLE) FROM events
    """,
)
def step_log_round_trip(spark, d):
    path = staged_path(spark, "log")
    events = load(spark, d, "events")
    lines = events.select(
        F.concat(F.col("event_id").cast("string"), F.lit(": "), F.to_json(F.create_map(F.lit("loss"), F.col("value")))).alias("value")
    ).union(
        events.select(F.concat(F.col("event_id").cast("string"), F.lit(': {"loss":'), F.col("props"), F.lit("}")))
    )
    lines.write.text(path)
    return logs.read_step_log(spark, path)


STAGE = T.StructType().add("sha256", "string").add("score", "double").add("flag", "boolean").add("tokens", "long")


@query(
    "stage_csv_compaction",
    "S1 S2 S3 S4 S5 J3 S6 P1",
    """
    WITH log AS (SELECT sha256(text) AS sha256, CASE WHEN doc_id % 3 = 0 THEN n_chars * 0.5::DOUBLE END AS score, CASE WHEN doc_id % 5 = 0 THEN doc_id % 2 = 0 END AS flag, doc_id AS tokens FROM documents)
    SELECT sha256, arg_max(score, tokens) FILTER (WHERE score IS NOT NULL) AS score, arg_max(flag, tokens) FILTER (WHERE flag IS NOT NULL) AS flag, max(tokens) AS tokens FROM log GROUP BY sha256
    """,
)
def stage_csv_compaction(spark, d):
    """Record parts appended as CSV, read with a declared schema, compacted into the stage table."""
    from sparcel.operators.overlay import compact

    path = staged_path(spark, "stage")
    records = load(spark, d, "documents").select(
        F.sha2("text", 256).alias("sha256"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") * 0.5).alias("score"),
        F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") % 2 == 0).alias("flag"), F.col("doc_id").alias("tokens"),
    )
    catalogue.append_records(records.filter("tokens % 2 = 0"), path)
    catalogue.append_records(records.filter("tokens % 2 = 1"), path)
    missing = catalogue.read_stage(spark, f"{path}/absent", STAGE)
    log = catalogue.read_stage(spark, f"{path}/new_records", STAGE, tolerant=True).unionByName(missing)
    log = log.withColumn("seq", F.col("tokens"))
    return compact(log, ["sha256"], ["seq"]).select("sha256", "score", "flag", "tokens")


PUBLISHED_SQL = """
    WITH log AS (
      SELECT sha256(text) AS sha256, doc_id % 3 AS part, max(CASE WHEN doc_id % 2 = 0 THEN n_chars * 0.5::DOUBLE END) AS score, bool_or(CASE WHEN doc_id % 5 = 0 THEN doc_id % 10 = 0 END) AS flag, max(doc_id) AS tokens
      FROM documents GROUP BY 1, 2)
    SELECT sha256, arg_max(score, part) FILTER (WHERE score IS NOT NULL AND part < 2) AS score, arg_max(flag, part) FILTER (WHERE flag IS NOT NULL) AS flag, arg_max(tokens, part) AS tokens FROM log GROUP BY sha256
"""


def _record_part(spark, d, k: int):
    """Records of a third of the documents, unique by key; the last part lacks a column and has another order of columns."""
    docs = load(spark, d, "documents").filter(F.col("doc_id") % 3 == k)
    part = docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(
        F.max(F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") * 0.5)).alias("score"),
        F.bool_or(F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") % 10 == 0)).alias("flag"), F.max("doc_id").alias("tokens"),
    )
    return part if k < 2 else part.select("tokens", "sha256", "flag")


@query("published_compaction", "S5 J3 S1 S2 S3 S4", PUBLISHED_SQL)
def published_compaction(spark, d):
    """Three rounds of record parts, each compacted into the published table and archived; the newest file with a value wins."""
    root = staged_path(spark, "published")
    for k in range(3):
        catalogue.append_records(_record_part(spark, d, k), root)
        stages.compact_parts(spark, root, STAGE, ["sha256"])
    return stages.read_stage_table(spark, root, STAGE, ["sha256"])


@query("archive_rebuild", "S5 J3", PUBLISHED_SQL)
def archive_rebuild(spark, d):
    """The same table built again from the archived parts alone."""
    root, lost = staged_path(spark, "published"), staged_path(spark, "rebuilt")
    for k in range(3):
        catalogue.append_records(_record_part(spark, d, k), root)
        stages.compact_parts(spark, root, STAGE, ["sha256"])
    stages.Folder(spark, lost).move(f"../{root.rsplit('/', 1)[-1]}/merged_records", "merged_records")
    stages.compact_parts(spark, lost, STAGE, ["sha256"], from_archive=True)
    return stages.read_stage_table(spark, lost, STAGE, ["sha256"])


@query(
    "rejected_records",
    "S3",
    "SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 4 = 1) AS bad, min('x' || doc_id) FILTER (WHERE doc_id % 4 = 1) AS first_line, 1::BIGINT AS broken_parts FROM documents",
)
def rejected_records(spark, d):
    """Lines that do not parse are kept apart with their file, and a part that is no CSV is left out of the merge."""
    root = staged_path(spark, "rejects")
    docs = load(spark, d, "documents")
    bad = F.col("doc_id") % 4 == 1
    score = F.when(bad, F.concat(F.lit("x"), F.col("doc_id"))).otherwise(F.lit("1.5"))
    lines = docs.select(F.concat(F.lit("k"), F.col("doc_id")).alias("sha256"), score.alias("score"), F.lit("true").alias("flag"), F.lit("7").alias("tokens"))
    catalogue.append_records(lines, root)
    docs.limit(1).select(F.lit("no header, no keys").alias("value")).coalesce(1).write.mode("append").option("header", False).csv(f"{root}/new_records")
    parts = stages.read_parts(spark, f"{root}/new_records", STAGE, ["sha256"])
    rejected = parts.rejected.agg(F.count(F.lit(1)).alias("bad"), F.min(F.split("line", ",")[1]).alias("first_line"))
    kept = parts.rows.agg(F.count(F.lit(1)).alias("kept"))  # one row each
    return rejected.join(kept, F.lit(True)).select((F.col("kept") + F.col("bad")).alias("n"), "bad", "first_line", F.lit(len(parts.broken)).cast("long").alias("broken_parts"))


@query(
    "partitioned_stage",
    "S6 A2",
    """SELECT CAST(256 * (1 + vec_id % 3) AS INTEGER) AS res, count(*) AS n, CAST(sum((label > 4)::INTEGER) AS BIGINT) AS converted FROM embeddings GROUP BY 1""",
)
def partitioned_stage(spark, d):
    """Stage tables laid out by resolution: folders become the partition column."""
    path = staged_path(spark, "byres")
    table = load(spark, d, "embeddings").select("vec_id", (F.col("label") > 4).alias("converted"), F.expr("cast(256 * (1 + vec_id % 3) as int)").alias("res"))
    table.write.partitionBy("res").parquet(path)
    schema = T.StructType().add("vec_id", "long").add("converted", "boolean").add("res", "integer")
    back = catalogue.read_partitioned(spark, path, schema)
    return back.groupBy("res").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("converted").cast("int")).alias("converted"))
