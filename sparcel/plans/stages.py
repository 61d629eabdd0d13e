"""Whole stages: what is left to do, running a function per instance, opening a dataset."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparcel.functions.nulls import is_true, not_true
from sparcel.operators.instances import map_instances, open_dataset, open_roots, split_results, worklist
from sparcel.operators.mesh import flatten_objects
from sparcel.plans.catalog import query
from sparcel.session import staged_path
from sparcel.sources import catalogue, dumps, stages
from sparcel.tables import load


@query(
    "stage_worklist",
    "J2 P3 P4 P6 W1 M1 M2",
    """
    WITH t AS (SELECT d.doc_id, d.n_chars, coalesce(CAST(l.quality AS DOUBLE), NULL) AS score, l.toxic = 0 AS dumped, e.label > 4 AS done_256, e.label > 6 AS done_512
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
    w AS (SELECT * FROM t WHERE score >= 1 AND dumped AND (done_256 IS DISTINCT FROM TRUE OR done_512 IS DISTINCT FROM TRUE))
    SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS pos, CAST((row_number() OVER (ORDER BY doc_id) * 5 - 1) // count(*) OVER () AS INTEGER) AS shard FROM w
    """,
)
def stage_worklist(spark, d):
    root = load(spark, d, "documents").select("doc_id", "n_chars")
    scores = load(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("score"), (F.col("toxic") == 0).alias("dumped"))
    done = load(spark, d, "embeddings").join(root.select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left_semi").select(
        F.col("vec_id").alias("doc_id"), (F.col("label") > 4).alias("done_256"), (F.col("label") > 6).alias("done_512")
    )
    ready = [F.col("score") >= 1, is_true(F.col("dumped"))]
    return worklist([root, scores, done], "doc_id", ready, ["done_256", "done_512"], 5).select("doc_id", "n_chars", "pos", "shard")


def measure(row: dict) -> dict:
    """A stand-in for a per-asset kernel: it refuses texts without a line break."""
    lines = row["text"].split("\n")
    if len(lines) < 2:
        raise ValueError("single line")
    return {"done": True, "num_lines": len(lines), "longest": max(len(line) for line in lines)}


@query(
    "instance_map",
    "P18 S22 T2 M3",
    """
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
    SELECT doc_id, CASE WHEN len(lines) >= 2 THEN TRUE END AS done, CASE WHEN len(lines) >= 2 THEN CAST(len(lines) AS BIGINT) END AS num_lines,
           CASE WHEN len(lines) >= 2 THEN CAST(list_max(list_transform(lines, lambda x: length(x))) AS BIGINT) END AS longest,
           CASE WHEN len(lines) < 2 THEN 'single line' END AS error FROM l
    """,
)
def instance_map(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    return map_instances(docs, "doc_id", measure, "done boolean, num_lines bigint, longest bigint")


@query(
    "stage_records_and_errors",
    "S4 S22 P18",
    """
    WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)
    SELECT CASE WHEN n >= 2 THEN 'record' ELSE 'error' END AS kind, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS keys FROM l GROUP BY 1
    """,
)
def stage_records_and_errors(spark, d):
    """One run, two sinks: records appended to the log, failed keys to a text file; both read back."""
    from sparcel.session import stage

    results = stage(instance_map(spark, d), "results")
    good, bad = split_results(results, "doc_id", "done")
    path = staged_path(spark, "run")
    catalogue.append_records(good, path)
    catalogue.write_errors(bad, "doc_id", f"{path}/errors")
    records = spark.read.option("header", True).schema("doc_id bigint, done boolean, num_lines bigint, longest bigint").csv(f"{path}/new_records")
    errors = spark.read.text(f"{path}/errors").select(F.col("value").cast("bigint").alias("doc_id"))
    both = records.select(F.lit("record").alias("kind"), "doc_id").unionByName(errors.select(F.lit("error").alias("kind"), "doc_id"))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("keys"))


def dataset_roots(spark, d):
    labels = load(spark, d, "labels")
    docs = load(spark, d, "documents").select("doc_id", "n_chars", "lang")
    score = labels.select("doc_id", F.col("quality").cast("double").alias("score"))
    flags = labels.select("doc_id", (F.col("toxic") == 1).alias("flagged"))
    chats = load(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sum(F.length("text").cast("bigint")).alias("n_chars"))
    return {"documents": [docs, score, flags], "conversations": [chats]}



def steps():
    return [("sized", F.col("n_chars") <= 4000), ("clean", not_true(F.col("flagged"))), ("scored", F.col("score") >= 1)]


DATASET_SQL = """t AS (SELECT 'documents' AS dataset, d.doc_id, d.n_chars, CAST(l.quality AS DOUBLE) AS score, l.toxic = 1 AS flagged FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'conversations', conv_id, CAST(sum(length(text)) AS BIGINT), NULL, NULL FROM conversations GROUP BY conv_id)"""


COUNTS_SQL = f"""WITH {DATASET_SQL} SELECT dataset, count(*) AS total, count(*) FILTER (WHERE n_chars <= 4000) AS sized,
    count(*) FILTER (WHERE n_chars <= 4000 AND flagged IS DISTINCT FROM TRUE) AS clean, count(*) FILTER (WHERE n_chars <= 4000 AND flagged IS DISTINCT FROM TRUE AND score >= 1) AS scored FROM t GROUP BY dataset"""


@query("dataset_counts", "S7 J2 U1 P9 A3 M4", COUNTS_SQL)
def dataset_counts(spark, d):
    return open_dataset(dataset_roots(spark, d), "doc_id", steps())[1]


@query(
    "dataset_instances",
    "S7 J2 U1 P9",
    f"""WITH {DATASET_SQL} SELECT dataset, doc_id, n_chars FROM t WHERE n_chars <= 4000 AND flagged IS DISTINCT FROM TRUE""",
)
def dataset_instances(spark, d):
    return open_dataset(dataset_roots(spark, d), "doc_id", steps()[:2])[0].select("dataset", "doc_id", "n_chars")


def dumped_objects(spark, d):
    """A customer's orders as the objects of one asset."""
    points = "transform(if(o_orderkey % 11 > 0, sequence(1, o_orderkey % 11), array()), i -> named_struct('x', cast(i as double), 'y', 0D, 'z', 0D))"
    faces = "transform(if(o_orderkey % 5 > 0, sequence(1, o_orderkey % 5), array()), i -> named_struct('v0', 0, 'v1', 1, 'v2', cast(i as int)))"
    return load(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("asset"), F.col("o_orderkey").alias("obj"), F.expr(points).alias("vertices"), F.expr(faces).alias("faces"),
    )


@query(
    "dump_stats",
    "S18 M11 A4 P13",
    """
    SELECT CAST(o_custkey AS VARCHAR) AS asset, CAST(coalesce(sum(o_orderkey % 11) FILTER (WHERE o_orderkey % 11 > 0 AND o_orderkey % 5 > 0), 0) AS BIGINT) AS num_vertices,
           CAST(coalesce(sum(o_orderkey % 5) FILTER (WHERE o_orderkey % 11 > 0 AND o_orderkey % 5 > 0), 0) AS BIGINT) AS num_faces, CAST(NULL AS INTEGER) AS num_alpha_tex
    FROM orders GROUP BY 1
    """,
)
def dump_stats(spark, d):
    """Whole assets, kept as a row per object."""
    path = staged_path(spark, "dumps")
    dumped_objects(spark, d).write.parquet(path)
    objects = spark.read.schema(dumps.OBJECT_ROWS).parquet(path)
    return dumps.object_stats(objects).select("asset", "num_vertices", "num_faces", "num_alpha_tex")


@query(
    "dump_objects",
    "S18 M11 G3",
    """
    WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS asset, o_orderkey, CAST(o_orderkey % 11 AS BIGINT) AS nv, CAST(o_orderkey % 5 AS BIGINT) AS nf FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey % 5 > 0),
    p AS (SELECT *, CAST(sum(nv) OVER w AS BIGINT) - nv AS voff, CAST(sum(nf) OVER w AS BIGINT) - nf AS foff FROM o WINDOW w AS (PARTITION BY asset ORDER BY o_orderkey))
    SELECT asset, CAST(foff + i AS BIGINT) AS fid, voff AS v0, voff + 1 AS v1, CAST(voff + i + 1 AS BIGINT) AS v2 FROM p, range(0, 5) r(i) WHERE i < nf
    """,
)
def dump_objects(spark, d):
    path = staged_path(spark, "dumps")
    dumped_objects(spark, d).write.parquet(path)
    _, faces = flatten_objects(spark.read.schema(dumps.OBJECT_ROWS).parquet(path), "asset", "obj")
    return faces


@query(
    "pbr_dump_stats",
    "S18 M11 A4",
    """
    SELECT CAST(l_orderkey AS VARCHAR) AS asset, CAST(sum(CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber + 2 ELSE 0 END) AS BIGINT) AS num_vertices, CAST(sum(CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber ELSE 0 END) AS BIGINT) AS num_faces,
      CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS INTEGER) AS num_base_color_tex, CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS INTEGER) AS num_metallic_tex, CAST(count(*) FILTER (WHERE l_discount > 0.05) AS INTEGER) AS num_roughness_tex,
      0::INTEGER AS num_alpha_tex
    FROM lineitem GROUP BY l_orderkey
    """,
)
def pbr_dump_stats(spark, d):
    """PBR dumps written with their materials, read with their schema, and counted by rows of objects and of materials."""
    path = staged_path(spark, "pbr")
    image = "named_struct('image', unhex('00'), 'interpolation', 'Linear', 'extension', 'REPEAT')"

    def texture(name, condition):
        return F.expr(f"if({condition}, {image}, null)").alias(f"{name}_texture")

    factors = [F.array(*[F.lit(1.0)] * 3).alias("base_color_factor"), *[F.lit(0.5).alias(f"{n}_factor") for n in ("metallic", "roughness", "alpha")], F.lit("OPAQUE").alias("alpha_mode"), F.lit(0.5).alias("alpha_cutoff")]
    material = F.struct(*factors, texture("base_color", "l_returnflag = 'R'"), texture("metallic", "l_linestatus = 'O'"), texture("roughness", "l_discount > 0.05"), texture("alpha", "false"))
    points = "transform(sequence(1, l_linenumber + 2), i -> named_struct('x', cast(i as double), 'y', 0D, 'z', 0D))"
    faces = "transform(if(l_linenumber % 3 > 0, sequence(1, l_linenumber), array()), i -> named_struct('v0', 0, 'v1', cast(i as int), 'v2', cast(i + 1 as int)))"
    body = F.expr(f"named_struct('vertices', {points}, 'faces', {faces}, 'normals', array(), 'uvs', array(), 'mat_ids', array())")
    items = load(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("asset"), material.alias("m"), body.alias("o"))
    dumps.write_dumps(items.groupBy("asset").agg(F.collect_list("m").alias("materials"), F.collect_list("o").alias("objects")), path, materials=True)
    read = dumps.read_dumps(spark, path, materials=True)
    return dumps.object_stats(dumps.object_rows(read), dumps.material_rows(read))


def _configured(spark, d):
    """Folders of two datasets: a published stage table, its labels as CSV, and a CSV of its own columns."""
    root = staged_path(spark, "roots")
    for name, tables in dataset_roots(spark, d).items():
        for role, table in zip(("base", "score", "flags"), tables):
            if role == "base":
                rows = table.select("doc_id", "n_chars", F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("flagged"), F.struct(F.lit(1).alias("at")).alias("_seq"))
                stages.merge_records(rows, f"{root}/{name}/{role}", ["doc_id"], "_seq")
            else:
                table.write.option("header", True).csv(f"{root}/{name}/{role}/metadata.csv")
    return root


CONFIG = T.StructType().add("doc_id", "long").add("n_chars", "long").add("score", "double").add("flagged", "boolean")


@query("configured_counts", "S7 J2 U1 P9 A3 M4", COUNTS_SQL)
def configured_counts(spark, d):
    """Datasets opened from a JSON configuration of folders."""
    root = _configured(spark, d)
    config = {"documents": {r: f"{root}/documents/{r}" for r in ("base", "score", "flags")}, "conversations": {"base": f"{root}/conversations/base"}}
    return open_roots(spark, json.dumps(config), CONFIG, "doc_id", steps())[1]


@query("listed_instances", "S7 U1 P9", "SELECT 'documents' AS dataset, doc_id, n_chars FROM documents WHERE n_chars <= 4000 UNION ALL SELECT 'conversations', conv_id, CAST(sum(length(text)) AS BIGINT) FROM conversations GROUP BY conv_id HAVING sum(length(text)) <= 4000")
def listed_instances(spark, d):
    """Datasets opened from a comma list of folders, named by their last part."""
    root = staged_path(spark, "listed")
    for name, tables in dataset_roots(spark, d).items():
        tables[0].select("doc_id", "n_chars").write.option("header", True).csv(f"{root}/{name}/metadata.csv")
    return open_roots(spark, f"{root}/documents, {root}/conversations/", CONFIG, "doc_id", steps()[:1])[0].select("dataset", "doc_id", "n_chars")
