"""Camera files and step logs: JSON and text sources with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparcel.operators.nested import flatten_objects, nesting

VIEWS_SCHEMA = (
    "aabb array<array<double>>, scale double, offset array<double>, "
    "frames array<struct<file_path:string,camera_angle_x:double,transform_matrix:array<array<double>>>>"
)


def write_views(views: DataFrame, asset: str, path: str) -> None:
    """Camera documents from rows (asset, idx, file_path, camera_angle_x, transform_matrix): one per asset.

    Frames stand in the order of ``idx``. The format has one document for an asset, so an asset's frames
    must fit a row.
    """
    frame = F.struct("file_path", "camera_angle_x", "transform_matrix")
    docs = views.groupBy(asset).agg(F.sort_array(F.collect_list(F.struct("idx", frame.alias("frame")))).alias("f"))
    unit = F.array(*[F.array(*[F.lit(v)] * 3) for v in (-0.5, 0.5)])
    doc = docs.select(
        F.col(asset).cast("string").alias("asset"), unit.alias("aabb"), F.lit(1.0).alias("scale"),
        F.array(*[F.lit(0.0)] * 3).alias("offset"), F.transform("f", lambda f: f["frame"]).alias("frames"),
    )
    doc.write.json(path)


def read_views(spark: SparkSession, path: str, single_files: bool = False) -> DataFrame:
    """One row per camera frame.

    Documents are lines with their asset name, or with ``single_files`` one
    ``<asset>/transforms.json`` per folder, the asset being the folder's name.
    """
    if single_files:
        docs = spark.read.schema(VIEWS_SCHEMA).option("multiLine", True).json(f"{path}/*/transforms.json")
        docs = docs.withColumn("asset", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    else:
        docs = spark.read.schema("asset string, " + VIEWS_SCHEMA).json(path)
    return docs.select("asset", F.posexplode("frames").alias("idx", "frame")).select("asset", "idx", "frame.*")


def write_step_log(steps: DataFrame, path: str) -> None:
    """Lines ``step: {json}`` from columns step and metrics (a map)."""
    line = F.concat(F.col("step").cast("string"), F.lit(": "), F.to_json("metrics"))
    steps.select(line.alias("value")).write.mode("append").text(path)


def read_step_log(spark: SparkSession, path: str) -> DataFrame:
    """(step, key, value) of every metric; nested objects are flattened with ``/``, whatever their depth.

    Lines that are no ``step: {json}``, that give a key twice or that nest deeper than the JSON parser goes (1,000) are left
    to ``rejected_log_lines``; leaves that are no numbers, nulls among them, have a null value.
    """
    lines = _log_lines(spark, path).filter("step is not null and doc is not null")
    depth = lines.agg(F.max(nesting("value"))).first()[0] or 0
    flat = flatten_objects(lines.select("step", "doc"), ["step"], "doc", depth)
    return flat.select("step", "key", F.expr("try_cast(try_cast(value AS string) AS double)").alias("value"))


def _log_lines(spark: SparkSession, path: str) -> DataFrame:
    head = F.regexp_extract("value", r"^(\d+): ", 1)
    text = F.regexp_replace("value", r"^\d+: ", "")
    # numbers that JSON doesn't know are put into quotes where the text is no JSON without
    quoted = F.regexp_replace(text, r"([:,\[]\s*)(NaN|-?Infinity)(?=\s*[,}\]])", '$1"$2"')
    doc = F.when((head != "") & text.startswith("{"), F.coalesce(F.try_parse_json(text), F.try_parse_json(quoted)))
    return spark.read.text(path).select("value", head.try_cast("bigint").alias("step"), doc.alias("doc"))


def rejected_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no ``step: {json}``."""
    return _log_lines(spark, path).filter("step is null or doc is null").select("value")
