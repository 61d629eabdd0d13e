"""Metadata files of an asset catalogue: stage tables, record parts, instance lists, finished outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop)
    return found is not None and len(found) > 0


def read_stage(spark: SparkSession, path: str, schema: T.StructType, tolerant: bool = False) -> DataFrame:
    """A CSV stage table; a missing path reads as an empty table of the same schema.

    Columns are matched by header name. ``tolerant`` leaves rows that do not parse to
    ``rejected_rows`` instead of failing the job.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    if tolerant:
        return _with_rejects(spark, path, schema).filter(f"{REJECT} is null").drop(REJECT)
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


REJECT = "_corrupt_record"


def _with_rejects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECT)
    return all_parsed(reader.schema(T.StructType([*schema.fields, T.StructField(REJECT, T.StringType())])).csv(path), schema)


def all_parsed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Keep all columns in the plan: a scan of some of them parses no others, and does not see what is wrong with a line."""
    return df.filter(F.size(F.array(*[F.col(f.name).cast("string") for f in schema.fields])) > 0)


def rejected_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line) of the rows that ``read_stage`` leaves out when tolerant."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "file string, line string")
    whole = _with_rejects(spark, path, schema).withColumn("file", F.col("_metadata.file_path"))
    return whole.filter(F.col(REJECT).isNotNull()).select("file", F.col(REJECT).alias("line"))


def append_records(df: DataFrame, stage_dir: str) -> None:
    """Append one worker's records to the stage's record log."""
    df.write.mode("append").option("header", True).csv(f"{stage_dir}/new_records")


def read_partitioned(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Stage tables laid out by resolution or model: partition columns come from the folder names."""
    return spark.read.schema(schema).parquet(root)


def pick_instances(df: DataFrame, key: str, wanted: str | DataFrame) -> DataFrame:
    """Keep the listed instances: a DataFrame of names, a comma list, or a text file of lines."""
    spark = df.sparkSession
    if isinstance(wanted, str):
        if _exists(spark, wanted):
            wanted = spark.read.text(wanted).select(F.col("value").alias("instance"))
        else:
            names = spark.createDataFrame([(wanted,)], "names string")
            wanted = names.select(F.explode(F.split("names", ",")).alias("instance"))
    listed = wanted.select(F.col(wanted.columns[0]).alias("_instance"))
    return df.join(listed, F.col(key).cast("string") == F.col("_instance"), "left_semi")


def finished_outputs(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Keys of outputs that already exist, from file names alone (contents are not read)."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "length")
    )
    name = F.substring_index("path", "/", -1)
    return files.select(F.regexp_replace(name, rf"\{suffix}$", "").alias("key"), "length")


def write_report(df: DataFrame, path: str) -> None:
    """One text line per (stage, part, n) row, sorted; the report is as small as the stage list."""
    line = F.concat_ws(" ", F.lit(" -"), F.col("stage"), F.col("part"), F.col("n").cast("string"))
    df.orderBy("stage", "part").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_errors(df: DataFrame, key: str, path: str) -> None:
    """Keys of the rows that carry an error, one per line."""
    df.filter(F.col("error").isNotNull()).select(F.col(key).cast("string").alias("value")).write.mode(
        "overwrite"
    ).text(path)
