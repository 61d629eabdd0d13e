"""Stage tables that are published: record parts are merged into buckets, a manifest swaps them in, the parts are archived.

::

    <root>/new_records/*.csv               record parts that workers append
    <root>/table/<name>/bucket=<b>/...     rows, one folder of buckets per merge
    <root>/manifest/<version>.json         which folder holds each bucket, and the parts that went in
    <root>/merged_records/<version>/*.csv  archived parts

Each value is stored with the sequence of the record it came from, for record parts the time and the name of the
file. Per key and column the greatest sequence wins, so merging is the same in any order and any number of times: a merge that
was cut short, before or after its manifest, is simply done again. A merge reads and writes only the buckets that
the new records touch. A reader sees the buckets of one manifest; the old ones stay until ``vacuum``.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparcel.sources.catalogue import REJECT, all_parsed
from sparcel.sources.files import filesystem, listed, local

BUCKETS = 64
PART_SEQ = T.StructType([T.StructField("time", T.TimestampType()), T.StructField("name", T.StringType())])


class Folder:
    """File operations below a root, on the filesystem that Spark resolves it to."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def create(self, name: str, text: str) -> None:
        """A new file; one that is there already is an error, so of two writers one fails."""
        self.fs.mkdirs(self._path(name).getParent())
        out = self.fs.create(self._path(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        handle = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(handle)).decode()
        finally:
            handle.close()

    def move(self, name: str, to: str) -> None:
        self.fs.mkdirs(self._path(to).getParent())
        if not self.fs.rename(self._path(name), self._path(to)):
            raise OSError(f"cannot move {name} to {to}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    places: dict[int, str]
    parts: list[str]


def current(spark: SparkSession, root: str) -> Manifest:
    """The newest whole manifest; one that a crash cut short counts for nothing but its number."""
    folder = Folder(spark, root)
    for name in reversed(folder.names("manifest")):
        if name.endswith(".json"):
            try:
                held = json.loads(folder.read(f"manifest/{name}"))
            except ValueError:
                continue
            return Manifest(held["version"], held["buckets"], {int(b): p for b, p in held["places"].items()}, held["parts"])
    return Manifest(0, BUCKETS, {}, [])


def _stored(keys: T.StructType, values: T.StructType, seq: T.DataType) -> T.StructType:
    pairs = [T.StructField(f.name, T.StructType([T.StructField("seq", seq), T.StructField("value", f.dataType)])) for f in values]
    return T.StructType([*keys.fields, *pairs])


def _held(spark: SparkSession, root: str, manifest: Manifest, schema: T.StructType, buckets: set[int] | None = None) -> DataFrame:
    paths = [f"{root.rstrip('/')}/table/{place}/bucket={b}" for b, place in manifest.places.items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _seq_type(spark: SparkSession, root: str, manifest: Manifest, value: str) -> T.DataType:
    if not manifest.places:
        return PART_SEQ
    b, place = next(iter(manifest.places.items()))
    return spark.read.parquet(f"{root.rstrip('/')}/table/{place}/bucket={b}").schema[value].dataType["seq"].dataType


def read_stage_table(spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Rows of the published table, empty before the first merge. ``schema`` has the keys and the values."""
    manifest = current(spark, root)
    values = T.StructType([f for f in schema if f.name not in keys])
    stored = _stored(T.StructType([schema[k] for k in keys]), values, _seq_type(spark, root, manifest, values.fields[0].name))
    return _held(spark, root, manifest, stored).select(*keys, *[F.col(f.name)["value"].alias(f.name) for f in values])


def merge_records(rows: DataFrame, root: str, keys: Sequence[str], seq: str, parts: Sequence[str] = (), buckets: int | None = None) -> Manifest:
    """Merge ``rows`` (keys, values and the column ``seq``) into the table below ``root`` and publish the result.

    Per key and column the value of the greatest ``seq`` wins, missing values (null, NaN) never do. Rows are combined before they are shuffled,
    so a key may have any share of them. The number of buckets is fixed by the first merge.
    """
    spark = rows.sparkSession
    folder, before = Folder(spark, root), current(spark, root)
    count = before.buckets if before.places else buckets or before.buckets
    values = [f for f in rows.schema if f.name not in (*keys, seq)]

    def present(f: T.StructField):
        missing = F.col(f.name).isNull() | F.isnan(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name).isNull()
        return F.when(~missing, F.struct(F.col(seq).alias("seq"), F.col(f.name).alias("value")))

    newest = rows.groupBy(*keys).agg(*[F.max(present(f)).alias(f.name) for f in values])
    bucket = F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), F.lit(count)).cast("int")
    newest = newest.withColumn("bucket", bucket)
    name = uuid.uuid4().hex
    staged = f"{folder.root}/incoming/{name}"
    newest.write.parquet(staged)  # read twice: for the buckets and for the merge
    newest = spark.read.schema(newest.schema).parquet(staged)
    touched = {r.bucket for r in newest.select("bucket").distinct().collect()}  # at most one row a bucket
    stored = _stored(T.StructType([rows.schema[k] for k in keys]), T.StructType(values), rows.schema[seq].dataType)
    old = _held(spark, root, before, stored, touched).withColumn("bucket", bucket)
    both = newest.unionByName(old).repartition("bucket")
    both.groupBy("bucket", *keys).agg(*[F.max(f.name).alias(f.name) for f in values]).write.partitionBy("bucket").parquet(f"{folder.root}/table/{name}")
    taken = [int(n.split(".")[0]) for n in folder.names("manifest")]
    after = Manifest(max([before.version, *taken]) + 1, count, before.places | {b: name for b in touched}, list(parts))
    folder.create(f"manifest/{after.version:012d}.json", json.dumps({"version": after.version, "buckets": count, "places": after.places, "parts": after.parts}))
    folder.delete(f"incoming/{name}")
    return after


def part_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(path, header) of each record part, read by the tasks; a part that is no text or has no header line has a null header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                fs, inner = filesystem(local(path))
                with fs.open_input_file(inner) as handle:
                    start = handle.read(1 << 16)
                try:
                    head = start.split(b"\n", 1)[0].decode().rstrip("\r") if b"\n" in start and b"\0" not in start else None
                except UnicodeDecodeError:
                    head = None
                found.append(head or None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "header"])

    return listed(spark, folder, ".csv").select("path").mapInArrow(run, "path string, header string")


@dataclass
class Parts:
    """Rows of the parts that could be read with their sequence in ``_seq``, lines that could not, the names taken in and the paths left out."""

    rows: DataFrame
    rejected: DataFrame
    names: list[str]
    broken: list[str]


def read_parts(spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str]) -> Parts:
    """Record parts with any of the columns of ``schema`` in any order; those without the keys, or that are no CSV, are left out.

    A part's sequence is its time and name as Spark lists them.
    """
    layouts: dict[tuple[str, ...], list[str]] = {}
    broken = []
    for path, header in part_headers(spark, folder).collect():  # one row a file
        names = tuple(next(csv.reader(io.StringIO(header)), ())) if header else ()
        if set(keys) <= set(names) and len(set(names)) == len(names):
            layouts.setdefault(names, []).append(path)
        else:
            broken.append(path)
    whole = T.StructType([*schema.fields, T.StructField("_seq", PART_SEQ), T.StructField(REJECT, T.StringType())])
    rows = spark.createDataFrame([], whole)
    for names, paths in layouts.items():
        given = T.StructType([schema[n] if n in schema.names else T.StructField(n, T.StringType()) for n in names])
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECT)
        read = reader.schema(T.StructType([*given.fields, T.StructField(REJECT, T.StringType())])).csv(paths)
        seq = F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_name").alias("name"))
        columns = [F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        rows = rows.unionByName(all_parsed(read.withColumn("_seq", seq), given).select(*columns, "_seq", REJECT))
    good = rows.filter(f"{REJECT} is null").drop(REJECT)
    bad = rows.filter(f"{REJECT} is not null").select(F.col("_seq.name").alias("file"), F.col(REJECT).alias("line"))
    return Parts(good, bad, [p.rsplit("/", 1)[-1] for paths in layouts.values() for p in paths], broken)


def archive(spark: SparkSession, root: str, manifest: Manifest) -> list[str]:
    """Move the parts that a manifest names out of the way of the next merge; those already moved are passed over."""
    folder = Folder(spark, root)
    waiting = set(folder.names("new_records"))
    moved = [p for p in manifest.parts if p in waiting]
    for part in moved:
        folder.move(f"new_records/{part}", f"merged_records/{manifest.version:012d}/{part}")
    return moved


def compact_parts(spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], from_archive: bool = False, since: int = 0) -> Manifest:
    """Merge all waiting record parts into the stage table, publish it and archive them; without parts nothing changes.

    A merge whose parts were not archived before a crash is finished first. ``from_archive`` merges the archived parts of versions from ``since`` on
    instead, to build a lost table again.
    """
    folder, last = Folder(spark, root), current(spark, root)
    archive(spark, root, last)
    source = "merged_records" if from_archive else "new_records"
    if not folder.names(source):
        return last
    wanted = f"{folder.root}/{source}"
    if from_archive:
        versions = [n for n in folder.names(source) if int(n) >= since]
        wanted = f"{wanted}/{{{','.join(versions)}}}"
    parts = read_parts(spark, wanted, schema, keys)
    if not parts.names:
        return last
    made = merge_records(parts.rows, root, keys, "_seq", [] if from_archive else parts.names)
    archive(spark, root, made)
    return made


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete bucket folders that the current manifest doesn't name, once no reader of older ones is left."""
    folder, manifest = Folder(spark, root), current(spark, root)
    kept = {f"{place}/bucket={b}" for b, place in manifest.places.items()}
    gone = [f"table/{name}/{part}" for name in folder.names("table") for part in folder.names(f"table/{name}") if part.startswith("bucket=") and f"{name}/{part}" not in kept]
    for name in [*gone, "incoming"]:
        folder.delete(name)
    return gone
