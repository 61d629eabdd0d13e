"""Spark data sources for cell and mesh files: vxz, npz and ply.

Reading: the driver only lists names and sizes; small files share a partition, large
containers are split by chunk, and headers are read in the tasks. Writing: rows are
clustered by file with one shuffle, and each task encodes its files as they stream by
into drafts, which the job's commit renames and its abort removes.
"""

from __future__ import annotations

import io
import json
import math
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import ArrayType, StructType

from sparcel.sources import codec

HEADER_SCHEMA = (
    "file string, num_voxel bigint, chunk_size int, filter string, compression string, compression_level int, "
    "raw_size bigint, compressed_size bigint, compress_ratio double, attr_interleave string, "
    "attr array<struct<name:string,channels:int>>, num_chunks int"
)
MESH_SCHEMA = "file string, element string, id bigint, x double, y double, z double, corners array<int>"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as Spark resolves it: without a scheme it lies on the default filesystem, not on the machine's disk."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return full.removeprefix("file:") if full.startswith("file:/") else full


def local(path: str) -> str:
    """Spark names local files by file: and slashes; other names stay as they are."""
    return re.sub("^file:/+", "/", path)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^s3[an]://", "s3://", path)
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def list_files(path: str, suffix: str) -> list[tuple[str, int]]:
    fs, root = filesystem(path)
    info = fs.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(suffix))


class Share(InputPartition):
    """Some files, and which share of each one's chunks (``part`` of ``parts``)."""

    def __init__(self, files: list[str], part: int = 0, parts: int = 1):
        self.files, self.part, self.parts = files, part, parts


def plan_shares(files: list[tuple[str, int]], limit: int, splittable: bool) -> list[Share]:
    shares, pack, held = [], [], 0
    for path, size in files:
        if splittable and size > limit:
            parts = -(-size // limit)
            shares += [Share([path], i, parts) for i in range(parts)]
            continue
        if pack and held + size > limit:
            shares.append(Share(pack))
            pack, held = [], 0
        pack.append(path)
        held += size
    if pack:
        shares.append(Share(pack))
    return shares or [Share([])]


def broadcast_file(spark: SparkSession, path: str, limit: int = 64 << 20):
    """A small side file, read once on the driver and shared with all tasks as bytes; larger ones are refused."""
    fs, root = filesystem(qualified(spark, path))
    size = fs.get_file_info(root).size
    if size is None or size > limit:
        raise ValueError(f"{path} is missing or larger than {limit} bytes; read it as a table")
    with fs.open_input_file(root) as handle:
        return spark.sparkContext.broadcast(handle.read())


def stem(path: str, suffix: str) -> str:
    return path.rsplit("/", 1)[-1][: -len(suffix)]


def to_batch(schema: StructType, file: str, coord: np.ndarray, attrs: dict[str, np.ndarray]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    columns = []
    for field in target:
        if field.name == "file":
            data = pa.array([file] * len(coord), pa.string())
        elif field.name in ("x", "y", "z"):
            data = pa.array(coord[:, "xyz".index(field.name)].astype(np.int32))
        elif field.name not in attrs:
            data = pa.nulls(len(coord), field.type)
        else:
            values = attrs[field.name]
            if pa.types.is_list(field.type):
                width = values.shape[1]
                flat = pa.array(values.reshape(-1)).cast(field.type.value_type)
                data = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) * width + 1, width, dtype=np.int32)), flat)
            else:
                data = pa.array(values.reshape(len(coord), -1)[:, 0])
        columns.append(data.cast(field.type))
    return pa.RecordBatch.from_arrays(columns, schema=target)


@dataclass
class Bounds:
    """What pushed conditions leave: names of files (any unless given) and the least and greatest x, y and z."""

    names: set[str] | None = None
    low: tuple[float, ...] = (-math.inf,) * 3
    high: tuple[float, ...] = (math.inf,) * 3

    def take(self, condition: Filter) -> Bounds:
        """Narrowed by a condition on file, x, y or z; other conditions leave it as it is."""
        column = condition.attribute[0] if len(getattr(condition, "attribute", ())) == 1 else None
        if column == "file" and isinstance(condition, (EqualTo, In)):
            named = {condition.value} if isinstance(condition, EqualTo) else set(condition.value)
            return replace(self, names=named if self.names is None else self.names & named)
        if column not in ("x", "y", "z"):
            return self
        low, high = -math.inf, math.inf
        if isinstance(condition, EqualTo):
            low = high = condition.value
        elif isinstance(condition, In):
            low, high = min(condition.value), max(condition.value)
        elif isinstance(condition, (GreaterThan, GreaterThanOrEqual)):  # coordinates are whole numbers
            low = math.ceil(condition.value) if isinstance(condition, GreaterThanOrEqual) else math.floor(condition.value) + 1
        elif isinstance(condition, (LessThan, LessThanOrEqual)):
            high = math.floor(condition.value) if isinstance(condition, LessThanOrEqual) else math.ceil(condition.value) - 1
        at = "xyz".index(column)
        narrow = lambda given, value, pick: tuple(pick(g, value) if i == at else g for i, g in enumerate(given))
        return replace(self, low=narrow(self.low, low, max), high=narrow(self.high, high, min))

    def meets(self, idx: list[int], size: int) -> bool:
        """Whether a chunk may hold a cell within the bounds."""
        return all(i * size <= h and i * size + size - 1 >= lo for i, lo, h in zip(idx, self.low, self.high))


class CellReader(DataSourceReader):
    """Files whose names, and chunks whose boxes, no pushed condition excludes; Spark tests the conditions on the rows again."""

    def __init__(self, source: CellFiles, schema: StructType):
        self.source, self.schema, self.bounds = source, schema, Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            self.bounds = self.bounds.take(condition)
            yield condition

    def partitions(self):
        files = list_files(self.source.path, self.source.suffix)
        if self.bounds.names is not None:
            files = [(path, size) for path, size in files if stem(path, self.source.suffix) in self.bounds.names]
        return plan_shares(files, self.source.limit, self.source.splittable)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for path in partition.files:
            yield from self.source.read_file(path, partition, self.schema, self.bounds)


@dataclass
class Drafts(WriterCommitMessage):
    """Files of one task: their draft names and the names they are to have."""

    moves: list[tuple[str, str]]


class CellWriter(DataSourceArrowWriter):
    """Rows arrive sorted by file (and chunk); one file is held at a time.

    Tasks write drafts, which get their names when the whole job has succeeded and go when it has failed.
    With ``overwrite`` the files of this format that were there before go at that moment.
    """

    def __init__(self, source: CellFiles, schema: StructType, overwrite: bool = False):
        self.source, self.schema, self.overwrite = source, schema, overwrite
        self.moves: list[tuple[str, str]] = []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        current, held, self.moves = None, [], []
        for batch in iterator:
            names = batch.column("file").to_numpy(zero_copy_only=False)
            if len(names) == 0:
                continue
            cuts = np.r_[0, np.flatnonzero(names[1:] != names[:-1]) + 1, len(names)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if current is not None and names[a] != current:
                    self.flush(current, held)
                    held = []
                current = names[a]
                held.append(batch.slice(a, b - a))
        if current is not None:
            self.flush(current, held)
        return Drafts(self.moves)

    def commit(self, messages: list[Drafts | None]) -> None:
        fs, root = filesystem(self.source.path)
        before = [f for f, _ in list_files(self.source.path, self.source.suffix)] if self.overwrite and self.exists() else []
        named = set()
        for message in messages:
            for draft, name in message.moves if message else ():
                fs.move(draft, name)
                named.add(name)
        for name in set(before) - named:
            fs.delete_file(name)

    def abort(self, messages: list[Drafts | None]) -> None:
        fs, _ = filesystem(self.source.path)
        for message in messages:
            for draft, _ in message.moves if message else ():
                fs.delete_file(draft)

    def exists(self) -> bool:
        fs, root = filesystem(self.source.path)
        return fs.get_file_info(root).type != pafs.FileType.NotFound

    def flush(self, name: str, held: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(held)
        if "entry" in self.schema.names:
            self.save(name, self.source.join_chunks(table))
            return
        coord = np.stack([table.column(a).to_numpy() for a in "xyz"], axis=1).astype(np.int64)
        attrs = {}
        for field in self.schema.fields:
            if field.name in ("file", "x", "y", "z"):
                continue
            column = table.column(field.name).combine_chunks()
            if isinstance(field.dataType, ArrayType):
                attrs[field.name] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(coord), -1)
            else:
                attrs[field.name] = column.to_numpy(zero_copy_only=False)[:, None]
        self.save(name, self.source.encode(coord, attrs))

    def save(self, name: str, data: bytes) -> None:
        fs, root = filesystem(self.source.path)
        fs.create_dir(root, recursive=True)
        draft = f"{root}/.{name}-{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(draft) as out:
            out.write(data)
        self.moves.append((draft, f"{root}/{name}{self.source.suffix}"))


class CellFiles(DataSource):
    """Common part of the cell formats: a row per cell with file, x, y, z and attributes."""

    suffix = ""
    splittable = False

    @property
    def path(self) -> str:
        return self.options["path"]

    @property
    def limit(self) -> int:
        return int(self.options.get("maxPartitionBytes", 64 << 20))

    def schema(self) -> str:
        files = list_files(self.path, self.suffix)
        if not files:
            raise ValueError(f"no {self.suffix} files under {self.path}; pass a schema")
        fs, _ = filesystem(self.path)
        with fs.open_input_file(files[0][0]) as handle:
            kinds = self.attribute_types(handle)
        return "file string, x int, y int, z int" + "".join(f", `{n}` {t}" for n, t in kinds)

    def reader(self, schema: StructType) -> CellReader:
        return CellReader(self, schema)

    def writer(self, schema: StructType, overwrite: bool) -> CellWriter:
        return CellWriter(self, schema, overwrite)

    def read_file(self, path: str, share: Share, schema: StructType, bounds: Bounds) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        with fs.open_input_file(path) as handle:
            coord, attrs = self.decode(handle.read())
        yield to_batch(schema, stem(path, self.suffix), coord, attrs)


def read_streams(handle, start: int, entry: dict, meta: dict, names: list[str] | None) -> dict[str, bytes]:
    """Packed bytes of a chunk's octree and of the streams that hold the wanted attributes, neighbours in one read."""
    wanted = sorted((entry[n][0], entry[n][1], n) for n in ["svo", *codec.streams_of(meta, names)])
    packed, run = {}, []

    def fetch() -> None:
        handle.seek(start + entry["ptr"][0] + run[0][0])
        data = handle.read(run[-1][0] + run[-1][1] - run[0][0])
        packed.update({n: data[at - run[0][0] : at - run[0][0] + length] for at, length, n in run})

    for item in wanted:
        if run and item[0] != run[-1][0] + run[-1][1]:
            fetch()
            run = []
        run.append(item)
    fetch()
    return packed


class VxzFiles(CellFiles):
    """Chunked, octree-coded voxel containers, of which the wanted chunks and streams are read."""

    suffix = ".vxz"
    splittable = True

    @classmethod
    def name(cls) -> str:
        return "vxz"

    def attribute_types(self, handle) -> list[tuple[str, str]]:
        meta, _ = codec.read_header(handle)
        return [(n, "int" if w == 1 else "array<int>") for n, w in meta["attr"]]

    def read_file(self, path: str, share: Share, schema: StructType, bounds: Bounds) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        with fs.open_input_file(path) as handle:
            meta, start = codec.read_header(handle)
            for entry in meta["chunks"][share.part :: share.parts]:
                if bounds.meets(entry["idx"], meta["chunk_size"]):
                    wanted = [f.name for f in schema.fields]
                    coord, attrs = codec.decode_streams(entry["idx"], read_streams(handle, start, entry, meta, wanted), meta, wanted)
                    yield to_batch(schema, stem(path, self.suffix), coord, attrs)

    def meta(self, attrs: list[tuple[str, int]]) -> dict:
        """Header fields from the options, checked."""
        size = int(self.options.get("chunkSize", 256))
        how, method = self.options.get("filter", "none"), self.options.get("compression", "lzma")
        interleave = self.options.get("interleave", "as_is")
        if size & (size - 1) or how not in codec.FILTERS or method not in codec.LEVELS or interleave not in codec.INTERLEAVES:
            raise ValueError(f"bad options: chunkSize={size} filter={how} compression={method} interleave={interleave}")
        return {
            "chunk_size": size, "filter": how, "compression": method,
            "compression_level": int(self.options.get("level", codec.LEVELS[method])),
            "attr_interleave": interleave, "attr": [list(a) for a in attrs],
        }

    def encode(self, coord: np.ndarray, attrs: dict[str, np.ndarray]) -> bytes:
        meta = self.meta([(n, v.shape[1]) for n, v in attrs.items()])
        values, size = codec.as_bytes(attrs), meta["chunk_size"]
        boxes, inverse = np.unique(coord // size, axis=0, return_inverse=True)
        order = np.argsort(inverse.reshape(-1), kind="stable")
        cuts = np.searchsorted(inverse.reshape(-1)[order], np.arange(len(boxes) + 1))
        chunks = []
        for i, box in enumerate(boxes):
            rows = order[cuts[i] : cuts[i + 1]]
            chunks.append(codec.encode_chunk(box.tolist(), coord[rows] % size, values[rows], meta))
        return codec.assemble(meta, chunks, len(coord))

    def join_chunks(self, table: pa.Table) -> bytes:
        """A file from chunks that other tasks have encoded."""
        rows = table.select(["entry", "data", "voxels", "widths"]).to_pylist()
        meta = self.meta(json.loads(rows[0]["widths"]))
        return codec.assemble(meta, [(json.loads(r["entry"]), r["data"]) for r in rows], sum(r["voxels"] for r in rows))


class NpzFiles(CellFiles):
    """Numpy archives with ``coord`` (16 bit) and one array per attribute."""

    suffix = ".npz"

    @classmethod
    def name(cls) -> str:
        return "npz"

    def attribute_types(self, handle) -> list[tuple[str, str]]:
        _, attrs = self.decode(handle.read())
        kinds = {"u": "int", "i": "int", "f": "double", "b": "boolean"}
        return [(n, kinds[v.dtype.kind] if v.ndim == 1 or v.shape[1] == 1 else f"array<{kinds[v.dtype.kind]}>") for n, v in attrs.items()]

    def decode(self, data: bytes) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            return z["coord"].astype(np.int32), {n: z[n] for n in z.files if n != "coord"}

    def encode(self, coord: np.ndarray, attrs: dict[str, np.ndarray]) -> bytes:
        out = io.BytesIO()
        save = np.savez if self.options.get("compress", "true") == "false" else np.savez_compressed
        save(out, coord=coord.astype(np.uint16), **attrs)
        return out.getvalue()


# fixed values: PLY scalar names and their numpy types
PLY_TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}


def ply_header(data: bytes) -> tuple[bool, list[tuple[str, int, list[list[str]]]], int]:
    """ASCII or not, the elements with their properties, and where the data starts."""
    end = data.index(b"end_header")
    start = data.index(b"\n", end) + 1
    elements: list[tuple[str, int, list[list[str]]]] = []
    for line in data[:end].decode().splitlines():
        words = line.split()
        if words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append(words[1:])
    return b"ascii" in data[:end], elements, start


def ply_vertices(data: bytes) -> tuple[np.ndarray, int, bool]:
    """Vertex records as a structured array, the offset behind them, and whether the file is text."""
    text, elements, start = ply_header(data)
    name, count, props = elements[0]
    if name != "vertex":
        raise ValueError("the first element of the file is not a vertex list")
    kind = np.dtype([(p[1], "<" + PLY_TYPES[p[0]]) for p in props])
    if not text:
        if len(data) < start + count * kind.itemsize:
            raise ValueError("vertex data ends early")
        return np.frombuffer(data, kind, count, start), start + count * kind.itemsize, text
    lines = data[start:].split(b"\n", count)
    rows = np.array([tuple(line.split()) for line in lines[:count]], dtype=[(p[1], "U32") for p in props])
    out = np.empty(count, kind)
    for p in props:
        out[p[1]] = rows[p[1]].astype(kind[p[1]])
    return out, len(data) - (len(lines[count]) if len(lines) > count else 0), text


class VoxelPlyFiles(CellFiles):
    """Point PLY files: x, y, z and attribute channels named ``name_0``, ``name_1``, ..."""

    suffix = ".ply"

    @classmethod
    def name(cls) -> str:
        return "voxelply"

    def attribute_types(self, handle) -> list[tuple[str, str]]:
        _, attrs = self.decode(handle.read())
        return [(n, ("double" if v.dtype.kind == "f" else "int") if v.shape[1] == 1 else ("array<double>" if v.dtype.kind == "f" else "array<int>")) for n, v in attrs.items()]

    def decode(self, data: bytes) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        rows, _, _ = ply_vertices(data)
        coord = np.stack([np.round(rows[a]) for a in "xyz"], axis=1).astype(np.int32)
        channels: dict[str, list[str]] = {}
        for column in rows.dtype.names:
            if column not in ("x", "y", "z"):
                channels.setdefault(re.sub(r"_\d+$", "", column), []).append(column)
        return coord, {n: np.stack([rows[c] for c in cols], axis=1) for n, cols in channels.items()}

    def encode(self, coord: np.ndarray, attrs: dict[str, np.ndarray]) -> bytes:
        named = {"f": "float", "u": "uchar", "i": "int"}
        columns = [(a, "float", coord[:, i]) for i, a in enumerate("xyz")]
        columns += [(f"{n}_{j}", named[v.dtype.kind], v[:, j]) for n, v in attrs.items() for j in range(v.shape[1])]
        out = np.empty(len(coord), np.dtype([(n, "<" + PLY_TYPES[t]) for n, t, _ in columns]))
        for n, _, v in columns:
            out[n] = v
        head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(coord)}", *[f"property {t} {n}" for n, t, _ in columns], "end_header", ""]
        return "\n".join(head).encode() + out.tobytes()


class MeshPlyReader(DataSourceReader):
    def __init__(self, path: str, limit: int, schema: StructType):
        self.path, self.limit, self.schema = path, limit, schema

    def partitions(self):
        return plan_shares(list_files(self.path, ".ply"), self.limit, False)

    def read(self, partition: Share) -> Iterator[tuple]:
        fs, _ = filesystem(self.path)
        for path in partition.files:
            with fs.open_input_file(path) as handle:
                data = handle.read()
            name = stem(path, ".ply")
            vertices, at, text = ply_vertices(data)
            for i, v in enumerate(vertices):
                yield name, "vertex", i, float(v["x"]), float(v["y"]), float(v["z"]), None
            faces = dict((n, c) for n, c, _ in ply_header(data)[1]).get("face", 0)
            for i, corners in enumerate(self.text_faces(data, at, faces) if text else self.binary_faces(data, at, faces)):
                yield name, "tri" if len(corners) == 3 else "quad", i, None, None, None, corners

    def text_faces(self, data: bytes, at: int, count: int) -> Iterator[list[int]]:
        """Triangles and quads; faces with other corner counts are passed over."""
        for line in data[at:].split(b"\n")[:count]:
            words = [int(w) for w in line.split()]
            if words and words[0] in (3, 4):
                yield words[1 : 1 + words[0]]

    def binary_faces(self, data: bytes, at: int, count: int) -> Iterator[list[int]]:
        for _ in range(count):
            corners = data[at]
            if corners not in (3, 4):
                raise ValueError(f"unsupported face with {corners} corners")
            yield np.frombuffer(data, "<i4", corners, at + 1).tolist()
            at += 1 + 4 * corners


class MeshPlyFiles(DataSource):
    """Mesh PLY files as rows: vertices with positions, triangles and quads with corner lists."""

    @classmethod
    def name(cls) -> str:
        return "meshply"

    def schema(self) -> str:
        return MESH_SCHEMA

    def reader(self, schema: StructType) -> MeshPlyReader:
        return MeshPlyReader(self.options["path"], int(self.options.get("maxPartitionBytes", 64 << 20)), schema)


# extension -> data source
BY_SUFFIX = {".vxz": "vxz", ".npz": "npz", ".ply": "voxelply"}


def register(spark: SparkSession) -> None:
    """Make the formats known; conditions on file, x, y and z reach their readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (VxzFiles, NpzFiles, VoxelPlyFiles, MeshPlyFiles):
        spark.dataSource.register(source)


def read_cells(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """Cells of one file, or of a folder when the kind is given."""
    register(spark)
    kind = kind or BY_SUFFIX.get("." + path.rsplit(".", 1)[-1])
    if kind is None:
        raise ValueError(f"unknown cell file {path}")
    return spark.read.format(kind).options(**options).load(qualified(spark, path))


def listed(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, length) of all files below ``path``, listed by Spark; no file is opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length")


def _headers(spark: SparkSession, path: str, rows: Callable[[str, dict, int], Iterator[dict]], schema: str) -> DataFrame:
    """Rows made of the header of each container in the tasks, which read no further than the header."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, inner = filesystem(local(name))
                with fs.open_input_file(inner) as handle:
                    meta, start = codec.read_header(handle)
                yield pa.RecordBatch.from_pylist(list(rows(name, meta, start)), schema=target)

    return listed(spark, path, ".vxz").select("path").mapInArrow(run, schema)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per container below ``path``."""

    def row(name: str, meta: dict, start: int) -> Iterator[dict]:
        yield {**{k: v for k, v in meta.items() if k != "chunks"}, "file": stem(name, ".vxz"), "num_chunks": len(meta["chunks"]), "attr": [{"name": n, "channels": w} for n, w in meta["attr"]]}

    return _headers(spark, path, row, HEADER_SCHEMA)


INDEX_SCHEMA = (
    "path string, file string, chunk int, x0 int, x1 int, y0 int, y1 int, z0 int, z1 int, offset bigint, length bigint, "
    "attr array<struct<name:string,channels:int>>, entry string, meta string"
)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per chunk of the containers below ``path``: its box (both ends inside), where it lies, and what decodes it.

    A table as any other: filter it, or join it with a table of boxes or of files, before ``decode_chunks``.
    """

    def rows(name: str, meta: dict, start: int) -> Iterator[dict]:
        size, shared = meta["chunk_size"], json.dumps({k: v for k, v in meta.items() if k != "chunks"})
        attr = [{"name": n, "channels": w} for n, w in meta["attr"]]
        for k, entry in enumerate(meta["chunks"]):
            box = {f"{a}{end}": i * size + end * (size - 1) for a, i in zip("xyz", entry["idx"]) for end in (0, 1)}
            yield {"path": name, "file": stem(name, ".vxz"), "chunk": k, **box, "offset": start, "length": entry["ptr"][1], "attr": attr, "entry": json.dumps(entry), "meta": shared}

    return _headers(spark, path, rows, INDEX_SCHEMA)


def decode_chunks(index: DataFrame, attrs: dict[str, str]) -> DataFrame:
    """Cells of the chunks of an index: file, x, y, z and the named attributes (name -> int or array<int>).

    Only the streams of these attributes are read. Chunks are dealt to tasks by place, so the chunks of one large container are decoded
    by many. A container without one of the attributes gives nulls.
    """
    schema = StructType.fromDDL("file string, x int, y int, z int" + "".join(f", `{n}` {t}" for n, t in attrs.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, file, start, entry, meta in zip(*(c.to_pylist() for c in batch.columns)):
                entry, meta = json.loads(entry), json.loads(meta)
                fs, inner = filesystem(local(name))
                with fs.open_input_file(inner) as handle:
                    packed = read_streams(handle, start, entry, meta, list(attrs))
                yield to_batch(schema, file, *codec.decode_streams(entry["idx"], packed, meta, list(attrs)))

    spread = index.select("path", "file", "offset", "entry", "meta").repartition("path", "entry")
    return spread.mapInArrow(run, schema)


def scan_cells(spark: SparkSession, path: str, attrs: dict[str, str], low: Sequence[int | None] = (None,) * 3, high: Sequence[int | None] = (None,) * 3) -> DataFrame:
    """Cells of the containers below ``path`` with ``low`` <= (x, y, z) < ``high`` (None: no bound) and the named attributes.

    Files are listed by Spark, headers are read by tasks, and of the bodies only the wanted streams of the chunks that meet the box.
    """
    index = chunk_index(spark, path)
    for axis, lo, hi in zip("xyz", low, high):
        index = index if lo is None else index.filter(F.col(f"{axis}1") >= lo)
        index = index if hi is None else index.filter(F.col(f"{axis}0") < hi)
    cells = decode_chunks(index, attrs)
    for axis, lo, hi in zip("xyz", low, high):
        cells = cells if lo is None else cells.filter(F.col(axis) >= lo)
        cells = cells if hi is None else cells.filter(F.col(axis) < hi)
    return cells


def encoded_chunks(rows: DataFrame, attrs: list[str], options: dict[str, str]) -> DataFrame:
    """Chunks of voxel files, each encoded by itself: (file, entry, data, voxels, widths) rows.

    A chunk is the unit of work, so a large asset is encoded by many tasks; what
    reaches the task that joins a file together is compressed already.
    """
    source = VxzFiles({**options, "path": ""})
    size = source.meta([])["chunk_size"]

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        coord = pdf[["x", "y", "z"]].to_numpy(np.int64)
        columns = {a: np.array(pdf[a].tolist()).reshape(len(pdf), -1) for a in attrs}
        meta = source.meta([(n, v.shape[1]) for n, v in columns.items()])
        entry, data = codec.encode_chunk((coord[0] // size).tolist(), coord % size, codec.as_bytes(columns), meta)
        row = {"file": pdf["file"].iloc[0], "entry": json.dumps(entry), "data": data, "voxels": len(pdf), "widths": json.dumps(meta["attr"])}
        return pd.DataFrame([{**row, **dict(zip(("cx", "cy", "cz"), (coord[0] // size).tolist()))}])

    chunk = [F.floor(F.col(a) / size).alias(f"_c{a}") for a in "xyz"]
    schema = "file string, entry string, data binary, voxels bigint, widths string, cx int, cy int, cz int"
    return rows.groupBy("file", *chunk).applyInPandas(encode, schema)


def write_cells(df: DataFrame, path: str, kind: str, asset: str, attrs: list[str], mode: str = "append", **options) -> None:
    """Write one file per asset, under the asset's name, whatever its size.

    Containers are encoded chunk by chunk by as many tasks as there are chunks; only the encoded
    chunks meet where a file is put together. The plain formats are one array per file. Cells must be
    unique within an asset.
    """
    register(df.sparkSession)
    path = qualified(df.sparkSession, path)
    options = {k: str(v) for k, v in options.items()}
    rows = df.select(F.col(asset).cast("string").alias("file"), *[F.col(a).cast("int").alias(a) for a in "xyz"], *attrs)
    if kind == "vxz":
        rows = encoded_chunks(rows, attrs, options).repartition("file").sortWithinPartitions("file", "cx", "cy", "cz")
        rows = rows.drop("cx", "cy", "cz")
    else:
        rows = rows.repartition("file").sortWithinPartitions("file", "x", "y", "z")
    rows.write.format(kind).options(**options).mode(mode).save(path)


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str, mesh: str = "mesh", text: bool = False, channels: dict[str, list[str]] | None = None) -> None:
    """Mesh tables to PLY, one file per mesh: vertices in vid order, then faces in fid order.

    ``faces`` has fid and an int array ``corners``; ``channels`` maps byte channel names of
    the vertices (colors, surface attributes) to their column names. The counts of the
    header are a window over the file, so the writing task streams a file batch by batch and
    never holds a mesh. The window also keeps a file's rows in one task: a join with the counts that turns into a broadcast
    at run time would not, and two tasks would write the same file.
    """
    path = qualified(vertices.sparkSession, path)
    extra = [c for cols in (channels or {}).values() for c in cols]
    v = vertices.select(F.col(mesh).cast("string").alias("file"), F.lit(0).alias("kind"), F.col("vid").alias("id"), "x", "y", "z", *extra)
    f = faces.select(F.col(mesh).cast("string").alias("file"), F.lit(1).alias("kind"), F.col("fid").alias("id"), "corners")
    rows = v.unionByName(f, allowMissingColumns=True)
    whole = Window.partitionBy("file").orderBy("kind", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"nv": F.count_if(F.col("kind") == 0).over(whole), "nf": F.count_if(F.col("kind") == 1).over(whole)})
    rows = rows.sortWithinPartitions("file", "kind", "id")
    layout = "ascii 1.0" if text else "binary_little_endian 1.0"

    def header(vertex_count: int, face_count: int) -> bytes:
        head = ["ply", f"format {layout}", f"element vertex {vertex_count}", *[f"property float {a}" for a in "xyz"]]
        head += [f"property uchar {c}" for c in extra]
        return "\n".join([*head, f"element face {face_count}", "property list uchar int vertex_index", "end_header", ""]).encode()

    def body(pdf: pd.DataFrame) -> bytes:
        vert, face = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
        if text:
            lines = [" ".join([*(repr(float(np.float32(r[a]))) for a in "xyz"), *(str(int(r[c])) for c in extra)]) for r in vert.to_dict("records")]
            lines += [" ".join(map(str, [len(c), *c])) for c in face["corners"]]
            return "".join(line + "\n" for line in lines).encode()
        table = np.empty(len(vert), np.dtype([*[(a, "<f4") for a in "xyz"], *[(c, "u1") for c in extra]]))
        for c in (*"xyz", *extra):
            table[c] = vert[c]
        return table.tobytes() + b"".join(bytes([len(c)]) + np.asarray(c, "<i4").tobytes() for c in face["corners"])

    def save(batches):
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        name, draft, out = None, None, None

        def finish() -> pd.DataFrame:
            out.close()
            fs.move(draft, f"{root}/{name}.ply")
            return pd.DataFrame({"file": [name]})

        for pdf in batches:
            for key, part in pdf.groupby("file", sort=False):
                if key != name:
                    if out is not None:
                        yield finish()
                    name, draft = key, f"{root}/.{key}-{uuid.uuid4().hex}.tmp"
                    out = fs.open_output_stream(draft)
                    out.write(header(int(part["nv"].iloc[0]), int(part["nf"].iloc[0])))
                out.write(body(part))
        if out is not None:
            yield finish()

    rows.mapInPandas(save, "file string").write.format("noop").mode("overwrite").save()
