"""Mesh dumps as nested parquet.

Pickled dumps are not read: unpickling runs code from the file. The same content is
kept as typed columns instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POINT = "array<struct<x:double,y:double,z:double>>"
_FACE = "array<struct<v0:int,v1:int,v2:int>>"
_TEXTURE = "struct<image:binary,interpolation:string,extension:string>"

TEXTURES = ("base_color", "metallic", "roughness", "alpha")

MESH_DUMP = f"asset string, objects array<struct<vertices:{_POINT},faces:{_FACE}>>"
PBR_DUMP = (
    "asset string, "
    "materials array<struct<base_color_factor:array<double>,metallic_factor:double,roughness_factor:double,alpha_factor:double,"
    f"alpha_mode:string,alpha_cutoff:double,base_color_texture:{_TEXTURE},metallic_texture:{_TEXTURE},"
    f"roughness_texture:{_TEXTURE},alpha_texture:{_TEXTURE}>>, "
    f"objects array<struct<vertices:{_POINT},faces:{_FACE},normals:array<{_POINT}>,"
    "uvs:array<array<struct<u:double,v:double>>>,mat_ids:array<int>>>"
)


def read_dumps(spark: SparkSession, path: str, materials: bool = False) -> DataFrame:
    return spark.read.schema(PBR_DUMP if materials else MESH_DUMP).parquet(path)


def write_dumps(dumps: DataFrame, path: str, materials: bool = False) -> None:
    """Dumps as parquet, every column in the type that readers expect."""
    schema = T.StructType.fromDDL(PBR_DUMP if materials else MESH_DUMP)
    dumps.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(path)


def object_rows(dumps: DataFrame) -> DataFrame:
    """One row per object of every dump, in its order."""
    return dumps.select("asset", F.posexplode("objects").alias("obj", "o")).select("asset", "obj", "o.*")


#: Dumps by object: one row per object, however many an asset has.
OBJECT_ROWS = f"asset string, obj bigint, vertices {_POINT}, faces {_FACE}"


def object_stats(objects: DataFrame, materials: DataFrame | None = None) -> DataFrame:
    """As ``dump_stats`` from object rows (asset, obj, vertices, faces) and material rows (asset, with the texture columns).

    Counts are added up before they are shuffled, so an asset may have any number of objects.
    """
    filled = (F.size("vertices") > 0) & (F.size("faces") > 0)
    sums = {n: F.coalesce(F.sum(F.when(filled, F.size(c).cast("bigint"))), F.lit(0)).alias(n) for n, c in (("num_vertices", "vertices"), ("num_faces", "faces"))}
    stats = objects.groupBy("asset").agg(*sums.values())
    names = [f"num_{t}_tex" for t in TEXTURES]
    if materials is None:
        return stats.select("*", *[F.lit(None).cast("int").alias(n) for n in names])
    textures = materials.groupBy("asset").agg(*[F.count(f"{t}_texture").cast("int").alias(n) for t, n in zip(TEXTURES, names)])
    return stats.join(textures, "asset", "left").fillna(0, subset=names)


def material_rows(dumps: DataFrame) -> DataFrame:
    """One row per material of every PBR dump, in its order."""
    return dumps.select("asset", F.posexplode("materials").alias("mat", "m")).select("asset", "mat", "m.*")


def dump_stats(dumps: DataFrame) -> DataFrame:
    """Vertex, face and texture counts per dump, objects without vertices or faces left out.

    Texture counts are NULL for dumps without a material list.
    """
    filled = F.filter("objects", lambda o: (F.size(o["vertices"]) > 0) & (F.size(o["faces"]) > 0))
    out = {
        "num_vertices": F.aggregate(filled, F.lit(0).cast("bigint"), lambda s, o: s + F.size(o["vertices"])),
        "num_faces": F.aggregate(filled, F.lit(0).cast("bigint"), lambda s, o: s + F.size(o["faces"])),
    }
    for name in TEXTURES:
        column = f"num_{name}_tex"
        if "materials" in dumps.columns:
            out[column] = F.size(F.filter("materials", lambda m: m[f"{name}_texture"].isNotNull()))
        else:
            out[column] = F.lit(None).cast("int")
    return dumps.select("asset", *[c.alias(n) for n, c in out.items()])
