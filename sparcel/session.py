"""Session defaults and the shared staging folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparcel")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would vanish with its executor.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="sparcel-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a small table over all shuffle partitions before its rows multiply.

    The explicit number keeps adaptive coalescing, which goes by the bytes it sees
    now, from putting the whole expansion into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows that a task should hold at most of a table that is grouped or sorted whole (fixed value), and at least.
MOST_ROWS, LEAST_ROWS = 250_000, 20_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal ``rows`` rows by key over partitions whose number follows the rows, so that no task's memory grows with the table.

    The number of shuffle partitions alone is fixed: above it, every task would get a larger share.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(min(usual, -(-rows // LEAST_ROWS)), -(-rows // MOST_ROWS), 1), *keys)


_STAGED: list[str] = []


def staged_path(spark: SparkSession, label: str) -> str:
    path = f"{staging_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def release_staged(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete the tables this session staged (or only ``paths`` of them), once no DataFrame reads them any more."""
    conf = spark._jsc.hadoopConfiguration()
    paths = _STAGED if paths is None else paths
    while paths:
        name = paths.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in _STAGED:
            _STAGED.remove(name)


@contextlib.contextmanager
def staged_since() -> Iterator[list[str]]:
    """Collects the paths that are staged inside the ``with`` block."""
    made: list[str] = []
    before = set(_STAGED)
    yield made
    made.extend(p for p in _STAGED if p not in before)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    Cuts the lineage, survives lost executors, and freezes anything that depends
    on the physical partitioning (partition ids, positions inside a partition).
    """
    path = staged_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
