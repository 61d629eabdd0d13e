"""Per-instance functions over a metadata table, with failures kept as rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparcel.operators.cascade import Step, cascade, cascade_counts, pending
from sparcel.operators.overlay import overlay_all, stack
from sparcel.operators.sharding import contiguous_shards
from sparcel.sources.catalogue import pick_instances
from sparcel.sources.stages import current, read_stage_table


def map_instances(df: DataFrame, key: str, func: Callable[[dict], dict], schema: str) -> DataFrame:
    """Apply ``func`` to every row; its dict becomes a row of ``schema``.

    A row whose function raises is kept with NULLs and its message in ``error``, so
    one bad instance neither fails the job nor disappears. Rows stream through in
    Arrow batches; parallelism and retries are Spark's.
    """
    kind = dict(df.dtypes)[key]
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append({**dict.fromkeys(names), **func(row), key: row[key], "error": None})
                except Exception as e:
                    out.append({**dict.fromkeys(names), key: row[key], "error": str(e)})
            yield pd.DataFrame(out, columns=[key, *names, "error"])

    return df.mapInPandas(run, f"{key} {kind}, {schema}, error string")


def split_results(results: DataFrame, key: str, flag: str) -> tuple[DataFrame, DataFrame]:
    """Records of the successful rows, and the keys and messages of the failed ones."""
    good = results.filter(F.col(flag).eqNullSafe(F.lit(True))).drop("error")
    return good, results.filter(F.col("error").isNotNull()).select(key, "error")


def worklist(
    tables: Sequence[DataFrame],
    key: str,
    ready: Sequence[Column],
    flags: Sequence[str],
    world: int,
    instances: DataFrame | str | None = None,
) -> DataFrame:
    """What a stage still has to do, cut into shards.

    The stage tables are overlaid in precedence order. A list of instances overrides
    all filters; otherwise rows must satisfy ``ready`` and lack one of ``flags``.
    """
    table = overlay_all(tables, [key])
    if instances is not None:
        table = pick_instances(table, key, instances)
    else:
        for condition in ready:
            table = table.filter(condition)
        table = pending(table, flags)
    return contiguous_shards(table, [key], world)


def open_dataset(roots: dict[str, Sequence[DataFrame]], key: str, steps: Sequence[Step]) -> tuple[DataFrame, DataFrame]:
    """Instances of several roots that pass a cascade, and each root's running counts.

    The tables of a root are overlaid; roots are stacked with their name.
    """
    merged = stack({name: overlay_all(tables, [key]) for name, tables in roots.items()})
    return cascade(merged, steps), cascade_counts(merged, steps, by=["dataset"])


def open_roots(spark: SparkSession, roots: str, schema: T.StructType, key: str, steps: Sequence[Step]) -> tuple[DataFrame, DataFrame]:
    """``open_dataset`` from a configuration: a JSON object name -> {role: folder}, or a comma list of folders named by their last part.

    A folder holds a published stage table or ``metadata.csv`` with any of the columns of ``schema``; of a
    dataset's folders the first with a value wins.
    """
    try:
        named = {name: list(parts.values()) for name, parts in json.loads(roots).items()}
    except ValueError:
        folders = [r.strip().rstrip("/") for r in roots.split(",") if r.strip()]
        named = {f.rsplit("/", 1)[-1]: [f] for f in folders}
        if len(named) < len(folders):
            raise ValueError("two folders of the list have the same name") from None
    tables = {name: [read_root(spark, folder, schema, key) for folder in folders] for name, folders in named.items()}
    return open_dataset(tables, key, steps)


def read_root(spark: SparkSession, folder: str, schema: T.StructType, key: str) -> DataFrame:
    """The published stage table of a folder, or else its ``metadata.csv``; columns that the file lacks are left out."""
    if current(spark, folder).places:
        return read_stage_table(spark, folder, schema, [key])
    table = spark.read.option("header", True).csv(f"{folder}/metadata.csv")
    given = [c for c in table.columns if c in schema.names]
    if key not in given:
        raise ValueError(f"{folder}/metadata.csv has no column {key}")
    return table.select(*[F.col(c).try_cast(schema[c].dataType).alias(c) for c in given])
