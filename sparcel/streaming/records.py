"""Streaming ingestion: record logs, windowed counts and trailing statistics.

Every sink appends the result of a micro-batch under its batch id, overwriting only
that id, so a replayed batch changes nothing; readers take the newest value per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from sparcel.operators.overlay import compact
from sparcel.sources.stages import merge_records, read_stage_table


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files: int = 1) -> DataFrame:
    """New files of a folder as a stream, at most ``files`` per micro-batch."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    )


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process everything available and stop; the checkpoint remembers what was read."""

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()
    )
    query.awaitTermination()


def ingest_records(spark: SparkSession, folder: str, schema: StructType, target: str, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Stream record files into a published stage table and return it.

    A micro-batch is merged into the buckets that its keys fall into, the rest of the table is neither read nor written. Values are kept with
    their sequence, so late records never win over newer ones and a batch that is replayed changes nothing.
    """
    values = [f for f in schema.fields if f.name not in (*keys, *seq)]

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*keys, *[f.name for f in values], F.struct(*seq).alias("_seq"))
        merge_records(rows, target, keys, "_seq")

    query = file_stream(spark, folder, schema).writeStream.option("checkpointLocation", f"{target}-checkpoint").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    return read_stage_table(spark, target, StructType([*[schema[k] for k in keys], *values]), keys)


def latest(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    """Newest stored row per key of an update-mode sink."""
    return compact(spark.read.parquet(target), keys, ["batch"])


def windowed_counts(events: DataFrame, time: str, width: str, lateness: str, keys: Sequence[str], value: str, id_: str) -> DataFrame:
    """Tumbling counts and sums of a deduplicated event stream, late rows beyond ``lateness`` dropped."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", lateness)
    return (
        timed.dropDuplicatesWithinWatermark([id_])
        .groupBy(F.window("_t", width).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("start"), *keys, "n", "total")
    )


def newest_rows(rows: DataFrame, key: str, order: Sequence[str], size: int) -> DataFrame:
    """The newest ``size`` rows of every key, in the order of ``order``.

    The newest rows of a whole are among the newest of its parts. So a stream may keep those of each micro-batch, whose tasks cut them
    before anything is shuffled, hot keys included, and the kept rows are cut once more; no key's state is carried from batch to batch.
    """
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= size).drop("_r")


def trailing_rings(events: DataFrame, key: str, time: str, id_: str, value: str, size: int, salts: int = 16) -> DataFrame:
    """The newest ``size`` values of every (key, salt), whatever order they arrive in.

    A key's rows are spread over ``salts`` states by their id, so that a hot key keeps
    many tasks busy; every state is a ring of at most ``size`` values.
    """

    def update(group: tuple, batches, state: GroupState):
        times, ids, values = (np.array(part) for part in state.get) if state.exists else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for pdf in batches:
            times = np.r_[times, pdf["t"].to_numpy(np.int64)]
            ids = np.r_[ids, pdf["id"].to_numpy(np.int64)]
            values = np.r_[values, pdf["v"].to_numpy(float)]
            newest = np.lexsort((ids, times))[-size:]
            times, ids, values = times[newest], ids[newest], values[newest]
        ring = times.astype(np.int64).tolist(), ids.astype(np.int64).tolist(), values.tolist()
        state.update(ring)
        yield pd.DataFrame({"key": [group[0]], "salt": [group[1]], "t": [ring[0]], "id": [ring[1]], "v": [ring[2]]})

    narrow = events.select(
        F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(id_).alias("id"), F.col(value).alias("v"),
        F.pmod(F.xxhash64(id_), F.lit(salts)).cast("int").alias("salt"),
    )
    ring = "t array<bigint>, id array<bigint>, v array<double>"
    return narrow.groupBy("key", "salt").applyInPandasWithState(
        update, f"key bigint, salt int, {ring}", ring, "update", GroupStateTimeout.NoTimeout
    )


def trailing_means(rings: DataFrame, size: int) -> DataFrame:
    """Count and mean of the newest ``size`` values per key, from its salted rings (at most salts * size rows)."""
    rows = rings.select("key", F.explode(F.arrays_zip("t", "id", "v")).alias("e"))
    newest = Window.partitionBy("key").orderBy(F.desc("e.t"), F.desc("e.id"))
    return (
        rows.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= size)
        .groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("e.v").alias("mean"))
    )
