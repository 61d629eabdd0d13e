"""Streaming queries, run to completion over files derived from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparcel.plans.catalog import query
from sparcel.session import staged_path
from sparcel.streaming import records as S
from sparcel.tables import load


def event_parts(spark, d, parts: int = 3):
    """The event table as several record files, so that a stream has several micro-batches."""
    path = staged_path(spark, "parts")
    events = sparse_events(spark, d)
    events.repartition(parts, "event_id").write.parquet(path)
    return path, events.schema


def sparse_events(spark, d):
    return load(spark, d, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")).otherwise(F.lit(None)))


def dated_parts(spark, d, days: int, parts: int = 3):
    """As ``event_parts``, for a watermark of 2 * ``days``: record files of spans of ``days``, written one span after the other.

    A stream reads files in the order of their times. So the newest row it has seen is never more than two spans ahead
    of a row to come, however long the table. Rows without a time can't pass a watermark and are a table of their own.
    """
    path, spans = staged_path(spark, "parts"), staged_path(spark, "spans")
    events = sparse_events(spark, d)
    span = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.lit(days * 86400)).alias("_span")
    events.select("*", span).filter("ts is not null").write.partitionBy("_span").parquet(spans)
    dated = spark.read.schema(events.schema.add("_span", "long")).parquet(spans)
    for (i,) in sorted(dated.select("_span").distinct().collect()):
        dated.filter(F.col("_span") == i).drop("_span").repartition(parts, "event_id").write.mode("append").parquet(path)
    return path, dated.drop("_span").schema, events.filter("ts is null")


@query(
    "streamed_overlay",
    "T1 J3 S5",
    """
    SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(props, (ts, event_id)) AS props,
           arg_max(value, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS value FROM events GROUP BY user_id
    """,
)
def streamed_overlay(spark, d):
    folder, schema = event_parts(spark, d)
    return S.ingest_records(spark, folder, schema, staged_path(spark, "log"), ["user_id"], ["ts", "event_id"])


@query(
    "streamed_windows",
    "T6",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(CASE WHEN event_type <> 'error' THEN value END), 4) AS total
    FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1) GROUP BY 1, 2""",
)
def streamed_windows(spark, d):
    folder, schema, undated = dated_parts(spark, d, 30)
    target = staged_path(spark, "windows")
    counts = S.windowed_counts(S.file_stream(spark, folder, schema), "ts", "1 hour", "60 days", ["event_type"], "value", "event_id")
    S.run_once(counts, target, f"{target}-checkpoint", mode="update")
    newest = S.latest(spark, target, ["start", "event_type"]).select("start", "event_type", "n", "total")
    rest = undated.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    newest = newest.union(rest.select(F.lit(None).cast("timestamp"), "event_type", "n", "total"))
    return newest.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "streamed_trailing_means",
    "T5 W14",
    """SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM (
      SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'error') WHERE r <= 20 GROUP BY user_id""",
)
def streamed_trailing_means(spark, d):
    folder, schema = event_parts(spark, d)
    target = staged_path(spark, "trailing")
    stream = S.file_stream(spark, folder, schema).filter("value is not null").select("user_id", "ts", "event_id", "value")
    S.run_once(stream, target, f"{target}-checkpoint", prepare=lambda batch: S.newest_rows(batch, "user_id", ["ts", "event_id"], 20))
    newest = S.newest_rows(spark.read.schema(stream.schema).parquet(target), "user_id", ["ts", "event_id"], 20)
    means = newest.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return means.select("user_id", "n", F.round("mean", 6).alias("mean"))
