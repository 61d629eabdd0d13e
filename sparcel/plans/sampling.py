"""Epoch samplers, balanced groups and seeded choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sparcel.operators import sharding
from sparcel.operators.sharding import SamplerState, balanced_epoch, balanced_groups, epoch_order, ranked_choice, resumed_order, save_state
from sparcel.plans.catalog import query
from sparcel.session import stage, staged_path
from sparcel.tables import load

WORLD, BATCH = 4, 8


def epoch_sql(table: str, key: str, seed: int, world: int, extra: str = "") -> str:
    return f"""s AS (SELECT {key}{extra}, row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key}) - 1 AS p, count(*) OVER () AS n FROM {table}),
    e AS (SELECT {key}{extra}, p + n * k AS slot, (n + {world - 1}) // {world} * {world} AS draws FROM s, range(0, {world}) r(k) WHERE p + n * k < (n + {world - 1}) // {world} * {world})"""


@query(
    "epoch_order",
    "W10 T3",
    f"""WITH {epoch_sql('documents', 'doc_id', 5, 7)}
    SELECT doc_id, CAST(slot AS BIGINT) AS slot, CAST(slot % 7 AS INTEGER) AS rank, CAST(slot // 7 AS BIGINT) AS step FROM e WHERE slot // 7 >= 10""",
)
def resumed_epoch(spark, d):
    """One shuffled epoch for seven ranks, resumed after ten steps."""
    order = epoch_order(load(spark, d, "documents").select("doc_id"), "doc_id", 7, seed=3, epoch=2)
    return order.filter("step >= 10").select("doc_id", "slot", "rank", "step")


@query(
    "epoch_drop_last",
    "W10",
    """WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) - 1 AS slot, count(*) OVER () AS n FROM documents)
    SELECT doc_id, slot, CAST(slot % 7 AS INTEGER) AS rank FROM s WHERE slot < n // 7 * 7""",
)
def epoch_drop_last(spark, d):
    order = epoch_order(load(spark, d, "documents").select("doc_id"), "doc_id", 7, seed=3, drop_last=True)
    return order.select("doc_id", "slot", "rank")


def lpt_sql(items: str, window: str, load_: str, item: str, groups: int, size: int, equal: bool) -> str:
    """Greedy grouping as a recursive walk, all windows in step; ``items`` names a CTE."""
    cap = size // groups
    closed = f"list_extract(sizes, g) + 1 = {cap}" if equal else "FALSE"
    return f"""r AS (SELECT {window} AS w, {item} AS item, CAST({load_} AS DOUBLE) AS ld, row_number() OVER (PARTITION BY {window} ORDER BY {load_} DESC, {item} DESC) AS k FROM {items}),
    walk AS (
      SELECT w, 0::BIGINT AS k, CAST(NULL AS BIGINT) AS item, CAST(NULL AS DOUBLE) AS ld, 0::BIGINT AS g, list_transform(range({groups}), lambda i: 0::DOUBLE) AS loads, list_transform(range({groups}), lambda i: 0::BIGINT) AS sizes
      FROM (SELECT DISTINCT w FROM r)
      UNION ALL
      SELECT w, k, item, ld, g,
        list_transform(range({groups}), lambda i: CASE WHEN i + 1 = g THEN (CASE WHEN {closed} THEN 'inf'::DOUBLE ELSE list_extract(loads, i + 1) + ld END) ELSE list_extract(loads, i + 1) END),
        list_transform(range({groups}), lambda i: list_extract(sizes, i + 1) + (i + 1 = g)::BIGINT)
      FROM (SELECT walk.w, r.k, CAST(r.item AS BIGINT) AS item, r.ld, CAST(list_position(walk.loads, list_min(walk.loads)) AS BIGINT) AS g, walk.loads, walk.sizes
            FROM walk JOIN r ON r.w = walk.w AND r.k = walk.k + 1))"""


@query(
    "stored_sampler_state",
    "T3 W10",
    """WITH s AS (SELECT doc_id, e, row_number() OVER (PARTITION BY e ORDER BY md5((3 + e) || ':' || doc_id), doc_id) - 1 AS p, count(*) OVER (PARTITION BY e) AS n FROM documents, range(2) r(e)),
    d AS (SELECT doc_id, e, p + n * k AS slot FROM s, range(7) r(k) WHERE p + n * k < (n + 6) // 7 * 7)
    SELECT CAST(e AS INTEGER) AS epoch, CAST(slot // 7 AS BIGINT) AS step, CAST(slot % 7 AS INTEGER) AS rank, doc_id FROM d WHERE e = 0 OR slot // 7 < 3""",
)
def stored_sampler_state(spark, d):
    """An epoch in runs that stop after steps 4 and 9, each resumed from the stored state, to its end and three steps of the next."""
    docs, folder, runs = load(spark, d, "documents").select("doc_id"), staged_path(spark, "sampler"), []
    last = None
    for stop in (4, 9, None, 3):
        order = resumed_order(docs, "doc_id", 7, folder, seed=3)
        run = stage(order.filter(F.col("step") < stop) if stop else order, "run")
        last = run.agg(F.max(F.struct("epoch", "step")).alias("at")).first().at
        save_state(spark, folder, SamplerState(last.epoch, last.step + 1))
        runs.append(run)
    return reduce(lambda a, b: a.unionByName(b), runs).select("epoch", "step", "rank", "doc_id")


@query(
    "micro_batches",
    "W12",
    """WITH p AS (SELECT doc_id // 48 AS batch, doc_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY doc_id // 48) AS n FROM documents WINDOW w AS (PARTITION BY doc_id // 48 ORDER BY n_chars DESC, doc_id))
    SELECT batch, doc_id, pos, CAST(i AS INTEGER) AS part FROM p, range(5) r(i) WHERE pos >= n * i // 5 AND pos < n * (i + 1) // 5""",
)
def micro_batches(spark, d):
    """Batches of 48 documents cut into five contiguous micro-batches."""
    docs = load(spark, d, "documents").select(F.expr("doc_id div 48").alias("batch"), "doc_id", (-F.col("n_chars")).alias("key"))
    return sharding.micro_batches(docs, ["batch"], ["key", "doc_id"], 5).select("batch", "doc_id", "pos", "part")


@query(
    "balanced_groups",
    "W9 W12",
    "WITH RECURSIVE i AS (SELECT doc_id // 48 AS w0, doc_id, n_chars FROM documents), "
    + lpt_sql("i", "w0", "n_chars", "doc_id", 6, 48, False)
    + " SELECT w AS win, item AS doc_id, ld AS n_chars, CAST(g - 1 AS INTEGER) AS grp FROM walk WHERE k > 0",
)
def balanced_document_groups(spark, d):
    docs = load(spark, d, "documents").select(F.expr("doc_id div 48").alias("win"), "doc_id", "n_chars")
    return balanced_groups(docs, ["win"], "n_chars", "doc_id", 6, 48)


@query(
    "balanced_epoch",
    "W11 W9",
    f"""WITH RECURSIVE {epoch_sql('documents', 'doc_id', 11, WORLD, ', n_chars')},
    f AS (SELECT doc_id, n_chars, slot // {WORLD * BATCH} AS win, slot % {WORLD * BATCH} AS within FROM e WHERE (slot // {WORLD * BATCH} + 1) * {WORLD * BATCH} <= draws), """
    + lpt_sql("f", "win", "n_chars", "within", WORLD, WORLD * BATCH, True)
    + """ SELECT f.win, CAST(f.within AS INTEGER) AS within, f.doc_id, walk.ld AS n_chars, CAST(walk.g - 1 AS INTEGER) AS grp
    FROM walk JOIN f ON f.win = walk.w AND f.within = walk.item WHERE walk.k > 0""",
)
def balanced_document_epoch(spark, d):
    docs = load(spark, d, "documents")
    dealt = balanced_epoch(docs, "doc_id", "n_chars", WORLD, BATCH, seed=11)
    return dealt.select(F.col("win"), "within", "doc_id", "n_chars", "grp")


@query(
    "view_choice",
    "W13",
    """
    SELECT l_orderkey, l_linenumber, l_partkey FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5('9:' || l_orderkey || ':' || l_linenumber || '/' || l_partkey), l_linenumber || '/' || l_partkey) AS r
      FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)) WHERE r <= 1 + l_orderkey % 3
    """,
)
def view_choice(spark, d):
    """One to three views per asset, without replacement."""
    views = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    named = views.withColumn("view", F.concat_ws("/", "l_linenumber", "l_partkey"))
    chosen = ranked_choice(named, "l_orderkey", "view", 1 + F.col("l_orderkey") % 3, seed=9)
    return chosen.select("l_orderkey", "l_linenumber", "l_partkey")
