"""Shards, epochs and load-balanced groups."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparcel.operators.ordered import global_position, group_position
from sparcel.sources.stages import Folder


def contiguous_shards(df: DataFrame, order: Sequence[str], world: int) -> DataFrame:
    """Cut the ordered table into ``world`` contiguous shards whose sizes differ by at most one.

    Shard r holds positions [n*r div world, n*(r+1) div world).
    """
    placed = global_position(df, order, "pos", total="_n")
    shard = F.expr(f"cast(((pos + 1) * {world} - 1) div _n as int)")
    return placed.withColumn("shard", shard).drop("_n")


def micro_batches(df: DataFrame, batch: Sequence[str], order: Sequence[str], parts: int) -> DataFrame:
    """Cut every batch into ``parts`` contiguous micro-batches: part i holds positions [n*i div parts, n*(i+1) div parts).

    A batch of fewer rows than parts leaves some parts without rows.
    """
    sizes = df.groupBy(*batch).agg(F.count(F.lit(1)).alias("_n")).withColumnsRenamed({b: f"_b_{b}" for b in batch})
    placed = group_position(df, batch, order, "pos")
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in batch])
    part = F.expr(f"cast(((pos + 1) * {parts} - 1) div _n as int)").alias("part")
    return placed.join(sizes, same).select(*placed.columns, part)


@dataclass(frozen=True)
class SamplerState:
    """How far a sampler has come: steps of ``epoch`` that every rank has drawn."""

    epoch: int = 0
    step: int = 0


def save_state(spark: SparkSession, folder: str, state: SamplerState) -> None:
    """Append a state to the folder; a state that is there already is an error, so no step is counted twice."""
    Folder(spark, folder).create(f"{state.epoch:012d}-{state.step:012d}.json", json.dumps(asdict(state)))


def last_state(spark: SparkSession, folder: str) -> SamplerState:
    """The newest whole state; the begin of epoch 0 where there is none. One that a crash cut short is passed over."""
    held = Folder(spark, folder)
    for name in reversed(held.names("")):
        try:
            return SamplerState(**json.loads(held.read(name)))
        except (TypeError, ValueError):
            continue
    return SamplerState()


def resumed_order(df: DataFrame, key: str, world: int, folder: str, seed: int = 0, drop_last: bool = False) -> DataFrame:
    """What is left of the epoch that the stored state stands in; the next epoch if that one is through. Adds ``epoch``."""
    state = last_state(df.sparkSession, folder)
    rest = epoch_order(df, key, world, seed, state.epoch, drop_last).filter(F.col("step") >= state.step)
    if state.step and rest.isEmpty():
        state, rest = SamplerState(state.epoch + 1), epoch_order(df, key, world, seed, state.epoch + 1, drop_last)
    return rest.withColumn("epoch", F.lit(state.epoch))


def shuffle_key(key: str, seed: int, epoch: int) -> Column:
    """A reproducible pseudo-random sort key: the same in any engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed + epoch)), F.col(key).cast("string")))


def epoch_order(
    df: DataFrame, key: str, world: int, seed: int = 0, epoch: int = 0, drop_last: bool = False
) -> DataFrame:
    """One epoch of a resumable sampler: rank, step and global slot of every drawn row.

    The table is shuffled by seed and epoch and dealt round-robin to ``world`` ranks.
    Without ``drop_last`` the first rows are drawn again to fill the last round; with
    it the incomplete last round is cut. ``draws`` is the number of slots dealt.
    """
    shuffled = global_position(
        df.withColumn("_shuffle", shuffle_key(key, seed, epoch)), ["_shuffle", key], "slot", total="_n"
    ).drop("_shuffle")
    n = F.col("_n")
    if drop_last:
        rounds = F.when(n % world != 0, F.ceil((n - world) / world)).otherwise(F.ceil(n / world))
        drawn = shuffled.withColumn("draws", rounds * world).filter("slot < draws")
    else:
        again = F.expr("sequence(slot, draws - 1, _n)")
        drawn = shuffled.withColumn("draws", F.ceil(n / world) * world).withColumn("slot", F.explode(again))
    return (
        drawn.withColumn("rank", F.pmod("slot", F.lit(world)).cast("int"))
        .withColumn("step", F.expr(f"slot div {world}"))
        .drop("_n")
    )


def balanced_groups(
    df: DataFrame, window: Sequence[str], load: str, item: str, groups: int, size: int, equal: bool = False
) -> DataFrame:
    """Greedy longest-first grouping inside windows of at most ``size`` items.

    Items are taken by load, then item, both descending; each goes to the least
    loaded group (lowest number first). With ``equal`` a group that reached its share
    (the window's own number of items ``div groups``) is closed. ``size`` bounds the array
    that one row holds: a larger window fails the query. The greedy walk itself stays in the
    JVM as a fold.
    """
    items = df.groupBy(*window).agg(
        F.sort_array(F.collect_list(F.struct(F.col(load).cast("double").alias("load"), F.col(item).alias("item"))), asc=False).alias("_items")
    )
    items = items.withColumn("_items", F.when(F.size("_items") <= size, F.col("_items")).otherwise(F.raise_error(F.lit(f"a window holds more than {size} items"))))
    cap = f"(size(_items) div {groups})"
    start = (
        f"named_struct('loads', array_repeat(0D, {groups}), 'sizes', array_repeat(0, {groups}), "
        f"'out', cast(array() as array<int>))"
    )
    pick = "cast(array_position(s.loads, array_min(s.loads)) as int)"
    closed = f"s.sizes[g - 1] + 1 = {cap}" if equal else "false"
    step = (
        f"transform(array({pick}), g -> named_struct("
        f"'loads', transform(s.loads, (v, i) -> if(i + 1 = g, if({closed}, double('infinity'), v + t.load), v)), "
        "'sizes', transform(s.sizes, (v, i) -> if(i + 1 = g, v + 1, v)), "
        "'out', array_append(s.out, g - 1)))[0]"
    )
    walk = F.expr(f"aggregate(_items, {start}, (s, t) -> {step}, s -> s.out)")
    return (
        items.withColumn("_groups", walk)
        .select(*window, F.explode(F.arrays_zip("_items", "_groups")).alias("z"))
        .select(
            *window,
            F.col(f"z._items.item").alias(item),
            F.col("z._items.load").alias(load),
            F.col("z._groups").alias("grp"),
        )
    )


def balanced_epoch(
    df: DataFrame, key: str, load: str, world: int, batch: int, seed: int = 0, epoch: int = 0
) -> DataFrame:
    """Epoch order with every window of ``batch * world`` draws dealt by balanced load.

    Only whole windows are kept, as an incomplete one cannot be dealt equally.
    """
    width = batch * world
    drawn = epoch_order(df.select(key, load), key, world, seed, epoch)
    whole = drawn.withColumn("win", F.expr(f"slot div {width}")).withColumn(
        "within", F.pmod("slot", F.lit(width)).cast("int")
    )
    kept = whole.filter((F.col("win") + 1) * width <= F.col("draws"))
    dealt = balanced_groups(kept, ["win"], load, "within", world, width, equal=True)
    return kept.drop(load, "rank", "step", "draws").join(dealt, ["win", "within"])


def ranked_choice(df: DataFrame, group: str, item: str, k: Column, seed: int = 0) -> DataFrame:
    """Choose ``k`` items per group without replacement, by seeded hash rank."""
    keyed = df.withColumn(
        "_draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col(item).cast("string")))
    )
    placed = group_position(keyed, [group], ["_draw", item], "_rank")
    return placed.filter(F.col("_rank") < k).drop("_draw", "_rank")
