"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of fixed size. All distinct blocks are sorted and get integer names;
then adjacent names are paired and the distinct pairs are sorted and named in turn, until one name
is left for each text. Names are given by rank, never by hash, so two texts have the same last name
exactly if they are equal.

Ranks are given inside a fixed number of slices: a block belongs to the slice its hash picks, is
ranked among the distinct blocks there, and its name is ``rank * slices + slice``. So no single
task sorts all blocks, and a block that a third of all texts holds is one row by then.

Only texts that share length and 64-bit hash with another row are named: a text without such a
partner has no copy, whatever its blocks are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparcel.session import stage


#: Rows of (length, hash) that may be broadcast.
BROADCAST_ROWS = 1_000_000


def _named(items: DataFrame, value: Column, slices: int) -> DataFrame:
    """``items`` (row, at, ...) -> (row, at, name); equal values get equal names, others different ones."""
    keyed = items.select("row", "at", value.alias("value"))
    distinct = keyed.select("value").distinct().withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(slices)))
    rank = F.row_number().over(Window.partitionBy("slice").orderBy("value"))
    names = distinct.select("value", (rank.cast("long") * slices + F.col("slice")).alias("name"))
    return keyed.join(names, "value").select("row", "at", "name")


def block_names(texts: DataFrame, block: int = 4096, slices: int = 4096) -> DataFrame:
    """(row, bytes) -> (row, name): one integer for each row, the same for equal byte strings alone.

    Each round halves the number of names of a text, so the longest text sets the number of rounds;
    every round is written to the shared folder and read back, which keeps the plan short.
    """
    cut = f"transform(sequence(0, greatest(length(bytes) - 1, 0) div {block}), i -> substring(bytes, cast(i * {block} + 1 as int), {block}))"
    blocks = texts.select("row", F.posexplode(F.expr(cut)).alias("at", "part"))
    named = stage(_named(blocks, F.col("part"), slices), "block-names")
    while named.agg(F.max("at")).first()[0]:
        # a pair whose second half is missing keeps -1 there, which no name is
        pairs = named.groupBy("row", F.expr("cast(at div 2 as int)").alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        named = stage(_named(pairs, F.struct("a", "b"), slices), "pair-names")
    return named.select("row", "name")


def _keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of ``docs`` with a row number, length and hash beside them, as a written table."""
    data = F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8")
    return stage(
        docs.select(*columns, F.monotonically_increasing_id().alias("__row"), F.length(data).alias("__n"), F.xxhash64(data).alias("__h")), "exact-rows"
    )


def _members(keyed: DataFrame, block: int, slices: int) -> DataFrame:
    """(__row, __doc, __name) of the rows that share length and hash with another one."""
    shared = stage(keyed.groupBy("__n", "__h").agg(F.count(F.lit(1)).alias("__same")).filter("__same > 1").select("__n", "__h"), "shared-hashes")
    # two integers a row: so many of them fit any executor, beyond that both sides shuffle
    partners = keyed.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, ["__n", "__h"], "left_semi")
    texts = stage(partners.select(F.col("__row").alias("row"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes")), "shared-texts")
    names = block_names(texts, block, slices).select(F.col("row").alias("__row"), F.col("name").alias("__name"))
    ids = keyed.select("__row", F.col("doc_id").alias("__doc"))
    return stage(ids.join(names, "__row"), "exact-members")


def _groups(members: DataFrame) -> DataFrame:
    """(__row, __keep, __keep_row, __size): each member with the row of its group that stays."""
    groups = members.groupBy("__name").agg(F.max(F.struct("__doc", "__row")).alias("__k"), F.count(F.lit(1)).alias("__size"))
    return members.join(groups, "__name").select(
        "__row", F.col("__k.__doc").alias("__keep"), F.col("__k.__row").alias("__keep_row"), "__size"
    )


def exact_groups(docs: DataFrame, block: int = 4096, slices: int = 4096) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and equals it. Of equal texts the row with the largest doc_id stays;
    rows that repeat a doc_id with an equal text count each, and exactly one of them is kept. A null
    doc_id is smaller than any other. No rows in, no rows out; further columns are not looked at.
    """
    sha = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256")
    keyed = _keyed(docs, F.col("doc_id"), F.col("text"), sha)
    groups = _groups(_members(keyed, block, slices))
    return keyed.select("doc_id", "text_sha256", "__row").join(groups, "__row", "left").select(
        "doc_id",
        F.when(F.col("__size").isNull(), F.col("doc_id")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("__keep_row") == F.col("__row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, block: int = 4096, slices: int = 4096) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the largest doc_id.

    All columns stay as they are, whatever their names.
    """
    keyed = _keyed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))  # one column: no name of a field clashes
    texts = keyed.select("__row", "__n", "__h", F.col("__doc.doc_id").alias("doc_id"), F.col("__doc.text").alias("text"))
    gone = _groups(_members(texts, block, slices)).filter("__row <> __keep_row").select("__row")
    return keyed.join(gone, "__row", "left_anti").select("__doc.*")
