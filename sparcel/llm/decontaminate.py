"""Benchmark decontamination by winnowing.

The words of an item are fingerprinted by their k-grams: of every ``span - k + 1`` consecutive k-gram
hashes the smallest (the rightmost of equals) is kept. A document is winnowed in the same way, so any
``span`` words that it shares with an item share at least one kept fingerprint. Items of fewer than
``span`` words have one gram, all their words; documents keep every gram of such a length, if there
are such items.

Fingerprints of documents first meet a bitmap of the items' fingerprints (its size is a parameter, not a
function of either table), and what passes is joined with the items' fingerprints. Each match is then
extended: both sides carry the words around the gram that windows containing it can reach, and the windows
that agree word for word are the hits. No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.llm import buffers
from sparcel.session import stage

SPAN, GRAM = 10, 5

HIT = pa.struct([("fp", pa.int64()), ("kind", pa.int32()), ("size", pa.int32()), ("pos", pa.int64()), ("left", pa.int32()), ("words", pa.list_(pa.string()))])
HITS = "array<struct<fp:bigint,kind:int,size:int,pos:bigint,left:int,words:array<string>>>"


def winnowed(hashes: np.ndarray, first: np.ndarray, size: int, width: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, fingerprints) of the rightmost smallest gram of every ``width`` consecutive ones.

    ``hashes`` are those of the words of several texts, which begin at ``first``; windows lie inside one text.
    """
    n = len(hashes) - size + 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    values = buffers.mix(buffers.span_hash(buffers.code_sums(hashes | np.uint64(1)), at, at + size) + np.uint64(kind))
    least = buffers.sliding_min(values, width)
    last = np.zeros(len(least), np.int64)
    for shift in range(width):
        np.copyto(last, at[: len(least)] + shift, where=values[shift : shift + len(least)] == least)
    text_end = np.repeat(first[1:], np.diff(first))
    kept = np.unique(last[at[: len(least)] + size + width - 1 <= text_end[: len(least)]])
    return kept, values[kept]


def _scan(batch: pa.RecordBatch, span: int, k: int, short: list[int], bitmap: np.ndarray | None) -> tuple[np.ndarray, list[list[dict]]]:
    """Number of words and kept grams of each text; with a bitmap only grams that it may hold."""
    buf, bounds = buffers.text_bytes(batch.column(1))
    lower, starts, ends, first = buffers.words(buf, bounds)
    hashes = buffers.span_hash(buffers.byte_sums(lower), starts, ends)
    hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
    raw = lower.tobytes()
    for kind, size, width in [(0, k, span - k + 1), *((n, n, 1) for n in short)]:
        at, values = winnowed(hashes, first, size, width, kind)
        if bitmap is not None:
            slot = values & np.uint64(len(bitmap) * 64 - 1)
            passed = (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            at, values = at[passed], values[passed]
        for p, value, doc in zip(at.tolist(), values.view(np.int64).tolist(), (np.searchsorted(first, at, "right") - 1).tolist()):
            lo, hi = max(int(first[doc]), p - width + 1), min(int(first[doc + 1]), p + size + width - 1)
            context = [raw[a:b].decode() for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
            hits[doc].append({"fp": value, "kind": kind, "size": size, "pos": p - int(first[doc]), "left": p - lo, "words": context})
    return np.diff(first), hits


def _scanned(rows: DataFrame, key: str, span: int, k: int, short: list[int], bitmap=None) -> DataFrame:
    """(key, text) -> (key, n_words, hits)."""
    buffers.bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if bitmap is None else np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            for piece in buffers.pieces(batch):
                n, hits = _scan(piece, span, k, short, table)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n.astype(np.int64)), pa.array(hits, pa.list_(HIT))], names=[key, "n_words", "hits"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInArrow(run, f"{key} {kind}, n_words bigint, hits {HITS}")


def item_grams(benchmark: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """(item_id, fp, kind, size, left, words): kept grams; kind 0 of whole windows, n of an item of n < span words."""
    found = _scanned(benchmark, "item_id", span, k, list(range(1, span)))
    return found.select("item_id", "n_words", F.explode("hits").alias("h")).filter("h.kind = 0 or h.kind = n_words").select("item_id", "h.fp", "h.kind", "h.size", "h.left", "h.words")


def _bitmap(items: DataFrame, bits: int) -> bytes:
    """One bit for each value that the low ``bits`` of a fingerprint can have: 2^bits / 8 bytes at most."""
    words = (
        items.select(F.col("fp").bitwiseAND((1 << bits) - 1).alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("set"))
        .toArrow()
    )
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words.column("at").to_numpy()] = words.column("set").to_numpy().view(np.uint64)
    return table.tobytes()


def _agreeing(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def matches(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM, bits: int = 24, broadcast_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(rows, hits) of ``docs``: (row, doc_id, n_words) and (row, item_id, start, end), in words.

    The items' grams are broadcast if there are no more than ``broadcast_rows`` of them; else both sides shuffle.
    """
    items = stage(item_grams(benchmark, span, k), "item-grams")
    short = sorted(r[0] for r in items.filter("kind > 0").select("kind").distinct().collect())
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(items, bits))
    rows = docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("key"), "text")
    scanned = stage(_scanned(rows, "key", span, k, short, bitmap).select("key.*", "n_words", "hits"), "document-grams")
    grams = scanned.select("row", F.explode("hits").alias("h")).select("row", "h.fp", "h.kind", "h.size", "h.pos", F.col("h.left").alias("d_left"), F.col("h.words").alias("d_words"))
    side = items.select("item_id", "fp", "kind", F.col("left").alias("i_left"), F.col("words").alias("i_words"))
    joined = grams.join(F.broadcast(side) if items.count() <= broadcast_rows else side, ["fp", "kind"])
    d, i, n = F.col("d_words"), F.col("i_words"), F.col("size")
    gram = F.slice(d, F.col("d_left") + 1, n) == F.slice(i, F.col("i_left") + 1, n)
    left = _agreeing(F.reverse(F.slice(d, F.lit(1), F.col("d_left"))), F.reverse(F.slice(i, F.lit(1), F.col("i_left"))))
    right = _agreeing(F.slice(d, F.col("d_left") + n + 1, F.lit(span)), F.slice(i, F.col("i_left") + n + 1, F.lit(span)))
    hits = (
        joined.filter(gram)
        .withColumn("l", left)
        .withColumn("r", right)
        .filter(f"kind > 0 or l + size + r >= {span}")
        .select("row", "item_id", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + n + F.col("r")).alias("end"))
    )
    return scanned.select("row", "doc_id", "n_words"), hits


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM, bits: int = 24) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): row, doc_id, n_words, n_hit, item_ids, contaminated.

    Windows are ``span`` consecutive words of an item, or all words of a shorter one; ``n_hit`` counts the
    words of the document inside any occurrence of a window, ``item_ids`` are the items it comes from, as
    sorted strings. Null and empty texts have no words and hit nothing, as have items without words. Items
    that repeat an id count once; an item whose id is null hits words and is not listed. Rows that repeat a doc_id
    count each. An empty benchmark hits nothing. Further columns are not looked at.
    """
    rows, hits = matches(docs, benchmark, span, k, bits)
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(s["end"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("n")
        ),
        lambda acc: acc["n"],
    )
    found = hits.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    found = found.select("row", covered.alias("hit"), "ids")
    return rows.join(found, "row", "left").select(
        "row", "doc_id", "n_words",
        F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("ids", F.array().cast("array<string>")).alias("item_ids"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
    )
