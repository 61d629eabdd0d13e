"""Packing of documents into sequences: a configuration LP over the histogram of lengths.

A configuration is a multiset of lengths that fits one sequence. The covering program (fewest sequences such that
every length is covered as often as it occurs) is solved by multiplicative weights: a length's weight falls with the share
of its pieces that is covered, a knapsack dynamic program over the capacity finds the configuration of the greatest
weight, and it enters with a step that covers none of its lengths more than once. The solution is
rounded down to whole sequences and the rest of the histogram is filled by decreasing length. All of this sees the histogram alone: at most ``capacity`` numbers,
whatever the number of documents; the plan has a bounded number of configurations, each with how often it is used.

Pieces then take places: the r-th piece of a length takes the r-th place that the plan has for the length. Ranks come
from counts per task, so a length that a third of all pieces share is ranked by all tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparcel.llm import buffers
from sparcel.llm.chunks import chunked, word_encoder
from sparcel.session import stage

#: Steps of the LP's solution at most; the largest share of a length that one step covers; how fast a weight falls with the share
#: covered; how much more a token of a long piece weighs; lengths priced in a step: the least covered ones and a rotating choice of all.
STEPS, STEP, SHARPNESS, TILT, LEAST, SPREAD = 1500, 0.5, 1.0, 0.03, 64, 64


@dataclass
class Plan:
    """For each run of places of one length: the length, the first rank, the first sequence, places in a sequence, the first offset.

    Sorted by length and rank; ``sequences`` is the number of sequences.
    """

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and offsets of pieces given by length and rank."""
        high = int(self.rank.max(initial=0)) + int(rank.max(initial=0)) + 1
        at = np.searchsorted(self.length * high + self.rank, length * high + rank, "right") - 1
        turn = rank - self.rank[at]
        return self.sequence[at] + turn // self.each[at], self.offset[at] + turn % self.each[at] * length


def best_configuration(lengths: np.ndarray, values: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """Index of a length -> how often, for the most valuable multiset that fits; no length more often than ``left``.

    A bounded knapsack: a length that may come n times is offered as 1, 2, 4, ... copies that add up to n.
    """
    offers: list[tuple[int, int]] = []
    for j, most in enumerate(np.minimum(left, capacity // lengths).astype(int).tolist()):
        copies = 1
        while most > 0:
            offers.append((j, min(copies, most)))
            most -= copies
            copies *= 2
    best, taken = np.zeros(capacity + 1), np.zeros((len(offers), capacity + 1), bool)
    for row, (j, n) in enumerate(offers):
        size = n * int(lengths[j])
        gain = best[:-size] + n * values[j]
        np.greater(gain, best[size:], out=taken[row, size:])
        np.maximum(best[size:], gain, out=best[size:])
    config: dict[int, int] = {}
    room = capacity
    for row in range(len(offers) - 1, -1, -1):
        if taken[row, room]:
            j, n = offers[row]
            config[j] = config.get(j, 0) + n
            room -= n * int(lengths[j])
    return config


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], float]]:
    """Configurations with their amounts, none of which covers a length beyond its demand.

    A step raises the covered share of each of its lengths by ``STEP`` at most, and all but covers its scarcest one.
    Pricing looks at ``LEAST`` lengths that are covered least and at ``SPREAD`` others over the whole range, which leave no gap
    at a sequence's end.
    """
    covered = np.zeros(len(lengths))
    found: list[tuple[dict[int, int], float]] = []
    for step in range(STEPS):
        open_ = np.flatnonzero(demand - covered >= 1)
        if not len(open_):
            break
        weight = np.exp(-SHARPNESS * covered[open_] / demand[open_])
        spread = (np.arange(SPREAD) * len(open_) // SPREAD + 7 * step) % len(open_)
        some = open_[np.union1d(np.argsort(-weight, kind="stable")[:LEAST], spread)]
        worth = lengths[some] * np.exp(-SHARPNESS * covered[some] / demand[some]) * (lengths[some] / capacity) ** TILT
        chosen = best_configuration(lengths[some], worth, demand[some] - covered[some], capacity)
        config = {int(some[j]): n for j, n in chosen.items()}
        amount = min(min(demand[j] - covered[j], max(STEP * demand[j], n)) / n for j, n in config.items())
        for j, n in config.items():
            covered[j] += n * amount
        found.append((config, amount))
    return found


def plan_sequences(histogram: dict[int, int], capacity: int) -> Plan:
    """Places for ``histogram`` (length -> pieces), every length between 1 and ``capacity``."""
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(n)] for n in lengths], np.int64)
    used: list[tuple[dict[int, int], int]] = []

    def use(config: dict[int, int], most: float) -> int:
        times = int(min([most, *(left[j] // n for j, n in config.items())]))
        if times:
            used.append((config, times))
            for j, n in config.items():
                left[j] -= n * times
        return times

    if len(left):
        use({len(lengths) - 1: 1}, left[-1] if lengths[-1] == capacity else 0)  # whole sequences need no company
    some = np.flatnonzero(left)
    for config, amount in solve(lengths[some], left[some].astype(float), capacity):
        use({int(some[j]): n for j, n in config.items()}, np.floor(amount))
    while left.any():  # by decreasing length, each step as often as it can be repeated
        config, room = {}, capacity
        for j in np.flatnonzero(left)[::-1].tolist():
            n = int(min(left[j], room // lengths[j]))
            if n:
                config[j] = n
                room -= n * int(lengths[j])
        use(config, np.inf)
    rows, first, ranks = [], 0, np.zeros(len(lengths), np.int64)
    for config, times in used:
        offset = 0
        for j in sorted(config, reverse=True):
            rows.append((int(lengths[j]), int(ranks[j]), first, config[j], offset))
            ranks[j] += times * config[j]
            offset += config[j] * int(lengths[j])
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*(table[:, k].copy() for k in range(5)), first)


_PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint, _part bigint, _rank bigint"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of all documents, each with its rank among the pieces of its length in the same task."""
    buffers.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seen = word_encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for piece in buffers.pieces(batch, target=4 << 20):
                _, _, first, chunks = chunked(piece.column(1))
                ids, size = encoder.encode(chunks)
                bounds = np.concatenate(([0], np.cumsum(size)))[first]
                data, total = np.insert(ids, bounds[1:], end_id).astype("<u4").tobytes(), np.diff(bounds) + 1
                begin = np.cumsum(total) - total
                pieces = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(total[doc] - start, capacity)
                at = 4 * (begin[doc] + start)
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
                order = np.argsort(length, kind="stable")
                rank = np.empty(len(order), np.int64)
                counts = np.bincount(length, minlength=capacity + 1)
                rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts - seen, counts)
                seen += counts
                columns = [piece.column(0).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(c.split(" ")[0] for c in _PIECES.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_PIECES}")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row per piece.

    A document is the ids of its text and ``end_id``; one of more than ``capacity`` ids is cut into pieces of that length, the last
    one shorter. Every sequence holds whole pieces from offset 0 on without gaps. Null and empty texts are ``end_id``
    alone. Repeated rows and ids are documents of their own, null ids stay null, an empty table gives no
    rows; further columns are not looked at. Texts are read whole: a very long one is one row of one task.
    """
    spark = docs.sparkSession
    pieces = stage(cut_pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_sequences(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(5).to_numpy() + batch.column(6).to_numpy()
            sequence, offset = plan.value.place(batch.column(3).to_numpy(), rank)
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ranked = pieces.join(before, ["_part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "_rank", "_before")
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
