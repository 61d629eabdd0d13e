"""Quality classifier on supervised subword embeddings.

Features of a text are its tokens (runs of bytes that are no white space) and the byte n-grams inside
them, the space on either side included, all hashed into one table of vectors; a token that repeats the one
before it adds a feature of its own. A text is the mean of its features'
vectors; a linear layer and softmax give the classes; all of it is trained by stochastic gradient
descent in numpy, on a bounded sample of labelled texts.

For scoring, the linear layer is folded into the table: a text's log-odds are the mean of one number per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparcel.llm import buffers
from sparcel.llm.samples import bounded_sample

BUCKETS, DIMENSIONS, GRAMS = 1 << 18, 16, (3, 4, 5)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(buf: np.ndarray, bounds: np.ndarray, buckets: int = BUCKETS, sizes: tuple[int, ...] = GRAMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, first feature of each text) for each kind of feature, in the order of the texts."""
    n = np.diff(bounds)
    places = np.arange(len(buf)) + np.repeat(np.arange(1, len(bounds)), n)
    text = np.full(len(buf) + len(bounds), 32, np.uint8)  # a space before each text and after the last
    text[places] = np.where(_SPACE[buf], 32, buf)
    edges = bounds + np.arange(len(bounds))  # the space before each text
    starts, ends = buffers.runs(text != 32)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    tokens, first = buffers.span_hash(buffers.byte_sums(text), starts, ends), np.searchsorted(starts, edges)
    yield (tokens >> shift).astype(np.int64), first
    again = np.zeros(len(tokens), bool)
    again[1:] = tokens[1:] == tokens[:-1]
    again[first[:-1][first[:-1] < len(tokens)]] = False
    again = np.flatnonzero(again)
    yield np.zeros(len(again), np.int64), np.searchsorted(again, first)
    space = text == 32
    inner = np.concatenate(([0], np.cumsum(space)))
    for size in sizes:
        count = max(len(text) - size + 1, 0)
        value = np.zeros(count, np.uint64)
        for i in range(size):
            value = value << np.uint64(8) | text[i : count + i]
        # no space inside; a lone byte between two spaces is a token, no gram
        at = np.flatnonzero((inner[size - 1 : count + size - 1] - inner[1 : count + 1] == 0) & ~(space[:count] & space[size - 1 :][:count]))
        yield (buffers.mix(value[at] + np.uint64(size)) >> shift).astype(np.int64), np.searchsorted(at, edges)


@dataclass
class Model:
    """Log-odds of class 1 that each bucket stands for, and those of a text without features."""

    odds: np.ndarray
    bias: float
    sizes: tuple[int, ...]

    def scores(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
        for found, first in features(buf, bounds, len(self.odds), self.sizes):
            sums = np.concatenate(([0], np.cumsum(self.odds[found], dtype=np.float64)))
            total += sums[first[1:]] - sums[first[:-1]]
            count += np.diff(first)
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(count, 1), -500, 500)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int, sizes: tuple[int, ...], dimensions: int = DIMENSIONS, steps: int = 20_000, rate: float = 1.0, seed: int = 1) -> Model:
    """Stochastic gradient descent over (buckets, weights) of each text; the rate falls to 0 linearly."""
    epochs = -(-steps // max(len(rows), 1))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (buckets, dimensions)).astype(np.float32)
    layer, bias = np.zeros((2, dimensions), np.float32), np.zeros(2, np.float32)
    if len(labels):
        bias[:] = np.log((np.bincount(labels, minlength=2) + 1) / (len(labels) + 2))
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            found, weight = rows[i]
            hidden = weight @ vectors[found]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            error *= rate * (1 - step / steps)
            back = error @ layer
            layer -= np.outer(error, hidden)
            bias -= 0.1 * error
            vectors[found] -= np.outer(weight, back)
            step += 1
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]), sizes)


def fit(labelled: DataFrame, sample: int = 2500, buckets: int = BUCKETS, sizes: tuple[int, ...] = GRAMS) -> Model:
    """Learn from (doc_id, text, label 0 or 1); rows with a null label are left out, null text is empty.

    About ``sample`` rows, picked by a hash of doc_id, are used, each with its whole text: what the driver holds is bounded by
    that parameter. Their features are counted by the executors. Without rows every score is 0.5.
    """
    chosen = bounded_sample(labelled.filter("label is not null").select("doc_id", "text", F.col("label").cast("int").alias("label")), sample)
    buffers.bounded_batches(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in buffers.pieces(batch):
                kinds = list(features(*buffers.text_bytes(piece.column(1)), buckets, sizes))
                found, counts = [], []
                for i in range(piece.num_rows):
                    values, n = np.unique(np.concatenate([b[first[i] : first[i + 1]] for b, first in kinds]), return_counts=True)
                    found.append(values.astype(np.int32))
                    counts.append(n.astype(np.int32))
                yield pa.RecordBatch.from_arrays([piece.column(2), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["label", "found", "counts"])

    table = chosen.orderBy(F.xxhash64("doc_id"), "text").mapInArrow(run, "label int, found array<int>, counts array<int>").toArrow()
    rows = []
    for found, n in zip(table.column("found"), table.column("counts")):
        n = n.values.to_numpy().astype(np.float32)
        rows.append((found.values.to_numpy(), n / max(n.sum(), 1)))
    return train(rows, (table.column("label").to_numpy() > 0).astype(np.int64), buckets, sizes)


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """All columns of ``docs``, which must have a ``text``, and the score as a further column ``name``."""
    spark = docs.sparkSession
    buffers.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in buffers.pieces(batch):
                scores = shared.value.scores(*buffers.text_bytes(piece.column(piece.schema.get_field_index("text"))))
                yield piece.append_column(name, pa.array(scores))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, score from 0 to 1.

    Null and empty texts get the score of a text without features. Rows are independent, whole texts are
    scored, further columns are not looked at.
    """
    return with_score(docs.select("doc_id", "text"), model, "score").select("doc_id", "score")
