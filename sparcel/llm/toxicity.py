"""Toxicity by a chain of classifiers over words.

Categories are predicted one after the other. Each has a linear (logistic) model over the presence of words and
over the probabilities of the categories before it. While training, those probabilities are out-of-fold: a
text's come from models that did not see it, so later models learn how far to trust them. Equal texts share
a fold. For scoring, each category has one model trained on the whole sample.

Which words a category's model has is decided by evidence over all labelled texts, not over the sample: a word
enters if texts with it have the category so much more or less often than others (G test) that chance would hardly
do that to one word of the whole vocabulary, and if the words chosen before don't explain it. The sample then holds about ``ROWS_A_WORD`` texts of each such
word, or all of them, so rare words are learnt from as many texts as there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.llm import buffers
from sparcel.session import stage

FOLDS = 4
#: Texts of each word of a model that the sample holds at least, if there are so many.
ROWS_A_WORD = 20
#: Row numbers that may be broadcast.
BROADCAST_ROWS = 1_000_000


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def odds(self, words: np.ndarray, first: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Log-odds of texts whose words are ``words[first[i]:first[i + 1]]``, with further features."""
        sums = np.concatenate(([0.0], np.cumsum(self.weights[words])))
        n = len(self.weights) - more.shape[1]
        return sums[first[1:]] - sums[first[:-1]] + more @ self.weights[n:] + self.bias


def probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_linear(words: np.ndarray, first: np.ndarray, more: np.ndarray, labels: np.ndarray, support: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.3, seed: int = 1) -> Linear:
    """Logistic regression by AdaGrad over small batches; words outside ``support`` keep the weight zero."""
    n_words = len(support)
    free = np.concatenate((support, np.ones(more.shape[1], bool)))
    held = support[words]
    words, first = words[held], np.concatenate(([0], np.cumsum(held)))[first]
    weights, bias = np.zeros(len(free)), 0.0
    seen, bias_seen = np.full(len(free), 1e-3), 1e-3
    rng = np.random.default_rng(seed)
    size = np.diff(first)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            n = size[rows]
            mine = words[np.repeat(first[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            starts = np.concatenate(([0], np.cumsum(n)))
            error = (probability(Linear(weights, bias).odds(mine, starts, more[rows])) - labels[rows]) / len(rows)
            slope = np.bincount(mine, np.repeat(error, n), n_words) if len(mine) else np.zeros(n_words)
            slope = np.concatenate((slope, error @ more[rows])) * free
            seen += slope**2
            weights -= rate / np.sqrt(seen) * slope
            bias_seen += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(bias_seen)
    return Linear(weights, bias)


def fit_selected(words: np.ndarray, first: np.ndarray, more: np.ndarray, labels: np.ndarray, allowed: np.ndarray, most: float, rounds: int = 8) -> Linear:
    """Logistic regression with those ``allowed`` words whose excess the other words don't explain.

    Each round adds the words with the strongest excess over what the model so far expects, weakest last, until none
    exceeds ``most`` squared standard errors. The error is never taken as less than that of the base rate.
    """
    text = np.repeat(np.arange(len(labels)), np.diff(first))
    support = np.zeros(len(allowed), bool)
    base = labels.mean() * (1 - labels.mean()) if len(labels) else 0
    turn = 0
    while allowed.any() and base > 0:
        p = probability(fit_linear(words, first, more, labels, support, epochs=10).odds(words, first, more))
        excess = np.bincount(words, (labels - p)[text], len(allowed))
        error = np.bincount(words, np.maximum(p * (1 - p), base)[text], len(allowed))
        g = np.where(allowed & ~support, excess**2 / np.maximum(error, 1e-12), 0)
        if g.max() <= most:
            break
        support |= g > max(most, 0.25 * g.max() if turn < rounds else 0)
        turn += 1
    return fit_linear(words, first, more, labels, support)


@dataclass
class Chain:
    categories: list[str]
    vocabulary: np.ndarray  # sorted word hashes
    links: list[Linear]

    def known(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different known words of each text, as places in the vocabulary, and where each text's begin."""
        hashes, first = word_hashes(buf, bounds)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == hashes
        pairs = np.unique(text[hit] * len(self.vocabulary) + at[hit])
        return pairs % len(self.vocabulary), np.searchsorted(pairs, np.arange(len(bounds)) * len(self.vocabulary))

    def probabilities(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """[text, category]"""
        out = np.zeros((len(first) - 1, len(self.links)))
        for i, link in enumerate(self.links):
            out[:, i] = probability(link.odds(words, first, out[:, :i]))
        return out


def word_hashes(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lower, starts, ends, first = buffers.words(buf, bounds)
    return buffers.span_hash(buffers.byte_sums(lower), starts, ends), first


def train(chain: Chain, words: np.ndarray, first: np.ndarray, folds: np.ndarray, labels: np.ndarray, support: np.ndarray, most: float) -> Chain:
    """``chain`` with its links, from texts whose words are ``words[first[i]:first[i + 1]]``, places in its vocabulary.

    ``support`` [word, category] tells which words a category's model may have, ``most`` what chance may exceed.
    """
    earlier = np.zeros((len(labels), 0))
    for k in range(len(chain.categories)):
        chain.links.append(fit_selected(words, first, earlier, labels[:, k], support[:, k], most))
        if k + 1 < len(chain.categories):
            out_of_fold = np.zeros(len(labels))
            for fold in range(FOLDS):
                rest, mine = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
                if not len(mine):
                    continue

                def taken(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    return np.concatenate([words[first[i] : first[i + 1]] for i in rows] + [np.zeros(0, np.int64)]), np.concatenate(([0], np.cumsum(np.diff(first)[rows])))

                link = fit_selected(*taken(rest), earlier[rest], labels[rest, k], support[:, k], most)
                out_of_fold[mine] = probability(link.odds(*taken(mine), earlier[mine]))
            earlier = np.column_stack((earlier, out_of_fold))
    return chain


def _different(rows: DataFrame, categories: list[str]) -> DataFrame:
    """(draw, fold, sha, text, categories), one row for equal texts with equal labels; a written table."""
    sha = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("sha")
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    folds = F.pmod(F.xxhash64(F.lit("fold"), F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int")
    all_rows = stage(rows.select(F.monotonically_increasing_id().alias("row"), draw.alias("draw"), folds.alias("fold"), sha, "text", *categories), "labelled")
    key = ["sha", *categories]
    repeated = all_rows.groupBy(*key).agg(F.min("row").alias("kept"), F.count(F.lit(1)).alias("same")).filter("same > 1").select(*key, "kept")
    again = stage(all_rows.select("row", *key).join(repeated, key).filter("row <> kept").select("row"), "repeats")
    # an integer a row: so many of them fit any executor, beyond that both sides shuffle
    return all_rows.join(F.broadcast(again) if again.count() <= BROADCAST_ROWS else again, "row", "left_anti").drop("row")


def _word_counts(rows: DataFrame, categories: list[str]) -> DataFrame:
    """(word, n, k_0, k_1, ...): texts with each word, and how many of these have each category."""
    counts = [f"k_{i}" for i in range(len(categories))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in buffers.pieces(batch):
                hashes, first = word_hashes(*buffers.text_bytes(piece.column(0)))
                text = np.repeat(np.arange(piece.num_rows), np.diff(first))
                order = np.lexsort((text, hashes))
                hashes, text = hashes[order], text[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
                found, at, n = np.unique(hashes[new], return_inverse=True, return_counts=True)
                sums = [np.bincount(at, piece.column(i + 1).to_numpy(zero_copy_only=False)[text[new]] > 0, len(found)).astype(np.int64) for i in range(len(categories))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found.view(np.int64), n.astype(np.int64), *sums)], names=["word", "n", *counts])

    found = rows.select("text", *categories).mapInArrow(run, "word bigint, n bigint, " + ", ".join(f"{c} bigint" for c in counts))
    return found.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *counts)])


def _evidence(n: Column, k: Column, rows: int, positive: int) -> Column:
    """G of the table (has the word or not, has the category or not); never null."""

    def part(seen: Column, across: Column, down: int) -> Column:
        return F.when((seen > 0) & (across > 0) & F.lit(down > 0), seen * F.log(seen * F.lit(float(rows)) / (across * F.lit(float(down))))).otherwise(0.0)

    n, k, others = n.cast("double"), k.cast("double"), F.lit(float(rows)) - n.cast("double")
    lacks = F.lit(float(positive)) - k
    return 2 * (part(k, n, positive) + part(n - k, n, rows - positive) + part(lacks, others, positive) + part(others - lacks, others, rows - positive))


def threshold(words: int) -> float:
    """G that chance exceeds in one of so many words (chi-squared, one degree of freedom)."""
    low, high = 0.0, 1000.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if math.erfc(math.sqrt(middle / 2)) > min(0.05, 1 / max(words, 1)) else (low, middle)
    return high


def fit(labelled: DataFrame, categories: list[str], sample: int = 6000, least: int = 3) -> Chain:
    """Learn from (doc_id, text, one 0/1 column per category, in the order of the chain).

    Rows without a label in some category are left out; null text is empty; equal texts with equal labels count once.
    Words are chosen by evidence over all rows, but for those of fewer than ``least`` texts. About ``sample`` rows, picked
    by a hash of doc_id, and about ``ROWS_A_WORD`` of each chosen word are used with their whole texts; the executors
    reduce each to its different chosen words. Without rows every probability is 0.5.
    """
    complete = labelled.select("doc_id", "text", *[F.col(c).cast("int").alias(c) for c in categories]).dropna(subset=categories)
    buffers.bounded_batches(labelled.sparkSession)
    rows = _different(complete, categories)
    total, *positive = rows.agg(F.count(F.lit(1)), *[F.coalesce(F.sum((F.col(c) > 0).cast("long")), F.lit(0)) for c in categories]).first()
    counts = stage(_word_counts(rows, categories).filter(F.col("n") >= least), "word-counts")
    most = threshold(counts.count())
    found = [(_evidence(F.col("n"), F.col(f"k_{i}"), total, positive[i]) > most).alias(f"s_{i}") for i in range(len(categories))]
    chosen = counts.select("word", "n", *found).filter(" or ".join(f"s_{i}" for i in range(len(categories)))).toArrow()
    hashes = chosen.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    support = np.column_stack([chosen.column(f"s_{i}").to_numpy() for i in range(len(categories))])[order]
    chain = Chain(categories, hashes[order], [])
    base = sample / max(total, 1)
    shared = labelled.sparkSession.sparkContext.broadcast((chain, np.maximum(base, ROWS_A_WORD / chosen.column("n").to_numpy()[order])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shares = shared.value
        for batch in batches:
            for piece in buffers.pieces(batch):
                words, first = known.known(*buffers.text_bytes(piece.column(3)))
                share = np.full(piece.num_rows, base)
                np.maximum.at(share, np.repeat(np.arange(piece.num_rows), np.diff(first)), shares[words])
                found = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(words.astype(np.int32)))
                taken = pa.array(piece.column(0).to_numpy() < share)
                yield pa.RecordBatch.from_arrays([piece.column(1), piece.column(2), found, *piece.columns[4:]], names=["fold", "sha", "words", *categories]).filter(taken)

    picked = rows.mapInArrow(run, "fold int, sha string, words array<int>, " + ", ".join(f"`{c}` int" for c in categories))
    table = picked.orderBy("sha", *categories).drop("sha").toArrow()
    texts = [w.values.to_numpy().astype(np.int64) for w in table.column("words")]
    words = np.concatenate([*texts, np.zeros(0, np.int64)])
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    labels = np.column_stack([table.column(c).to_numpy() > 0 for c in categories]).astype(float)
    return train(chain, words, first, table.column("fold").to_numpy(), labels, support, most)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and one probability ``p_<category>`` per category.

    Null and empty texts have no words. Rows are independent, whole texts are scored, further columns
    are not looked at.
    """
    spark = docs.sparkSession
    buffers.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in buffers.pieces(batch):
                p = shared.value.probabilities(*shared.value.known(*buffers.text_bytes(piece.column(1))))
                yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(p[:, i]) for i in range(p.shape[1])]], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"`{n}` double" for n in names))
