"""Language identification by prediction by partial matching, with frozen statistics.

Each language has a tree of byte contexts of up to ``order`` bytes. In a context with n bytes seen, d of
them different, a byte seen c times costs -log2(c / (n + d)) bits; any other costs the escape
-log2(d / (n + d)) and then what it costs in the next shorter context; below the empty context all bytes are
alike. The language whose trees give a text the shortest code is predicted.

As nothing is learnt while scoring, the code length of every byte in every context is a constant. The
contexts of all languages are laid into one automaton, so a text is scored by table look-ups: the deepest
known context before each byte, then one row with the byte's cost in each language. Contexts are kept by
count, so the trees are deep where the sample is dense; ``contexts`` bounds their number.

Before coding, A-Z is lowered and any other ASCII that is no letter counts as a space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparcel.llm import buffers

ORDER, TEXTS_PER_LANGUAGE, CONTEXTS = 4, 1500, 8000

_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _padded(buf: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with ``order`` spaces before each text, and the places of the real bytes."""
    places = np.arange(len(buf)) + order * np.repeat(np.arange(1, len(bounds)), np.diff(bounds))
    out = np.full(len(buf) + order * (len(bounds) - 1), 32, np.uint8)
    out[places] = _FOLD[buf]
    return out, places


@dataclass
class Model:
    languages: list[str]
    order: int
    child: np.ndarray  # [context, byte]: the context one byte longer, or -1
    bits: np.ndarray  # [context * 256 + byte, language]

    def code_lengths(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of each text in each language."""
        n = len(bounds) - 1
        if not len(buf):
            return np.zeros((n, len(self.languages)))
        text, places = _padded(buf, bounds, self.order)
        node = np.zeros(len(places), np.int32)
        alive = np.ones(len(places), bool)
        for back in range(1, self.order + 1):
            deeper = self.child[node, text[places - back]]
            alive &= deeper >= 0
            np.copyto(node, deeper, where=alive)
        sums = np.zeros((len(places) + 1, len(self.languages)))
        np.cumsum(self.bits[node.astype(np.int64) * 256 + text[places]], axis=0, out=sums[1:])
        return sums[bounds[1:]] - sums[bounds[:-1]]


def _count_grams(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n): bytes with their ``order`` predecessors, counted a piece at a time."""
    for batch in batches:
        for piece in buffers.pieces(batch):
            langs = piece.column(0).to_pylist()
            for lang in sorted(set(langs)):
                mine = piece.filter(pa.array([x == lang for x in langs]))
                text, places = _padded(*buffers.text_bytes(mine.column(1)), order)
                gram = np.zeros(len(places), np.int64)
                for back in range(order, -1, -1):
                    gram = gram << 8 | text[places - back]
                values, counts = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values), pa.array(counts)], names=["lang", "gram", "n"])


def fit(texts: DataFrame, order: int = ORDER, per_language: int = TEXTS_PER_LANGUAGE, contexts: int = CONTEXTS) -> Model:
    """Learn from (doc_id, text, lang). Rows with a null text or lang are left out.

    Of each language about ``per_language`` texts, picked by a hash of doc_id, are counted whole: what comes to the driver is
    bounded by that parameter. ``order`` is 7 at most.
    """
    known = texts.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").count()
    share = F.pmod(F.xxhash64(F.lit("ppm"), "doc_id"), F.lit(1 << 30)) < F.lit(per_language * float(1 << 30)) / F.col("count")
    buffers.bounded_batches(texts.sparkSession)
    counted = (
        known.join(F.broadcast(sizes), "lang").filter(share).select("lang", "text")
        .mapInArrow(lambda batches: _count_grams(batches, order), "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    )
    names = sorted(set(counted.column("lang").to_pylist()))
    lang = np.array([names.index(x) for x in counted.column("lang").to_pylist()], np.int64)
    return compiled(names, lang, counted.column("gram").to_numpy(), counted.column("n").to_numpy(), order, contexts)


def compiled(names: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int, contexts: int) -> Model:
    """The automaton and its costs from counts of grams: ``order`` bytes and the byte after them."""
    byte, before = gram & 255, gram >> 8
    depth, context, weight = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.array([1 << 60])]
    for d in range(1, order + 1):
        found, which = np.unique(before & ((1 << 8 * d) - 1), return_inverse=True)
        depth.append(np.full(len(found), d))
        context.append(found)
        weight.append(np.bincount(which, n, len(found)).astype(np.int64))
    depth, context, weight = map(np.concatenate, (depth, context, weight))
    # a context is seen no more often than its own suffix, so the most frequent ones form a tree
    kept = np.lexsort((context, depth, -weight))[:contexts]
    depth, context = depth[kept], context[kept]
    place = {(int(d), int(c)): i for i, (d, c) in enumerate(zip(depth, context))}
    child = np.full((len(kept), 256), -1, np.int32)
    parent = np.zeros(len(kept), np.int64)
    for (d, c), i in place.items():
        if d:
            # contexts are read backwards: the oldest byte is the last to be added
            parent[i] = place[d - 1, c & ((1 << 8 * (d - 1)) - 1)]
            child[parent[i], c >> 8 * (d - 1)] = i
    bits = np.zeros((len(kept), 256, len(names)), np.float32)
    for d in range(order + 1):
        mine = np.flatnonzero(depth == d)
        if not len(mine):
            break
        ordered = mine[np.argsort(context[mine])]
        key = before & ((1 << 8 * d) - 1)
        at = np.minimum(np.searchsorted(context[ordered], key), len(ordered) - 1)
        ok = context[ordered][at] == key
        seen = np.zeros((len(ordered), 256, len(names)), np.float32)
        np.add.at(seen, (at[ok], byte[ok], lang[ok]), n[ok])
        total, different = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
        shorter = bits[parent[ordered]] if d else np.full((1, 256, len(names)), 8, np.float32)
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = np.where(seen > 0, -np.log2(seen / (total + different)), -np.log2(different / (total + different)) + shorter)
        bits[ordered] = np.where(total > 0, cost, shorter)
    return Model(names, order, child, bits.reshape(len(kept) * 256, len(names)))


def identify(docs: DataFrame, model: Model, effective_bytes: int = 64) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, lang_pred, score.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learnt. Else the score is the
    language's share if each language counts 2 to the power of minus its code length, taken as if the text had
    ``effective_bytes`` bytes at most. Of equal code lengths the first language in sorted order wins. Rows are independent,
    whole texts are scored, further columns are not looked at.
    """
    spark = docs.sparkSession
    buffers.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for piece in buffers.pieces(batch):
                buf, bounds = buffers.text_bytes(piece.column(1))
                n = np.diff(bounds)
                bits = model.code_lengths(buf, bounds)
                best = bits.argmin(1) if model.languages else np.zeros(len(n), np.int64)
                over = (bits - bits.min(1, keepdims=True)) * np.minimum(1, effective_bytes / np.maximum(n, 1))[:, None] if model.languages else bits
                share = 1 / np.maximum(np.exp2(-over).sum(1), 1)
                some = piece.column(2).to_numpy(zero_copy_only=False) & bool(model.languages)
                names = np.array([*model.languages, "und"], object)[np.where(some, best, len(model.languages))]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(names, pa.string()), pa.array(np.where(some, share, 0.0))], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", has_letter.alias("has_letter")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
