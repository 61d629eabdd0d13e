"""Alignment of two tokenizers' ids over the same bytes, by lockstep merging.

Both id sequences of a text give back its bytes. Where a token of either ends at the same byte the text can be cut; the
tokens between two cuts are a group, and every A token of a group is linked with every B token of it.

All documents of a batch are merged at once. The state is one vector with a pointer into the A tokens and
one into the B tokens of each lane; a step compares the ends that the pointers see, marks a cut where they are equal and moves on
the pointer that is behind, or both. Lanes at their end leave the vector. A document is one lane, or several if it is
long: a new lane may begin at any space where both tokenizers begin a token, so a very long text doesn't leave the vector with one lane.

How many documents hold a linked pair of ids is counted over all documents: a block of documents sends each of its distinct
pairs once with its count, and gets back the totals of these pairs, so no row per document and link is ever shuffled.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparcel.llm import buffers
from sparcel.llm.chunks import ChunkEncoder, byte_encoder, chunked, piece_encoder, ragged, token_bytes
from sparcel.session import stage

#: Chunks (about words) of a lane; text bytes of a block and of what is merged at once; links of a group that are listed one by one at most.
LANE, BLOCK, PIECE, LISTED = 64, 8 << 20, 1 << 20, 1 << 16


@dataclass
class Tokens:
    """One tokenizer: its chunk encoder, the bytes of each id, their number, and decimal ids with each separator."""

    encoder: ChunkEncoder
    names: pa.Array
    length: np.ndarray

    @functools.cached_property
    def decimal(self) -> list[pa.Array]:
        """Decimal ids followed by a comma, by a bar and by a semicolon."""
        return [pa.array([f"{i}{mark}" for i in range(len(self.length))]) for mark in ",|;"]


def _tokens(encoder: ChunkEncoder, names: list[bytes]) -> Tokens:
    return Tokens(encoder, pa.array(names, pa.binary()), np.array(list(map(len, names)), np.int64))


@functools.lru_cache(2)
def byte_tokens(path: str) -> Tokens:
    """A byte-level tokenizer file."""
    return _tokens(byte_encoder(path), token_bytes(path))


@functools.lru_cache(2)
def piece_tokens(path: str) -> Tokens:
    """A sentencepiece model: pieces in UTF-8, U+2581 as a space, <0xHH> as that byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
    return _tokens(piece_encoder(path), names)


def lockstep(a_ends: np.ndarray, a_first: np.ndarray, b_ends: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the A and of the B tokens that end a group.

    ``a_first`` and ``b_first`` hold the first token of each lane and behind them the number of tokens; ends are byte offsets that rise
    through all lanes, and a lane's last A and B tokens end alike.
    """
    a_cut, b_cut = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    lanes = np.flatnonzero(np.diff(a_first))
    a, b, stop = a_first[lanes], b_first[lanes], a_first[lanes + 1]
    while len(a):
        x, y = a_ends[a], b_ends[b]
        same = x == y
        a_cut[a[same]] = True
        b_cut[b[same]] = True
        a = a + (x <= y)
        b = b + (y <= x)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    return a_cut, b_cut


@dataclass
class Alignment:
    """Ids of a batch of texts, the marks of the tokens that end a group, and the first token of each text."""

    a: np.ndarray
    b: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray
    a_text: np.ndarray
    b_text: np.ndarray

    @functools.cached_property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """A tokens and B tokens of each group."""
        return np.diff(np.flatnonzero(self.a_cut), prepend=-1), np.diff(np.flatnonzero(self.b_cut), prepend=-1)

    @functools.cached_property
    def groups(self) -> np.ndarray:
        """First group of each text, and behind them the number of groups."""
        return np.concatenate(([0], np.cumsum(self.a_cut)))[self.a_text]

    def digests(self, a: Tokens, b: Tokens) -> list[str]:
        """Hex digests of ``a1,a2|b1;a3|b2,b3``; empty for texts without tokens."""
        p, q = self.sizes
        group_a = np.repeat(np.arange(len(p)), p)
        group_b = np.repeat(np.arange(len(q)), q)
        a_at = np.arange(len(self.a)) + (np.cumsum(q) - q)[group_a]
        b_at = np.arange(len(self.b)) + np.cumsum(p)[group_b]
        n_a = len(a.length)
        code = np.empty(len(self.a) + len(self.b), np.int32)
        code[a_at] = self.a + n_a * self.a_cut
        code[b_at] = self.b + 2 * n_a + len(b.length) * self.b_cut
        text = pa.concat_arrays([a.decimal[0], a.decimal[1], b.decimal[0], b.decimal[2]]).take(pa.array(code))
        _, offsets, data = text.buffers()
        ends = np.frombuffer(offsets, np.int32, len(text) + 1)[self.a_text + self.b_text].tolist()
        view = memoryview(data) if data else b""
        return [hashlib.sha256(view[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:])]

    def pairs(self, each: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked pairs of each text as ``text * each + A id * wide + B id``, rising, and how many links are that pair.

        The links of large groups are counted by distinct ids, not listed.
        """
        p, q = self.sizes
        text = np.repeat(np.arange(len(self.a_text) - 1), np.diff(self.groups))
        a_first, b_first = np.cumsum(p) - p, np.cumsum(q) - q
        large = p * q > LISTED
        partners = np.repeat(np.where(large, 0, q), p)  # of each A token
        code = np.repeat(np.repeat(text, p) * each + self.a.astype(np.int64) * wide, partners)
        code += self.b[ragged(np.repeat(b_first, p), partners)]
        code.sort()
        at = np.flatnonzero(np.diff(code, prepend=-1))
        code, times = code[at], np.diff(at, append=len(code))
        if large.any():
            codes, counted = [code], [times]
            for g in np.flatnonzero(large).tolist():
                a_ids, a_n = np.unique(self.a[a_first[g] : a_first[g] + p[g]], return_counts=True)
                b_ids, b_n = np.unique(self.b[b_first[g] : b_first[g] + q[g]], return_counts=True)
                codes.append((text[g] * each + a_ids.astype(np.int64)[:, None] * wide + b_ids).ravel())
                counted.append((a_n[:, None] * b_n).ravel())
            code, place = np.unique(np.concatenate(codes), return_inverse=True)
            times = np.bincount(place, np.concatenate(counted), len(code)).astype(np.int64)
        return code, times


def align_texts(column: pa.Array, a: Tokens, b: Tokens) -> Alignment:
    """Ids and cuts of the texts of a column. A text that either tokenizer doesn't give back has no tokens, as have null and empty ones."""
    buf, starts, first, chunks = chunked(column)
    ids, ends, bounds = [], [], []
    for tokens in (a, b):
        found, size = tokens.encoder.encode(chunks)
        ids.append(found)
        ends.append(np.cumsum(tokens.length[found]))
        bounds.append(np.concatenate(([0], np.cumsum(size))))
        bytes_of = tokens.names.take(pa.array(found)).buffers()[2] if len(found) else None
        given = np.frombuffer(bytes_of, np.uint8, int(ends[-1][-1])) if bytes_of is not None else np.zeros(0, np.uint8)
        if len(given) != len(buf) or not np.array_equal(given, buf):
            at = np.concatenate(([0], ends[-1]))[bounds[-1][first]].tolist()
            asked = starts.tolist()
            back = [given[at[i] : at[i + 1]].tobytes() == buf[asked[i] : asked[i + 1]].tobytes() for i in range(len(column))]
            return align_texts(pc.if_else(pa.array(back), column, None), a, b)
    inside = np.arange(len(chunks)) - np.repeat(first[:-1], np.diff(first))
    lanes = np.append(np.flatnonzero(inside % LANE == 0), len(chunks))
    a_cut, b_cut = lockstep(ends[0], bounds[0][lanes], ends[1], bounds[1][lanes])
    return Alignment(*ids, a_cut, b_cut, bounds[0][first], bounds[1][first])


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, text) -> doc_id, a_ids, b_ids, a_ends, b_ends: ids by both tokenizers, and for each group the number of ids up to its end.

    Null and empty texts, and texts that either tokenizer doesn't give back, have empty arrays. Repeated rows and null ids stay as
    they are; further columns are not looked at.
    """
    buffers.bounded_batches(docs.sparkSession)

    def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_tokens(byte_path), piece_tokens(piece_path)
        for batch in batches:
            for piece in buffers.pieces(batch, target=PIECE):
                found = align_texts(piece.column(1), a, b)
                columns = [piece.column(0), lists(found.a, found.a_text), lists(found.b, found.b_text)]
                for cut, text in ((found.a_cut, found.a_text), (found.b_cut, found.b_text)):
                    last = np.flatnonzero(cut)
                    columns.append(lists(last + 1 - np.repeat(text[:-1], np.diff(found.groups)), found.groups))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


def _packed(values: np.ndarray) -> bytes:
    """Integers by bytes of equal weight, compressed."""
    wide = values.astype("<i4")
    return pa.compress(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()


_DOCUMENT = "n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string, n_pairs: bigint"


def _blocks(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row per block: its documents, their distinct pairs as places in the block's list of pairs, and in how many documents each pair is."""
    buffers.bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = byte_tokens(byte_path), piece_tokens(piece_path)
        block, wide = TaskContext.get().partitionId() << 32, len(b.length)
        each = len(a.length) * wide
        for batch in batches:
            for whole in buffers.pieces(batch, target=BLOCK):
                documents, codes, counted = [], [], []
                for piece in buffers.pieces(whole, target=PIECE):
                    found = align_texts(piece.column(1), a, b)
                    code, times = found.pairs(each, wide)
                    text = code // each
                    n_links = np.bincount(text, times, piece.num_rows).astype(np.int64)
                    numbers = (np.diff(found.a_text), np.diff(found.b_text), np.diff(found.groups), n_links)
                    documents.append(
                        pa.StructArray.from_arrays(
                            [piece.column(0), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(found.digests(a, b), pa.string()), pa.array(np.bincount(text, minlength=piece.num_rows).astype(np.int64))],
                            ["doc_id", *(c.split(":")[0] for c in _DOCUMENT.split(", "))],
                        )
                    )
                    codes.append(code - text * each)
                    counted.append(times.astype(np.int32))
                pairs, place, count = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block]), one(pa.concat_arrays(documents)), one(pa.array(pairs)), one(pa.array(count.astype(np.int32))),
                        pa.array([_packed(place)]), pa.array([_packed(np.concatenate(counted))]),
                    ],
                    names=["block", "documents", "pairs", "counts", "places", "times"],
                )
                block += 1

    schema = f"block bigint, documents array<struct<doc_id: {kind}, {_DOCUMENT}>>, pairs array<bigint>, counts array<int>, places binary, times binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def link_counts(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of documents (rows) of the table that hold it linked. ``n_best`` counts the links whose count is the highest of
    their A id, ties included; ``count_sum`` adds the counts of all links. Null and empty texts, and texts that either tokenizer
    doesn't give back, have zeros and an empty digest. Repeated rows and ids are documents of their own, null ids stay
    null, an empty table gives no rows; further columns are not looked at.
    """
    with_vocabulary = len(piece_tokens(piece_path).length)
    blocks = stage(_blocks(docs, byte_path, piece_path), "blocks")
    pairs = blocks.select(F.col("block").alias("home"), F.posexplode(F.arrays_zip("pairs", "counts"))).select("home", "pos", F.col("col.pairs").alias("pair"), F.col("col.counts").alias("n"))
    totals = stage(pairs.groupBy("pair").agg(F.sum("n").alias("total")), "pairs").withColumn("a", F.expr(f"pair div {with_vocabulary}"))
    best = totals.groupBy("a").agg(F.max("total").alias("most"))  # at most one row per A id of the vocabulary
    known = totals.join(F.broadcast(best), "a").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    weights = pairs.select("home", "pos", "pair").join(known, "pair").select("home", "pos", "total", "best")
    kind = docs.schema["doc_id"].dataType

    def run(block: pa.Table, weighed: pa.Table) -> pa.Table:
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        documents = block.column("documents").combine_chunks().flatten()
        n_pairs = documents.field("n_pairs").to_numpy()
        places = weighed.column("pos").to_numpy()
        total, is_best = np.zeros(len(places), np.int64), np.zeros(len(places), bool)
        total[places] = weighed.column("total").to_numpy()
        is_best[places] = weighed.column("best").to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], np.cumsum(n_pairs)))
        place, times = (_unpacked(block.column(c)[0].as_py(), int(bounds[-1])) for c in ("places", "times"))
        sums = [np.concatenate(([0], np.cumsum(x)))[bounds] for x in (np.where(is_best[place], times, 0), total[place] * times)]
        columns = [*(documents.field(n) for n in names), *(pa.array(np.diff(s).astype(np.int64)) for s in sums), documents.field("groups_sha256")]
        return pa.Table.from_arrays(columns, names=[*names, "n_best", "count_sum", "groups_sha256"])

    schema = f"doc_id {kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return blocks.select("block", "documents", "places", "times").groupBy("block").cogroup(weights.groupBy("home")).applyInArrow(run, schema)
