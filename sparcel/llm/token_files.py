"""Token ids in Simple-8b files: 64-bit words whose upper 4 bits select how many ids the other 60 hold.

A file (all numbers little-endian): the 8 bytes ``S8BTOK01``; blocks of words; the index; the
length of the index as an unsigned 64-bit number. The index is an Arrow IPC stream of three tables:
``blocks`` (first: the block's first word, words, ids), ``documents`` (doc_id, n) in file order, and one
row with the number of ids. A block holds up to 65,536 ids, never half a word, so blocks can be decoded apart and
each by a few array operations. Selector 0 is the escape: the next word is one id as it is, which
serves ids of more than 60 bits. The last word of a block may hold fewer ids than its selector says.

Files go to the shared folder under names that no other attempt uses; only the files that a
finished task returned are listed, so a task that ran twice or was lost leaves no trace in the result.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparcel.llm import buffers
from sparcel.llm.chunks import byte_encoder, chunked
from sparcel.session import stage, staged_path
from sparcel.sources.files import filesystem, qualified

MAGIC = b"S8BTOK01"
BLOCK = 1 << 16

#: Selector -> (ids in a word, bits of each): the published table without its two runs of zeros; 0 is the escape.
SELECTORS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}


def pack(ids: np.ndarray) -> np.ndarray:
    """Words of one block of ids (unsigned 64-bit)."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    # most ids first: the first selector that fits from a place on is the one to take
    choice = np.zeros(n, np.int8)
    narrow = ids.astype(np.uint32) if ids.max() >> np.uint64(32) == 0 else ids
    for selector, (count, bits) in SELECTORS.items():
        if bits >= 8 * narrow.itemsize:
            small = at
        else:
            small = np.flatnonzero(narrow < narrow.dtype.type(1 << bits))
        if not len(small):
            continue
        # how far the run of small ids goes on from each of them
        breaks = np.flatnonzero(np.diff(small) > 1)
        end = np.repeat(small[np.append(breaks, len(small) - 1)] + 1, np.diff(np.concatenate(([-1], breaks, [len(small) - 1]))))
        fits = small[(end - small >= count) | (end == n)]
        choice[fits[choice[fits] == 0]] = selector
    step = np.array([1] + [count for count, _ in SELECTORS.values()])[choice].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts)
    chosen = choice[starts]
    place = np.cumsum(np.where(chosen == 0, 2, 1)) - 1  # of each word; an escape's value stands there
    words = np.zeros(int(place[-1]) + 1, np.uint64)
    for selector, (count, bits) in SELECTORS.items():
        mine = chosen == selector
        if mine.any():
            take = starts[mine][:, None] + np.arange(count)
            values = np.where(take < n, ids[np.minimum(take, n - 1)], np.uint64(0)) << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            words[place[mine]] = np.bitwise_or.reduce(values, axis=1) | np.uint64(selector << 60)
    words[place[chosen == 0]] = ids[starts[chosen == 0]]
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    selector = (words >> np.uint64(60)).astype(np.int8)
    raw = np.zeros(len(words), bool)
    if (selector == 0).any():  # a word after an escape is a value, also where it looks like an escape
        for i in np.flatnonzero(selector == 0).tolist():
            if not raw[i]:
                raw[i + 1] = True
    head = ~raw
    count = np.array([1] + [c for c, _ in SELECTORS.values()])[selector]
    sizes = np.where(head, count, 0)
    first = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    for s, (c, bits) in SELECTORS.items():
        mine = head & (selector == s)
        if mine.any():
            values = (words[mine][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
            out[first[mine][:, None] + np.arange(c)] = values
    escapes = np.flatnonzero(head & (selector == 0))
    out[first[escapes]] = words[escapes + 1]
    return out[:n]


class TokenWriter:
    """Writes one file document by document; keeps one block of ids and the index in memory."""

    def __init__(self, sink) -> None:
        self.sink, self.parts, self.held = sink, [], 0
        self.blocks: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.words = self.total = 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.parts).astype(np.uint64) if self.parts else np.zeros(0, np.uint64)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            block = ids[at : min(at + BLOCK, whole)]
            words = pack(block)
            self.sink.write(words.astype("<u8").tobytes())
            self.blocks.append((self.words, len(words), len(block)))
            self.words += len(words)
            self.total += len(block)
        self.parts, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        index = io.BytesIO()
        first, words, ids = zip(*self.blocks) if self.blocks else ((), (), ())
        tables = (
            pa.table({"first": pa.array(first, pa.int64()), "words": pa.array(words, pa.int64()), "ids": pa.array(ids, pa.int64())}),
            pa.table({"doc_id": pa.array(self.doc_ids, pa.int64()), "n": pa.array(self.counts, pa.int64())}),
        )
        for table in tables:
            with pa.ipc.new_stream(index, table.schema) as writer:
                writer.write_table(table)
        self.sink.write(index.getvalue())
        self.sink.write(np.array([len(index.getvalue())], "<u8").tobytes())


def read_tokens(source) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    """(doc_id, pieces of its ids) of every document of an open file, a block in memory at a time."""
    size = source.size()
    source.seek(size - 8)
    length = int(np.frombuffer(source.read(8), "<u8")[0])
    source.seek(size - 8 - length)
    index = io.BytesIO(source.read(length))
    blocks, documents = (pa.ipc.open_stream(index).read_all() for _ in range(2))

    def values() -> Iterator[np.ndarray]:
        for first, words, ids in zip(*(blocks.column(c).to_pylist() for c in ("first", "words", "ids"))):
            source.seek(len(MAGIC) + 8 * first)
            yield unpack(np.frombuffer(source.read(8 * words), "<u8"), ids)

    stream, held = values(), np.zeros(0, np.uint64)
    for doc_id, n in zip(documents.column("doc_id").to_pylist(), documents.column("n").to_pylist()):
        pieces = []
        while n > len(held):
            pieces.append(held)
            n -= len(held)
            held = next(stream)
        pieces.append(held[:n])
        held = held[n:]
        yield doc_id, pieces


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, files: int | None = None) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending order of doc_id; one row per file: path, part, first_id, n_ids, n_docs.

    Each document ends with ``end_id``; null and empty texts are that id alone. Null doc_ids come first,
    equal ones stand side by side in the order of their texts. An empty table gives no files. Further columns are
    not looked at. ``folder`` (a fresh one in the shared folder unless given) must be reachable by all executors.
    """
    spark = docs.sparkSession
    buffers.bounded_batches(spark)
    folder = qualified(spark, folder or staged_path(spark, "tokens"))
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = sink = None
        encoder = byte_encoder(tokenizer, plain=False)
        for batch in batches:
            for piece in buffers.pieces(batch):
                if writer is None:
                    part, name = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}.s8b"
                    system, inner = filesystem(name)
                    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    sink = system.open_output_stream(inner)
                    writer = TokenWriter(sink)
                _, _, first_chunk, chunks = chunked(piece.column(1), lead=False)
                ids, size = encoder.encode(chunks)
                bounds = np.concatenate(([0], np.cumsum(size)))[first_chunk]
                ids = np.insert(ids, bounds[1:], end_id).astype(np.uint64)
                bounds = (bounds + np.arange(len(bounds))).tolist()
                for doc_id, a, b in zip(piece.column(0).to_pylist(), bounds, bounds[1:]):
                    writer.add(doc_id, ids[a:b])
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "part": pa.array([part], pa.int32()), "n_ids": [writer.total], "n_docs": [len(writer.counts)]})

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    written = stage(ordered.mapInArrow(run, "path string, part int, n_ids bigint, n_docs bigint"), "token-files")
    # one row a file: their number does not depend on the data
    first, listed = 0, []
    for row in sorted(written.collect(), key=lambda r: r.part):
        listed.append((row.path, row.part, first, row.n_ids, row.n_docs))
        first += row.n_ids
    return spark.createDataFrame(listed, "path string, part int, first_id bigint, n_ids bigint, n_docs bigint")


def token_documents(files: DataFrame) -> DataFrame:
    """Read the files listed by ``write_tokens``: doc_id, start, n_tokens, ids_crc32, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inner = filesystem(path)
                rows: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                with system.open_input_file(inner) as source:
                    for doc_id, pieces in read_tokens(source):
                        n = crc = 0
                        for ids in pieces:
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                            n += len(ids)
                        for column, value in zip(rows.values(), (doc_id, start, n, crc)):
                            column.append(value)
                        start += n
                        if len(rows["doc_id"]) == 50_000:
                            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})
                            rows = {k: [] for k in rows}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})

    spread = files.select("path", "first_id").repartition(max(files.count(), 1), "path")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
