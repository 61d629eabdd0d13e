"""Removal of repeated byte strings by longest-previous-factor arrays over suffix order.

Every byte that a string of ``span`` bytes covers goes, if the string also starts in a document with a smaller
doc_id. Such strings (windows) are found without comparing documents:

1. Anchors. Each window picks the gram of ``GRAM`` bytes in it with the smallest hash. Equal windows pick equal
   grams, so only strings around equal anchors need a look. Consecutive windows of a document with the
   same anchor form one segment; there is about one in 16 bytes.
2. Equal segments. Of all segments with the same bytes around the same anchor the earliest document
   keeps its own, and in later ones every window of it is repeated. One string of each kind goes on.
3. Sides. A window has at least ``HALF`` bytes before its anchor, or else more than that behind it, so equal windows
   are in strings that agree in the anchor and ``HALF`` bytes on that side of it. Of strings that
   share only an anchor, a side goes on if a string of another document agrees there; most have none.
4. Suffix order. The suffixes of all sides that go on are sorted, as far as
   ``span`` bytes count and then by document. The previous and next smaller positions in that order give the earlier
   match of each suffix: the previous one, as long as it shares ``span`` bytes, and never the next, since
   equals are in document order. A window whose earlier match is that long is repeated.

An anchor with many different strings around it (a very common line) is not gathered in one place: from then on
its windows travel one by one, to places picked by their own hash, and each piece of the corpus sends
a distinct window once.

Documents are staged in pieces of about two megabytes, as a table bucketed by piece, so the text itself is
never shuffled: what travels between anchors and pieces are packed arrays, one row for a piece and bucket. A
piece finds its strings in the same order each time, so it is answered by one byte for each that it sent.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparcel.llm import buffers
from sparcel.session import stage, staged_path

SPAN, GRAM, CROWD = 50, 18, 32
HALF = (SPAN - GRAM) // 2
#: What a piece is told of a string: an earlier document has it; the windows left, right of its anchor go into suffix order; all windows go one by one.
FULL, LEFT, RIGHT, WIDE = 1, 2, 4, 8
PIECE = 2 << 20
_BLOCK = 1 << 19
_SORTED = 300_000
_PLACE = np.uint64(0xFFFFFF)
_LAST = np.iinfo(np.int64).max


def segments(buf: np.ndarray, bounds: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, string hash, left hash, right hash, first window, first one of the right side, last window) of each segment of the texts in ``buf``.

    The left side are the windows with half of their other bytes or more before the anchor; a side without windows has hash 0.
    Long inputs are taken in blocks, which may split a segment in two.
    """
    half = (span - gram) // 2
    found = [(*[np.zeros(0, np.uint64)] * 4, *[np.zeros(0, np.int64)] * 3)]
    for at in range(0, max(len(buf) - span + 1, 0), _BLOCK):
        part = buf[at : at + _BLOCK + span - 1]
        sums = buffers.byte_sums(part)
        place = np.arange(len(part) - gram + 1)
        hashes = buffers.span_hash(sums, place, place + gram)
        # the leftmost of equal grams: the place breaks ties of the upper 40 bits
        least = buffers.sliding_min((hashes & ~_PLACE) | place.astype(np.uint64), span - gram + 1)
        place = place[: len(least)]
        ok = np.zeros(len(least), bool)
        for a, b in zip(np.maximum(bounds[:-1] - at, 0).tolist(), (bounds[1:] - at - span + 1).tolist()):
            ok[a : max(b, 0)] = True
        anchor = (least & _PLACE).astype(np.int64)
        change = np.ones(len(least) + 1, bool)
        change[1:-1] = (anchor[1:] != anchor[:-1]) | ~ok[:-1] | ~ok[1:]
        for a in (bounds - at).tolist():
            if 0 <= a < len(least):
                change[a] = True
        cuts = np.flatnonzero(change)
        start, stop = cuts[:-1], cuts[1:]
        mine = ok[start]
        start, stop = start[mine], stop[mine] - 1
        place = anchor[start]
        string = buffers.mix(buffers.span_hash(sums, start, stop + span) ^ (place - start).astype(np.uint64)) | np.uint64(1)
        middle = np.clip(place - half + 1, start, stop + 1)
        left, right = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
        some = np.flatnonzero(middle > start)
        left[some] = buffers.span_hash(sums, place[some] - half, place[some] + gram)
        some = np.flatnonzero(middle <= stop)
        right[some] = buffers.span_hash(sums, place[some], place[some] + span - half + 1)
        found.append((hashes[place], string, left, right, start + at, middle + at, stop + at))
    return tuple(np.concatenate(x) for x in zip(*found))


def smallest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, smallest value of each, place of each key among them)."""
    distinct, which = np.unique(keys, return_inverse=True)
    least = np.full(len(distinct), _LAST)
    np.minimum.at(least, which, values)
    return distinct, least, which


def is_in(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, place) of each key in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


class Piece:
    """Segments of one piece of the corpus, and the smallest doc_id of each string in it."""

    def __init__(self, row: dict[str, pa.Scalar]) -> None:
        docs, texts = row["doc_ids"].values, row["texts"].values
        self.doc_ids = docs
        self.docs = docs.fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.buf, self.bounds = buffers.text_bytes(texts)
        self.hash, self.string, self.left, self.right, self.lo, self.middle, self.hi = segments(self.buf, self.bounds)
        self.doc = self.docs[np.searchsorted(self.bounds, self.lo, "right") - 1]
        # of each string its smallest doc_id and first segment, and the string of each segment
        distinct, self.first, self.which = smallest(self.string, self.doc)
        self.at = np.zeros(len(distinct), np.int64)
        self.at[self.which[::-1]] = np.arange(len(self.which))[::-1]

    def entries(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, segment, crowded) of each entry in the order of sending, and the entry of each segment.

        Each string is an entry. All strings of a crowded anchor are one.
        """
        hashes = self.hash[self.at]
        ranked = np.sort(hashes)
        crowded, of = is_in(hashes, np.unique(ranked[CROWD:][ranked[CROWD:] == ranked[:-CROWD]]))
        head = np.full(of.max(initial=0) + 1, _LAST)
        np.minimum.at(head, of[crowded], self.at[crowded])
        own = np.where(crowded, head[of], self.at)
        entry = np.zeros(len(self.lo), np.int64)
        entry[own] = 1
        segment = np.flatnonzero(entry)
        bucket = ((self.hash[segment] >> np.uint64(40)) % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
        order = np.argsort(bucket, kind="stable")
        bucket, segment = bucket[order], segment[order]
        entry[segment] = np.arange(len(segment))
        return bucket, segment, crowded[self.which[segment]], entry[own][self.which]

    def told(self, answers: list[dict], buckets: int) -> np.ndarray:
        """What the piece was told of the string of each segment; ``answers``: bucket, codes of its entries."""
        bucket, _, _, entry = self.entries(buckets)
        codes = np.zeros(len(bucket), np.uint8)
        for at, x in zip(np.searchsorted(bucket, np.array([x["bucket"] for x in answers], bucket.dtype)).tolist(), answers):
            codes[at : at + len(x["codes"])] = np.frombuffer(x["codes"], np.uint8)
        return codes[entry]

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, start, hash) of every window of the segments ``which``."""
        n = self.hi[which] - self.lo[which] + 1
        segment = np.repeat(which, n)
        start = np.repeat(self.lo[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        hashes = np.zeros(len(start), np.uint64)
        block = start // _BLOCK
        for number in np.unique(block).tolist():
            mine, at = block == number, number * _BLOCK
            sums = buffers.byte_sums(self.buf[at : at + _BLOCK + SPAN])
            hashes[mine] = buffers.span_hash(sums, start[mine] - at, start[mine] - at + SPAN)
        return segment, start, hashes


def _by_bucket(bucket: np.ndarray, encode) -> Iterator[tuple[int, bytes]]:
    """(bucket, encoded rows) for each bucket; ``encode`` gets the places of its rows."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(bucket[rows[0]]), encode(rows)


def _pack_anchors(key: np.ndarray, string: np.ndarray, doc: np.ndarray) -> bytes:
    step = np.diff(doc)  # may wrap around, and back when added up
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if not len(step) or np.iinfo(k).min <= step.min() and step.max() <= np.iinfo(k).max)
    return b"".join((int(doc[0]).to_bytes(8, "little", signed=True), bytes([int(kind[2])]), key.astype("<u8").tobytes(), string.astype("<u8").tobytes(), step.astype(kind).tobytes()))


def _unpack_anchors(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = packed[8]
    n = (len(packed) - 9 + size) // (16 + size)
    doc = np.full(n, int.from_bytes(packed[:8], "little", signed=True), np.int64)
    doc[1:] += np.cumsum(np.frombuffer(packed, f"<i{size}", n - 1, 9 + 16 * n), dtype=np.int64)
    return np.frombuffer(packed, "<u8", n, 9), np.frombuffer(packed, "<u8", n, 9 + 8 * n), doc


def _anchor_rows(piece: Piece, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Each string of the piece once, with its earliest document; one marker (string 0) for a crowded anchor.

    Its key has 32 bits of the anchor (beyond those that pick the bucket) and 16 of each side, 0 if that has no windows.
    """
    bucket, at, crowded, _ = piece.entries(buckets)
    sides = [np.where(crowded | (x == 0), np.uint64(0), np.maximum(x & np.uint64(0xFFFF), np.uint64(1))) for x in (piece.left[at], piece.right[at])]
    key = piece.hash[at] << np.uint64(32) | sides[0] << np.uint64(16) | sides[1]
    string, first = np.where(crowded, np.uint64(0), piece.string[at]), piece.first[piece.which[at]]
    yield from _by_bucket(bucket, lambda rows: _pack_anchors(key[rows], string[rows], first[rows]))


def _meet(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the key has rows of several documents."""
    _, least, which = smallest(key, doc)
    several = np.zeros(len(least), bool)
    several[which[doc > least[which]]] = True
    return several[which]


def match_anchors(table: pa.Table) -> pa.Table:
    """One bucket's (bucket, piece, packed) -> (piece, bucket, codes): what each piece has to do with each string it sent.

    ``FULL``: an earlier document has the string; ``LEFT``, ``RIGHT``: no earlier one has it, but a different string of another document
    agrees on that side; ``WIDE``: the windows of the anchor go one by one.
    """
    parts = [_unpack_anchors(x) for x in table.column("packed").to_pylist()]
    ends = np.cumsum([len(p[0]) for p in parts])
    key, string, doc = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((doc, string, key))
    key, string, doc = key[order], string[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (string[1:] != string[:-1])
    which, new = np.cumsum(new) - 1, np.flatnonzero(new)
    key, string, first = key[new], string[new], doc[new]
    anchor = key >> np.uint64(32)
    group = np.cumsum(np.concatenate(([True], anchor[1:] != anchor[:-1]))) - 1
    crowd = (np.bincount(group, string == 0) > 0)[group]
    goes = np.zeros(len(key), np.uint8)
    several = (np.bincount(group) > 1)[group] & ~crowd
    for code, shift in ((LEFT, 16), (RIGHT, 0)):
        side = key >> np.uint64(shift) & np.uint64(0xFFFF)
        some = np.flatnonzero(several & (side > 0))
        goes[some[_meet(group[some].astype(np.uint64) << np.uint64(16) | side[some], first[some])]] |= code
    codes = np.zeros(len(order), np.uint8)
    codes[order] = np.where(crowd[which], WIDE, np.where(doc > first[which], FULL, goes[which])).astype(np.uint8)
    codes = [x.tobytes() if x.any() else None for x in np.split(codes, ends[:-1])]
    return pa.table({"piece": table.column("piece"), "bucket": table.column("bucket"), "codes": pa.array(codes, pa.binary())}).filter(pa.array([x is not None for x in codes]))


def _suffix_rows(piece: Piece, told: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Strings that go into suffix order: (key, document, length, bytes), a side each; windows on their own for wide anchors."""
    first, at = piece.first, piece.at
    left, right = np.flatnonzero(told[at] & LEFT), np.flatnonzero(told[at] & RIGHT)
    segment, start, hashes = piece.windows(np.flatnonzero(told & WIDE))
    window, w_first, which = smallest(hashes, piece.doc[segment])
    w_at = np.zeros(len(window), np.int64)
    w_at[which] = start
    keys = np.concatenate((piece.string[at[left]], _right_key(piece.string[at[right]]), window))
    docs = np.concatenate((first[left], first[right], w_first))
    place = np.concatenate((piece.left[at[left]], piece.right[at[right]], window))
    left, right = at[left], at[right]
    lo = np.concatenate((piece.lo[left], piece.middle[right], w_at))
    length = np.concatenate((piece.middle[left] - piece.lo[left] + SPAN - 1, piece.hi[right] - piece.middle[right] + SPAN, np.full(len(window), SPAN)))
    bucket = ((place >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)

    def encode(rows: np.ndarray) -> bytes:
        n = length[rows]
        places = np.repeat(lo[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return b"".join((len(rows).to_bytes(4, "little"), keys[rows].astype("<u8").tobytes(), docs[rows].astype("<i8").tobytes(), n.astype("<u1").tobytes(), piece.buf[places].tobytes()))

    yield from _by_bucket(bucket, encode)


def _right_key(string: np.ndarray) -> np.ndarray:
    """Key of a string's right side; that of its left side is the odd hash of the string."""
    return string ^ np.uint64(1)


def earlier_matches(data: np.ndarray, starts: np.ndarray, docs: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Whether the suffix at each start shares ``span`` bytes with one of a smaller document."""
    if not len(starts):
        return np.zeros(0, bool)
    wide = -(-span // 8) * 8
    rows = np.zeros((len(starts), wide), np.uint8)
    rows[:, :span] = data[starts[:, None] + np.arange(span)]
    keys = rows.view(">u8").astype(np.uint64)
    order = np.lexsort((docs, *keys.T[::-1]))
    keys, docs = keys[order], docs[order]
    same = np.zeros(len(order), bool)
    same[1:] = (keys[1:] == keys[:-1]).all(1)
    # the previous smaller position lies before the place where its run of equal documents begins
    run = np.flatnonzero(~same)
    longest = docs > docs[run][np.cumsum(~same) - 1]
    out = np.zeros(len(order), bool)
    out[order] = longest
    return out


def match_suffixes(table: pa.Table) -> pa.Table:
    """One bucket's (piece, packed) -> (piece, masks): of each key the windows that are repeated, as bits."""
    keys, docs, lengths, data, source = [], [], [], [], []
    for i, x in enumerate(table.column("packed").to_pylist()):
        n = int.from_bytes(x[:4], "little")
        keys.append(np.frombuffer(x, "<u8", n, 4))
        docs.append(np.frombuffer(x, "<i8", n, 4 + 8 * n))
        lengths.append(np.frombuffer(x, "<u1", n, 4 + 16 * n).astype(np.int64))
        data.append(np.frombuffer(x, np.uint8, offset=4 + 17 * n))
        source.append(np.full(n, i))
    keys, docs, lengths, data, source = map(np.concatenate, (keys, docs, lengths, data, source))
    windows = lengths - SPAN + 1
    owner = np.repeat(np.arange(len(keys)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = (np.cumsum(lengths) - lengths)[owner] + offset
    # suffixes with different beginnings never match, so they may be sorted a part at a time
    head = np.zeros(len(starts), np.uint64)
    for i in range(8):
        head = head << np.uint64(8) | data[starts + i]
    parts = max(-(-len(starts) // _SORTED), 1)
    head = (buffers.mix(head) % np.uint64(parts)).astype(np.int32)
    hit = np.zeros(len(starts), bool)
    for part in range(parts):
        mine = np.flatnonzero(head == part)
        hit[mine] = earlier_matches(data, starts[mine], docs[owner[mine]])
    masks = np.zeros(len(keys), np.uint64)
    np.bitwise_or.at(masks, owner[hit], np.uint64(1) << offset[hit].astype(np.uint64))
    pieces = table.column("piece").to_pylist()
    out_pieces, packed = [], []
    for i in np.unique(source[masks != 0]).tolist():
        rows = np.flatnonzero((source == i) & (masks != 0))
        out_pieces.append(pieces[i])
        packed.append(np.column_stack((keys[rows], masks[rows])).astype("<u8").tobytes())
    return pa.table({"piece": pa.array(out_pieces, pa.int64()), "masks": pa.array(packed, pa.binary())})


def repeated_bytes(piece: Piece, told: np.ndarray, keys: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether each byte of the piece is covered by a repeated window."""
    alone = told & WIDE > 0
    later = ~alone & ((told & FULL > 0) | (piece.doc > piece.first[piece.which]))
    gone = np.zeros(len(piece.buf) + 1, np.int32)
    np.add.at(gone, piece.lo[later], 1)
    np.add.at(gone, piece.hi[later] + SPAN, -1)
    starts = []
    for code, key, lo, end in ((LEFT, piece.string, piece.lo, piece.middle), (RIGHT, _right_key(piece.string), piece.middle, piece.hi + 1)):
        some = np.flatnonzero((told & code > 0) & ~later)
        found, at = is_in(key[some], keys)
        some, at = some[found], at[found]
        n = end[some] - lo[some]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = (np.repeat(masks[at] if len(some) else np.zeros(0, np.uint64), n) >> offset.astype(np.uint64)) & np.uint64(1) == 1
        starts.append((np.repeat(lo[some], n) + offset)[hit])
    segment, start, hashes = piece.windows(np.flatnonzero(alone))
    _, w_first, which = smallest(hashes, piece.doc[segment])
    starts.append(start[(piece.doc[segment] > w_first[which]) | is_in(hashes, keys)[0]])
    starts = np.concatenate(starts)
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + SPAN, -1)
    return np.cumsum(gone[:-1]) > 0


def _in_pieces(docs: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """``docs`` as rows (piece, doc_ids, texts) of a table bucketed by piece, and the table's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in buffers.pieces(batch, target=PIECE):
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.ListArray.from_arrays(ends, pa.concat_arrays([part.column(0)])), pa.ListArray.from_arrays(ends, pa.concat_arrays([part.column(1)]))],
                    names=["piece", "doc_ids", "texts"],
                )
                number += 1

    spark = docs.sparkSession
    name = f"pieces_{uuid.uuid4().hex}"
    made = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "piece bigint, doc_ids array<bigint>, texts array<string>")
    made.write.bucketBy(buckets, "piece").option("compression", "zstd").option("path", staged_path(spark, "pieces")).saveAsTable(name)
    return spark.table(name), name


def _each_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Piece, dict[str, pa.Scalar]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
            yield row["piece"].as_py(), Piece(row), row


def _list(scalar: pa.Scalar) -> list:
    return scalar.as_py() or []


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, spans (start, end) of removed bytes, kept (binary).

    Texts are UTF-8 bytes, null counts as empty; texts shorter than ``SPAN`` keep all. Strings are judged
    on the input, matches never cross documents, and of strings that start in several documents those of the
    smallest doc_id stay. Rows that repeat a doc_id don't remove from one another; a null doc_id is larger
    than any other. No rows in, no rows out. Further columns are not looked at.
    """
    spark = docs.sparkSession
    buffers.bounded_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces, name = _in_pieces(docs, buckets)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece, _ in _each_piece(batches):
            rows = list(_anchor_rows(piece, buckets))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int32()), "piece": pa.array([number] * len(rows), pa.int64()), "packed": pa.array([x for _, x in rows], pa.binary())})

    sent = pieces.mapInArrow(anchors, "bucket int, piece bigint, packed binary")
    told = sent.groupBy("bucket").applyInArrow(match_anchors, "piece bigint, bucket int, codes binary")
    answers = stage(told.groupBy("piece").agg(F.collect_list(F.struct("bucket", "codes")).alias("told")), "anchor-answers")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece, row in _each_piece(batches):
            rows = list(_suffix_rows(piece, piece.told(_list(row["told"]), buckets), buckets))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int32()), "piece": pa.array([number] * len(rows), pa.int64()), "packed": pa.array([x for _, x in rows], pa.binary())})

    sorted_in = pieces.join(answers, "piece").mapInArrow(strings, "bucket int, piece bigint, packed binary")
    repeated = sorted_in.groupBy("bucket").applyInArrow(match_suffixes, "piece bigint, masks binary")
    masks = stage(repeated.groupBy("piece").agg(F.collect_list("masks").alias("masks")), "suffix-answers")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, piece, row in _each_piece(batches):
            pairs = np.frombuffer(b"".join(_list(row["masks"])), "<u8").reshape(-1, 2)
            keys, which = np.unique(pairs[:, 0], return_inverse=True)
            bits = np.zeros(len(keys), np.uint64)
            np.bitwise_or.at(bits, which, pairs[:, 1])
            gone = repeated_bytes(piece, piece.told(_list(row["told"]), buckets), keys, bits)
            spans, kept = [], []
            for a, b in zip(piece.bounds[:-1], piece.bounds[1:]):
                starts, ends = buffers.runs(gone[a:b])
                spans.append([{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist())])
                kept.append(piece.buf[a:b][~gone[a:b]].tobytes())
            struct = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays([piece.doc_ids, pa.array(np.diff(piece.bounds)), pa.array(spans, pa.list_(struct)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    known = answers.join(masks, "piece", "left")
    out = pieces.join(known, "piece", "left").mapInArrow(cut, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    spark.sql(f"DROP TABLE {name}")  # its name only: the files stay, and the plan knows them
    return out
