"""Numpy views of Arrow text columns: bytes, spans and 64-bit span hashes.

All functions work on whole arrays; ``pieces`` bounds how much text one call sees, so the
memory of a task does not depend on the size of its Arrow batches (a single text is never cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def bounded_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 8) -> None:
    """Let Arrow batches of the session end at so many rows or bytes, whichever comes first."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if offsets else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return buf, bounds - bounds[0]


def pieces(batch: pa.RecordBatch, text: str = "text", target: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``target`` bytes of text each, one text at least."""
    if not batch.num_rows:
        return
    _, bounds = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + target, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2^64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > 4 << 20:  # one very long text: not kept
            return cls._make(n, _MULTIPLIER), cls._make(n, _INVERSE)
        if len(cls.up) < n:
            size = max(n, 1 << 18)
            cls.up, cls.down = cls._make(size, _MULTIPLIER), cls._make(size, _INVERSE)
        return cls.up, cls.down

    @staticmethod
    def _make(n: int, base: np.uint64) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_BYTE_CODES = np.random.Generator(np.random.PCG64(20260101)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def code_sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of ``codes[i] * m^i``, from which any span's hash follows."""
    up, _ = _Powers.get(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], dtype=np.uint64, out=out[1:])
    return out


def byte_sums(buf: np.ndarray) -> np.ndarray:
    return code_sums(_BYTE_CODES[buf])


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: equal spans hash alike wherever they stand."""
    _, down = _Powers.get(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.uint8), [0])).astype(np.int8)))
    return edges[::2], edges[1::2]


_WORD = np.zeros(256, bool)
_WORD[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, first word of each text) of the words of all texts.

    A word is a maximal run of ``[0-9a-z]`` and characters beyond ASCII, after lower-casing A-Z.
    """
    lower = _LOWER[buf]
    mask = _WORD[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[bounds] = True
    before = np.concatenate(([False], mask[:-1]))
    after = np.concatenate((mask[1:], [False])) if len(mask) else mask
    starts = np.flatnonzero(mask & (~before | cut[:-1]))
    ends = np.flatnonzero(mask & (~after | cut[1:])) + 1
    return lower, starts, ends, np.searchsorted(starts, bounds)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
