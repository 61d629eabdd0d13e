"""Bytes of voxel files: compression, octree streams and attribute filters, on numpy arrays."""

from __future__ import annotations

import json
import lzma
import struct
import zlib

import numpy as np

from sparcel.operators.octree import chain_sums, reference_rows

# fixed values: the container's marks and its codecs with their default levels
MAGIC = b"VXZ"
VERSION = 0
LEVELS = {"none": 0, "deflate": 9, "lzma": 9, "zstd": 22}
FILTERS = ("none", "parent", "neighbor")
INTERLEAVES = ("none", "as_is", "all")


def _lzma_filters(level: int, **extra) -> list[dict]:
    return [{"id": lzma.FILTER_LZMA2, "preset": level, **extra}]


def _zstandard():
    try:
        import zstandard
    except ImportError as e:
        raise ValueError("the zstd codec needs the zstandard package") from e
    return zstandard


def squeeze(data: bytes, codec: str, level: int) -> bytes:
    if codec == "deflate":
        packer = zlib.compressobj(level, wbits=-15)
        return packer.compress(data) + packer.flush()
    if codec == "lzma":
        # a dictionary no longer than the data: same streams for readers, without the preset's 64 MiB per stream
        window = max(4096, min(1 << max(len(data) - 1, 1).bit_length(), 64 << 20))
        return lzma.compress(data, format=lzma.FORMAT_RAW, filters=_lzma_filters(level, dict_size=window))
    if codec == "zstd":
        return _zstandard().ZstdCompressor(level=level, write_content_size=True).compress(data)
    if codec == "none":
        return data
    raise ValueError(f"unknown codec {codec}")


def expand(data: bytes, codec: str, level: int) -> bytes:
    if codec == "deflate":
        return zlib.decompress(data, wbits=-15)
    if codec == "lzma":
        return lzma.decompress(data, format=lzma.FORMAT_RAW, filters=_lzma_filters(level))
    if codec == "zstd":
        return _zstandard().ZstdDecompressor().decompress(data)
    if codec == "none":
        return data
    raise ValueError(f"unknown codec {codec}")


def morton(local: np.ndarray, depth: int) -> np.ndarray:
    code = np.zeros(len(local), dtype=np.int64)
    for bit in range(depth):
        for axis in range(3):
            code |= ((local[:, axis] >> bit) & 1) << (3 * bit + 2 - axis)
    return code


def unmorton(code: np.ndarray, depth: int) -> np.ndarray:
    local = np.zeros((len(code), 3), dtype=np.int64)
    for bit in range(depth):
        for axis in range(3):
            local[:, axis] |= ((code >> (3 * bit + 2 - axis)) & 1) << bit
    return local


class Octree:
    """Internal nodes of sorted unique codes in depth-first order: level, prefix, child bitmap."""

    def __init__(self, level: np.ndarray, prefix: np.ndarray, children: np.ndarray, depth: int):
        self.level, self.prefix, self.children, self.depth = level, prefix, children, depth

    @classmethod
    def of_codes(cls, codes: np.ndarray, depth: int) -> Octree:
        parts = []
        for level in range(depth):
            prefix, first = np.unique(codes >> (3 * (depth - level)), return_index=True)
            bit = np.left_shift(1, (codes >> (3 * (depth - level - 1))) & 7)
            parts.append((np.full(len(prefix), level), prefix, np.bitwise_or.reduceat(bit, first)))
        level, prefix, children = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((level, prefix << (3 * (depth - level))))
        return cls(level[order], prefix[order], children[order], depth)

    @classmethod
    def of_bytes(cls, stream: bytes, depth: int) -> Octree:
        level, prefix, waiting = [], [], [(0, 0)]
        for bits in stream:
            at, where = waiting.pop()
            level.append(at)
            prefix.append(where)
            if at < depth - 1:
                waiting.extend((at + 1, where * 8 + c) for c in range(7, -1, -1) if bits >> c & 1)
        children = np.frombuffer(stream, dtype=np.uint8).astype(np.int64)
        return cls(np.array(level), np.array(prefix, dtype=np.int64), children, depth)

    def to_bytes(self) -> bytes:
        return self.children.astype(np.uint8).tobytes()

    def offspring(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Children of the nodes at ``level``: node row, rank among siblings, prefix."""
        rows = np.flatnonzero(self.level == level)
        node, child = np.nonzero((self.children[rows, None] >> np.arange(8)) & 1)
        first = np.r_[0, np.flatnonzero(np.diff(node)) + 1]
        rank = np.arange(len(node)) - np.repeat(first, np.diff(np.r_[first, len(node)]))
        return rows[node], rank, self.prefix[rows[node]] * 8 + child

    def codes(self) -> np.ndarray:
        return self.offspring(self.depth - 1)[2]

    def slots(self) -> np.ndarray:
        """First slot of each node's stored differences; slot 0 is the root's own."""
        spare = np.bitwise_count(self.children.astype(np.uint8)).astype(np.int64) - 1
        return 1 + np.cumsum(spare) - spare

    def encode_parent(self, codes: np.ndarray, attrs: np.ndarray) -> np.ndarray:
        out = np.zeros_like(attrs)
        out[0] = attrs[0]
        slots = self.slots()
        for level in range(self.depth):
            node, rank, prefix = self.offspring(level)
            first = np.searchsorted(codes, prefix << (3 * (self.depth - level - 1)))
            later = np.flatnonzero(rank > 0)
            out[slots[node[later]] + rank[later] - 1] = attrs[first[later]] - attrs[first[later - 1]]
        return out

    def decode_parent(self, stored: np.ndarray) -> np.ndarray:
        slots = self.slots()
        values = np.zeros((len(self.level), stored.shape[1]), dtype=np.int64)
        values[0] = stored[0]
        for level in range(self.depth):
            node, rank, _ = self.offspring(level)
            step = np.where((rank > 0)[:, None], stored[np.where(rank > 0, slots[node] + rank - 1, 0)], 0).astype(np.int64)
            total = np.cumsum(step, axis=0)
            before = np.maximum.accumulate(np.where(rank == 0, np.arange(len(rank)), 0))
            child = values[node] + total - total[before]
            if level == self.depth - 1:
                return (child & 255).astype(np.uint8)
            values[self.level == level + 1] = child
        raise ValueError("an octree has at least one level")


def filter_attrs(how: str, tree: Octree, codes: np.ndarray, attrs: np.ndarray, edge: int) -> np.ndarray:
    if how == "parent":
        return tree.encode_parent(codes, attrs)
    if how == "neighbor":
        reference = reference_rows(unmorton(codes, tree.depth), edge)
        return attrs - np.where((reference >= 0)[:, None], attrs[np.maximum(reference, 0)], 0).astype(np.uint8)
    return attrs


def unfilter_attrs(how: str, tree: Octree, codes: np.ndarray, stored: np.ndarray, edge: int) -> np.ndarray:
    if how == "parent":
        return tree.decode_parent(stored)
    if how == "neighbor":
        return chain_sums(reference_rows(unmorton(codes, tree.depth), edge), stored)
    return stored


def as_bytes(attrs: dict[str, np.ndarray]) -> np.ndarray:
    """Attribute columns side by side as bytes; values outside 0..255 are refused."""
    for name, v in attrs.items():
        if v.size and (v.min() < 0 or v.max() > 255):
            raise ValueError(f"attribute {name} does not fit a byte")
    return np.concatenate([v.astype(np.uint8) for v in attrs.values()], axis=1)


def encode_chunk(idx: list[int], local: np.ndarray, attrs: np.ndarray, meta: dict) -> tuple[dict, bytes]:
    """One chunk's header entry and its bytes; every stream is compressed on its own."""
    depth = int(meta["chunk_size"]).bit_length() - 1
    codes = morton(local, depth)
    order = np.argsort(codes)
    codes, attrs = codes[order], attrs[order]
    tree = Octree.of_codes(codes, depth)
    attrs = filter_attrs(meta["filter"], tree, codes, attrs, meta["chunk_size"])
    streams, at = {"svo": tree.to_bytes()}, 0
    for name, width in meta["attr"]:
        part = attrs[:, at : at + width]
        if meta["attr_interleave"] == "none":
            streams.update({f"{name}_{i}": part[:, i].tobytes() for i in range(width)})
        elif meta["attr_interleave"] == "as_is":
            streams[name] = part.tobytes()
        at += width
    if meta["attr_interleave"] == "all":
        streams["attr"] = attrs.tobytes()
    entry, data = {"idx": idx}, b""
    for name, raw in streams.items():
        packed = squeeze(raw, meta["compression"], meta["compression_level"])
        entry[name] = [len(data), len(packed)]
        data += packed
    return entry, data


def streams_of(meta: dict, names: list[str] | None = None) -> list[str]:
    """The streams of a chunk that hold the wanted attributes (all unless given), besides the octree."""
    wanted = [(n, w) for n, w in meta["attr"] if names is None or n in names]
    if meta["attr_interleave"] == "all":
        return ["attr"] if wanted else []
    if meta["attr_interleave"] == "as_is":
        return [n for n, _ in wanted]
    return [f"{n}_{i}" for n, w in wanted for i in range(w)]


def decode_streams(idx: list[int], packed: dict[str, bytes], meta: dict, names: list[str] | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Absolute coordinates and the wanted attributes of one chunk, from its octree and the streams that hold them.

    Filters work on each channel by itself, so channels that nobody asks for are never unpacked.
    """

    def stream(name: str) -> np.ndarray:
        return np.frombuffer(expand(packed[name], meta["compression"], meta["compression_level"]), dtype=np.uint8)

    depth = int(meta["chunk_size"]).bit_length() - 1
    tree = Octree.of_bytes(stream("svo").tobytes(), depth)
    codes = tree.codes()
    coord = unmorton(codes, depth) + np.array(idx) * meta["chunk_size"]
    wanted = [(n, w) for n, w in meta["attr"] if names is None or n in names]
    if not wanted:
        return coord, {}
    parts = [stream(n).reshape(len(codes), -1) for n in streams_of(meta, names)]
    stored = np.concatenate(parts, axis=1)
    if meta["attr_interleave"] == "all":
        wide = np.cumsum([0, *(w for _, w in meta["attr"])])
        stored = stored[:, [c for k, (n, w) in enumerate(meta["attr"]) if names is None or n in names for c in range(wide[k], wide[k] + w)]]
    values, named, at = unfilter_attrs(meta["filter"], tree, codes, stored, meta["chunk_size"]), {}, 0
    for n, w in wanted:
        named[n] = values[:, at : at + w]
        at += w
    return coord, named


def assemble(meta: dict, chunks: list[tuple[dict, bytes]], voxels: int) -> bytes:
    """The whole file from its encoded chunks."""
    entries, body = [], []
    at = 0
    for entry, data in chunks:
        entries.append({**entry, "ptr": [at, len(data)]})
        body.append(data)
        at += len(data)
    raw = voxels * (12 + sum(w for _, w in meta["attr"]))
    head = {
        "num_voxel": voxels, **meta, "raw_size": raw, "compressed_size": at, "compress_ratio": raw / at if at else 0.0, "chunks": entries,
    }
    text = json.dumps(head).encode()
    return MAGIC + bytes([VERSION]) + struct.pack(">I", len(text) + 8) + text + b"".join(body)


def read_header(handle) -> tuple[dict, int]:
    """Header and the offset of the binary part; reads no further than the header."""
    start = handle.read(8)
    if start[:3] != MAGIC or start[3] != VERSION:
        raise ValueError("not a voxel container of version 0")
    offset = struct.unpack(">I", start[4:])[0]
    return json.loads(handle.read(offset - 8).decode()), offset
