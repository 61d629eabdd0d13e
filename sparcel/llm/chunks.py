"""Token ids of many texts at once: texts are cut where every tokenizer must cut, each distinct chunk is encoded once.

A chunk begins at a space between a character that is no space and one that is no white space, or at the text's
begin, where a space may be put before the text. Byte-level and word tokenizers begin a new word there, and a
vocabulary without a piece that holds a space behind another character can't merge across it, so the ids of a text
are those of its chunks in order. Arrow finds the distinct chunks of a batch; a bounded cache keeps their ids.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from sparcel.llm.bpe import byte_characters
from sparcel.llm.buffers import text_bytes

Asked = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]

#: ASCII white space and the bytes that begin white space beyond ASCII: before these a space is no cut.
_NO_CUT = np.zeros(256, bool)
_NO_CUT[[*range(0x09, 0x0E), 0x20, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def spaced(column: pa.Array, lead: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts, with ``lead`` each but the empty ones with a space put before it."""
    buf, bounds = text_bytes(column)
    if not lead:
        return buf, bounds
    size = np.diff(bounds)
    starts = np.concatenate(([0], np.cumsum(size + (size > 0))))
    out = np.empty(starts[-1], np.uint8)
    given = np.ones(len(out), bool)
    given[starts[:-1][size > 0]] = False
    out[given] = buf
    out[~given] = 32
    return out, starts


def cuts(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks begin."""
    cut = np.zeros(len(buf), bool)
    if len(buf) > 2:
        space = buf == 32
        cut[1:-1] = space[1:-1] & ~space[:-2] & ~_NO_CUT[buf[2:]]
    cut[starts[:-1][np.diff(starts) > 0]] = True
    return np.flatnonzero(cut)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the stretches [start, start + size) one behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class ChunkEncoder:
    """Ids of chunks by ``ask`` (texts -> ids one behind the other, number of each), remembered up to ``limit`` chunks."""

    def __init__(self, ask: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 400_000) -> None:
        self.ask, self.limit = ask, limit
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        known = len(self.slots)
        self.slots.update(zip(chunks, range(known, known + len(chunks))))
        ids, size = self.ask(chunks)
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(max(need, len(self.flat)), np.int32)))
        self.flat[self.used : need] = ids
        self.first = np.concatenate((self.first, self.used + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.used = need

    def encode(self, chunks: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks one behind the other, number of ids of each chunk)."""
        values = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = [self.slots.get(v) for v in values]
        missing = [v for v, k in zip(values, known) if k is None]
        if len(self.slots) + len(missing) > self.limit:
            self._forget()
            missing = values
        if missing:
            self._learn(missing)
            known = list(map(self.slots.__getitem__, values))
        slot = np.array(known, np.int64)[chunks.indices.to_numpy()]
        size = self.size[slot]
        return self.flat[ragged(self.first[slot], size)], size


def chunked(column: pa.Array, lead: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
    """(bytes, with ``lead`` with spaces put before, first byte of each text, first chunk of each text, chunks) of a string column."""
    buf, starts = spaced(column, lead)
    at = cuts(buf, starts)
    bounds = np.append(at, len(buf)).astype(np.int32)
    chunks = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(buf)])
    return buf, starts, np.searchsorted(at, starts), chunks.dictionary_encode()


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())), size


#: Characters whose class, case and normal form are the same in every library: ASCII and the Latin letters up to U+017F.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
_common = re.compile(f"[\\x00-\\x7f{_LATIN}]*").fullmatch
#: The same behind one space and no more white space: such chunks may stand behind any other.
_joinable = re.compile(f" [!-~{_LATIN}][\\x00-\\x7f{_LATIN}]*").fullmatch


def _apart(chunks: list[str], plain: list[bool], common: Asked, other: Asked) -> tuple[np.ndarray, np.ndarray]:
    """Plain chunks by ``common``, the rest by ``other``."""
    ids, size = common([c for c, p in zip(chunks, plain) if p])
    if all(plain):
        return ids, size
    more, sizes = other([c for c, p in zip(chunks, plain) if not p])
    mask = np.array(plain)
    total, first = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
    total[mask], total[~mask] = size, sizes
    first[mask], first[~mask] = np.cumsum(size) - size, len(ids) + np.cumsum(sizes) - sizes
    return np.concatenate((ids, more))[ragged(first, total)], total


def _library(path: str, plain: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    library.encode_special_tokens = plain
    return library, lambda chunks: _flat([e.ids for e in library.encode_batch_fast(chunks, add_special_tokens=False)])


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each token of a byte-level tokenizer file, by id."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    value = {c: b for b, c in enumerate(byte_characters())}
    names = {i: t for t, i in given["model"]["vocab"].items()}
    out = [bytes(map(value.__getitem__, names[i])) if i in names else b"" for i in range(max(names) + 1)]
    for t in given["added_tokens"]:
        out += [b""] * (t["id"] + 1 - len(out))
        out[t["id"]] = t["content"].encode()
    return out


@functools.lru_cache(2)
def byte_encoder(path: str, plain: bool = True) -> ChunkEncoder:
    """Chunks by a byte-level tokenizer file whose ids follow the order of its merges; with ``plain`` names of special tokens are plain text.

    Chunks of common characters are joined and encoded by tiktoken at once: a byte-level text gives back its bytes, so
    the tokens' lengths tell where chunks end. Others go through the tokenizers library.
    """
    import public_tokenizers
    import tiktoken

    names = token_bytes(path)
    library, other = _library(path, plain)
    special = {i: t.content for i, t in library.get_added_tokens_decoder().items()}
    ranks = {t: i for i, t in enumerate(names) if i not in special}
    engine = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = np.array([len(t) for t in names], np.int64)

    def common(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = engine.encode_to_numpy("".join(chunks), disallowed_special=()).astype(np.int32)
        ends = np.cumsum(lengths[ids])
        until = np.cumsum(np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks)))
        return ids, np.diff(np.searchsorted(ends, until, "right"), prepend=0)

    def ask(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joinable = [_joinable(c) is not None and (plain or not any(s in c for s in special.values())) for c in chunks]
        return _apart(chunks, joinable, common, other)

    return ChunkEncoder(ask)


@functools.lru_cache(2)
def word_encoder(path: str) -> ChunkEncoder:
    """Chunks by a tokenizer file with word ends; names of special tokens in a text are these tokens.

    Chunks of common characters are lowered and split here (the pattern's values are fixed by the file), and the
    library's model sees each distinct word once; others go through the whole library.
    """
    library, other = _library(path, False)
    special = [t.content for t in library.get_added_tokens_decoder().values()]
    model, shown = library.model, dict(enumerate(byte_characters()))
    split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^\\t-\\r 0-9a-z{_LATIN}]+").findall

    @functools.lru_cache(300_000)
    def word(text: str) -> bytes:
        seen = text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(shown)
        return array("i", [t.id for t in model.tokenize(seen)]).tobytes()

    def common(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        join = b"".join
        found = [join(map(word, split(c.lower()))) if "<|" not in c else array("i", library.encode(c, add_special_tokens=False).ids).tobytes() for c in chunks]
        return np.frombuffer(join(found), np.int32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    assert all("<|" in t for t in special), "special tokens begin with <|"
    return ChunkEncoder(lambda chunks: _apart(chunks, [_common(c) is not None for c in chunks], common, other))


@functools.lru_cache(2)
def piece_encoder(path: str) -> ChunkEncoder:
    """Chunks by a sentencepiece model, which puts the space before a text itself."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return ChunkEncoder(lambda chunks: _flat(pieces.encode([c[1:] for c in chunks], num_threads=1)))
