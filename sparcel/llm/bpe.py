"""BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word there is exactly one token that can end its encoding. An automaton over the
vocabulary reports every token that is a suffix of the prefix; the one that also fits behind the last token
of the prefix before it is stored. Following the stored tokens back from the end of the word gives the ids,
in time linear in the word's length.

Two neighbours fit if merging cannot cross their border. A token's right edge passes through a
chain of tokens, each living until the merge that swallows it; so does the left edge of the next
one. A rule over the border fires if its rank comes before the end of both (of equal ranks the left
place goes first). Pairs once tested are remembered.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparcel.llm import buffers
from sparcel.llm.unicode import char_classes

_NEVER = 1 << 60


@functools.cache
def words_pattern() -> re.Pattern[str]:
    """The vocabulary's pre-tokenizer: contractions (fixed values), runs of letters, single numbers, runs of others."""
    c = char_classes()
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{c['L']}]+|[{c['N']}]|[^{c['S']}{c['L']}{c['N']}]+")


def _young(text: str) -> bool:
    """Whether a text has characters without a class in Python's tables, which newer tables may know."""
    return any(unicodedata.category(c) == "Cn" for c in set(text))


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Cache(dict):
    """Values of ``make`` by key, about the last ``limit`` used; long keys are not kept.

    When half the limit is reached the entries become the old generation, from which keys still in use come back.
    """

    def __init__(self, make: Callable[[str], bytes], limit: int, longest: int = 64) -> None:
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit // 2, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordBpe:
    """A vocabulary with word ends, read from a tokenizer file.

    Inside, a word is a string of symbols: a byte's symbol is its value, that of the word's last byte 256 more.
    """

    def __init__(self, path: str, cached: int = 300_000) -> None:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        model = given["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        value = {c: b for b, c in enumerate(byte_characters())}
        symbols: dict[int, str] = {}
        for text, i in vocab.items():
            if text in value:
                symbols[i] = chr(value[text])
            elif end and text.endswith(end) and text[: -len(end)] in value:
                symbols[i] = chr(256 + value[text[: -len(end)]])
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.rules: dict[int, int] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left, right, out = vocab[a], vocab[b], vocab[a + b]
            self.rules[left << 20 | right] = rank
            self.parts[out], self.rank[out] = (left, right), rank
            symbols[out] = symbols[left] + symbols[right]
        self.length = {i: len(s) for i, s in symbols.items()}
        self.automaton = ahocorasick.Automaton()
        for i, s in symbols.items():
            if i not in self.parts or not self._crossed(*self.parts[i], self.rank[i]):
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._findall = words_pattern().findall
        self._words = Cache(lambda word: np.array(self.encode_word(word), "<i4").tobytes(), cached)
        self._chunks = Cache(self._chunk, cached)
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def _edge(self, token: int, side: int, until: int) -> Iterator[tuple[int, int]]:
        """Tokens along an edge of ``token``, each with the rank of the merge that ends it."""
        yield token, until
        while token in self.parts:
            until, token = self.rank[token], self.parts[token][side]
            yield token, until

    def _crossed(self, a: int, b: int, until: int) -> bool:
        """Whether a rule fires over the border of a and b before rank ``until``."""
        right = list(self._edge(a, 1, until))
        for y, y_end in self._edge(b, 0, until):
            for x, x_end in right:
                rank = self.rules.get(x << 20 | y)
                if rank is not None and rank < x_end and rank <= y_end and rank < until:
                    return True
        return False

    def fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[key] = not self._crossed(a, b, _NEVER)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (text without splits)."""
        data = word.encode()
        n = len(data)
        symbols = data[:-1].decode("latin-1") + chr(256 + data[-1])
        last, length, fits = [-1] * (n + 1), self.length, self.fits
        for end, token in self.automaton.iter(symbols):
            if last[end + 1] < 0:
                start = end + 1 - length[token]
                if start == 0 or fits(last[start], token):
                    last[end + 1] = token
        ids = []
        while n:
            ids.append(last[n])
            n -= length[last[n]]
        return ids[::-1]

    def _chunk(self, chunk: str) -> bytes:
        if not chunk.isascii() and _young(chunk):
            return np.array(self._library.encode(chunk, add_special_tokens=False).ids, "<i4").tobytes()
        return b"".join(map(self._words.__getitem__, self._findall(chunk)))

    def _chunks_of(self, text: str) -> list[str]:
        """Pieces between spaces, normalised; white space never lies inside a token.

        A text with characters that Python's tables don't know yet is left as it is: the library normalises its pieces.
        """
        if not text.isascii():
            if _young(text):
                return text.replace("\n", " ").split(" ")
            # the sigma at a word's end is lowered as any other
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.replace("\n", " ").lower().split(" ")

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; null and empty texts have none."""
        text = text or ""
        if self._split_added and any(t in text for t in self.added):
            ids = []
            for part in self._split_added.split(text):
                ids.append(np.array([self.added[part]], "<i4").tobytes() if part in self.added else b"".join(map(self._chunks.__getitem__, self._chunks_of(part))))
            return np.frombuffer(b"".join(ids), "<i4")
        return np.frombuffer(b"".join(map(self._chunks.__getitem__, self._chunks_of(text))), "<i4")

    @functools.cached_property
    def _names(self) -> list[str]:
        return [self.tokens[i] for i in range(max(self.tokens) + 1)]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by one space: the vocabulary's file names no decoder."""
        return " ".join(map(self._names.__getitem__, ids.tolist()))


@functools.lru_cache(2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, ids (array of int), and with ``decoded`` the text those ids give.

    ``path`` is a tokenizer file that every worker can open. Null counts as empty: no ids, empty text.
    Rows are independent: repeated rows and ids give repeated results, null ids stay null, further
    columns are left out. A text is encoded whole, in time linear in its length.
    """
    buffers.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for piece in buffers.pieces(batch):
                ids = [bpe.encode(t) for t in piece.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                columns = [piece.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))]
                if decoded:
                    columns.append(pa.array([bpe.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, text. Null counts as no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = [bpe.decode(np.array(i or [], np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
