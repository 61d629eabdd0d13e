"""Packing against the tokenizers library, the rules of a packing and the bound by total length."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sparcel.llm import chunks, packing
from tests.llm.test_operators import documents, table

WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n a\n", "a b  c", "　x 　 y", "don't  it's 'll", "x <|endoftext|>y <|startoftext|> z",
    "É é É ́x", "ſtra İ ß ﬁ", "日本 語 テスト", "\U0001f600 a", "a\x01 b \x00 c", "\x1c a \x85 b", "▁x ▁ y", "ᾳ ǅ Σας ΣΑΣ", "1 23 4a5", "a" * 3000, "é ñ " * 900,
    "Ɤ \U000105c1 x", "a\tb \t c", "foo\n", "  a", "foo ", " \n b", "<|endoftext|> x", "x<|endoftext|>",
]


@pytest.mark.parametrize("kind", ["word", "byte", "bare", "piece"])
def test_chunks_give_the_ids_of_whole_texts(kind):
    rnd = random.Random(5)
    alphabet = ["a", "B", "é", "Ñ", " ", "  ", "\n", "1", ".", "'s", "'", "-", "́", "日", "<|", "ſ", " ", "_"]
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    if kind == "piece":
        import sentencepiece

        want, encoder = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(texts, num_threads=1), chunks.piece_encoder(PIECES)
        skip = {i for i, t in enumerate(texts) if "▁" in t}  # a piece does not give these back
    else:
        library = Tokenizer.from_file(WORDS if kind == "word" else BYTES)
        library.encode_special_tokens = kind == "byte"
        want = [e.ids for e in library.encode_batch([" " + t if kind == "byte" and t else t for t in texts], add_special_tokens=False)]
        encoder, skip = (chunks.word_encoder(WORDS) if kind == "word" else chunks.byte_encoder(BYTES, plain=kind == "byte")), set()
    for _ in range(2):  # learnt, then remembered
        _, _, first, found = chunks.chunked(pa.array(texts), lead=kind != "bare")
        ids, size = encoder.encode(found)
        bounds = np.concatenate(([0], np.cumsum(size)))[first]
        for i, text in enumerate(texts):
            if i not in skip:
                assert ids[bounds[i] : bounds[i + 1]].tolist() == list(want[i]), text


def check_packing(docs, rows, capacity):
    """Every document's ids once and in order, sequences without gaps and within the capacity."""
    library = Tokenizer.from_file(WORDS)
    expected = []
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            expected.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(repr, (tuple(r)[:5] for r in rows))) == sorted(map(repr, expected))
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing(spark):
    docs = documents(n=90)
    for capacity in (2048, 40, 1):
        found = packing.pack_documents(table(spark, docs), WORDS, capacity=capacity).collect()
        made = check_packing(docs, found, capacity)
        total = sum(r.length for r in found)
        assert made <= 1.01 * total / capacity + 2


def test_packing_of_odd_tables(spark):
    empty = packing.pack_documents(table(spark, []), WORDS)
    assert empty.collect() == [] and empty.columns[-2:] == ["sequence_id", "offset"]
    odd = table(spark, [(1, None), (1, None), (None, "x"), (2, "")]).selectExpr("doc_id", "text", "1 as piece", "2 as _part", "3 as length")
    assert check_packing([(1, None), (1, None), (None, "x"), (2, "")], packing.pack_documents(odd, WORDS).collect(), 2048) == 1


@pytest.mark.parametrize("seed", range(3))
def test_plan_is_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6, 1.2, [2000, 40_000, 7][seed]).astype(int), 1, 2048)
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.plan_sequences(dict(zip(values.tolist(), counts.tolist())), 2048)
    assert plan.sequences <= -(-int(lengths.sum()) // 2048) * 1.002 + 1
    rank = np.concatenate([np.arange(c) for c in counts])
    length = np.repeat(values, counts)
    sequence, offset = plan.place(length, rank)
    order = np.lexsort((offset, sequence))
    sequence, offset, length = sequence[order], offset[order], length[order]
    first = np.r_[True, sequence[1:] != sequence[:-1]]
    assert (offset[first] == 0).all() and (offset[1:] == (offset + length)[:-1])[~first[1:]].all() and (offset + length).max() <= 2048


def test_knapsack_against_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        n, capacity = rnd.randint(1, 4), rnd.randint(5, 20)
        lengths = np.array(sorted(rnd.sample(range(1, 12), n)))
        values, left = np.array([rnd.random() for _ in range(n)]), np.array([rnd.randint(1, 3) for _ in range(n)])
        best = 0.0

        def walk(j, room, worth):
            nonlocal best
            best = max(best, worth)
            if j < n:
                for k in range(int(left[j]) + 1):
                    if k * lengths[j] <= room:
                        walk(j + 1, room - k * lengths[j], worth + k * values[j])

        walk(0, capacity, 0.0)
        config = packing.best_configuration(lengths, values, left, capacity)
        assert sum(k * lengths[j] for j, k in config.items()) <= capacity and all(k <= left[j] for j, k in config.items())
        assert abs(sum(k * values[j] for j, k in config.items()) - best) < 1e-9
