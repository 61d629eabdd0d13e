"""Alignment of two tokenizers against a plain version that looks at every byte."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparcel.llm import align
from tests.llm.test_operators import documents, table
from tests.llm.test_packing import ODD

BYTES, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def brute_groups(texts):
    """Groups of each text as pairs of id lists."""
    library, model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    library.encode_special_tokens = True
    shown = {c: b for b, c in enumerate(align.token_bytes.__globals__["byte_characters"]())}
    out = []
    for text in texts:
        groups = []
        if text:
            a = [(i, bytes(shown[c] for c in library.id_to_token(i))) for i in library.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in model.encode(text):
                p = model.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()))
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                ends = []
                for side in (a, b):
                    at, found = 0, []
                    for i, x in side:
                        at += len(x)
                        found.append((at, i))
                    ends.append(found)
                both = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
                begin = 0
                for end in both:
                    groups.append(tuple([i for e, i in side if begin < e <= end] for side in ends))
                    begin = end
        out.append(groups)
    return out


def brute(docs):
    found = brute_groups([t for _, t in docs])
    count = Counter(pair for groups in found for pair in {(x, y) for p, q in groups for x in p for y in q})
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for (doc_id, _), groups in zip(docs, found):
        links = [(x, y) for p, q in groups for x in p for y in q]
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        rows.append(
            (doc_id, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else "")
        )
    return rows


def sample():
    rnd = random.Random(9)
    texts = [*ODD, "▁", "a▁b", "日本語テスト" * 400, "😀" * 70, "<s> </s> <unk> <|endoftext|>", "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(300))]
    return [*documents(n=60), *enumerate(texts, 1000)]


@pytest.mark.parametrize("listed", [1 << 16, 3])
def test_link_counts(spark, monkeypatch, listed):
    monkeypatch.setattr(align, "LISTED", listed)
    docs = sample()
    found = align.link_counts(table(spark, docs), BYTES, PIECES)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, brute(docs)))


def test_align(spark):
    docs = sample()
    got = {}
    for r in align.align(table(spark, docs), BYTES, PIECES).collect():
        groups, i, j = [], 0, 0
        for x, y in zip(r.a_ends, r.b_ends):
            groups.append((r.a_ids[i:x], r.b_ids[j:y]))
            i, j = x, y
        got.setdefault(r.doc_id, []).append(groups)
    want = {}
    for (doc_id, _), groups in zip(docs, brute_groups([t for _, t in docs])):
        want.setdefault(doc_id, []).append(groups)
    assert {k: sorted(map(repr, v)) for k, v in got.items()} == {k: sorted(map(repr, v)) for k, v in want.items()}


def test_odd_tables(spark):
    assert align.link_counts(table(spark, []), BYTES, PIECES).collect() == []
    docs = [(1, None), (1, None), (None, "x y"), (2, "")]
    odd = table(spark, docs).selectExpr("doc_id", "text", "1 as block", "2 as pair", "3 as n_a")
    assert sorted(map(repr, map(tuple, align.link_counts(odd, BYTES, PIECES).collect()))) == sorted(map(repr, brute(docs)))


def test_lockstep_against_sets():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        a_ends, b_ends, a_first, b_first, at = [], [], [0], [0], 0
        for _ in range(rnd.integers(1, 8)):
            n = int(rnd.integers(0, 30))
            for ends, first in ((a_ends, a_first), (b_ends, b_first)):
                inner = sorted(set(rnd.integers(1, n, n // 2).tolist())) if n > 1 else []
                ends += [at + e for e in inner if e < n] + [at + n] * (n > 0)
                first.append(len(ends))
            at += n
        a_cut, b_cut = align.lockstep(np.array(a_ends, np.int64), np.array(a_first), np.array(b_ends, np.int64), np.array(b_first))
        both = set(a_ends) & set(b_ends)
        assert a_cut.tolist() == [e in both for e in a_ends] and b_cut.tolist() == [e in both for e in b_ends]
