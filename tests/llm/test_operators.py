"""Each operator on small tables against brute force, with nulls, ties, repeats, empty tables and odd columns."""

import hashlib
import os
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparcel.llm import bpe, buffers, chat, chunks, components, decontaminate, exact_dedup, near_dedup, ppm, quality, repeats, token_files, toxicity
from sparcel.llm.samples import remainder
from sparcel.session import stage, staged_since

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def documents(seed=3, n=60):
    """Texts with copies, near copies, repeats, nulls, empty and long ones."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))) for _ in range(n // 2)]
    for _ in range(n // 3):
        near = rnd.choice(texts).split(" ")
        near[rnd.randrange(len(near))] = rnd.choice(vocabulary)
        texts.append(" ".join(near))
    texts += [None, "", "", " ", "x", "One word ", texts[0], texts[1], texts[1].upper(), " ".join(vocabulary * 40), "la " * 300]
    rows = list(enumerate(texts))
    return [*rows, (3, "again an id"), (3, texts[3]), (None, texts[0]), (None, None)]


# 1


def brute_contamination(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            i = words(item)
            n = min(10, len(i))
            for a in range(len(i) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == i[a : a + n]:
                        hit |= set(range(b, b + n))
                        found |= {str(item_id)} if item_id is not None else set()
        out.append((doc_id, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def test_decontamination(spark):
    docs = documents()
    long = [t for _, t in docs if t and len(words(t)) > 30]
    items = [(1, long[0]), (10, " ".join(words(long[1])[5:17])), (2, " ".join(words(long[2])[3:7])), (4, " ".join(words(long[3])[:5])), (2, long[1][:60]), (None, long[4]), (5, None), (6, "..."), (7, "no such words")]
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    found = decontaminate.contamination(table(spark, docs).withColumn("row", F.lit(1)), b).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in found), key=repr) == brute_contamination(docs, items)
    assert any(r.n_hit for r in found) and all(r.contaminated == (r.n_hit > 0) for r in found)


def test_decontamination_empty(spark):
    docs, none = table(spark, [(1, "a b")]), spark.createDataFrame([], "item_id bigint, text string")
    assert [(r.n_words, r.n_hit) for r in decontaminate.contamination(docs, none).collect()] == [(2, 0)]
    assert decontaminate.contamination(table(spark, []), none).count() == 0


def test_decontamination_without_broadcast(spark):
    docs = documents(5)
    items = [(i, t) for i, (_, t) in enumerate(docs[:6])]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    a = [decontaminate.matches(table(spark, docs), b, broadcast_rows=n)[1].count() for n in (0, 1000)]
    assert a[0] == a[1] > 0


# 2


def test_code_lengths_are_those_of_the_definition():
    texts = {"a": ["abab abc", "ab"], "b": ["ba ba", "ccc"]}
    order = 2
    counts = {}
    for lang, given in texts.items():
        for t in given:
            padded = b"  " + t.encode()
            for i in range(2, len(padded)):
                for d in range(order + 1):
                    node = counts.setdefault((lang, padded[i - d : i]), {})
                    node[padded[i]] = node.get(padded[i], 0) + 1

    def bits(lang, context, byte):
        seen = counts.get((lang, context))
        shorter = (lambda: bits(lang, context[1:], byte)) if context else (lambda: 8)
        if not seen:
            return shorter()
        n, d = sum(seen.values()), len(seen)
        return -np.log2(seen[byte] / (n + d)) if byte in seen else -np.log2(d / (n + d)) + shorter()

    lang, gram, n = [], [], []
    for k, (_, given) in enumerate(sorted(texts.items())):
        batch = pa.RecordBatch.from_pydict({"lang": ["x"] * len(given), "text": given})
        for out in ppm._count_grams(iter([batch]), order):
            lang += [k] * out.num_rows
            gram += out.column(1).to_pylist()
            n += out.column(2).to_pylist()
    model = ppm.compiled(["a", "b"], np.array(lang), np.array(gram), np.array(n), order, 1000)
    tried = ["abcab", "", "zz top", "ba"]
    got = model.code_lengths(*buffers.text_bytes(pa.array(tried)))
    for t, row in zip(tried, got):
        padded = b"  " + t.encode()
        for k, name in enumerate("ab"):
            assert row[k] == pytest.approx(sum(bits(name, padded[i - 2 : i], padded[i]) for i in range(2, len(padded))), rel=1e-5)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = remainder("doc_id", 4) == 2
    model = ppm.fit(docs.filter(~held))
    seen = ppm.identify(docs.filter(held), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in seen) >= 0.95 * len(seen)
    assert all(0 <= r.score <= 1 for r in seen)


def test_language_odd_rows(spark):
    learnt = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "fr"), (4, "x", None)], "doc_id bigint, text string, lang string")
    model = ppm.fit(learnt)
    assert model.languages == ["de", "en"]
    rows = ppm.identify(spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 ?!", "en"), (4, "the dog", "de"), (4, "die katze", "en"), (None, "日本", "x")], "doc_id bigint, text string, lang string"), model).collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and [r.score for r in rows[:3]] == [0.0] * 3
    assert [r.lang_pred for r in rows[3:5]] == ["en", "de"] and rows[5].lang_pred in ("de", "en")
    nothing = ppm.fit(learnt.limit(0))
    assert [r.lang_pred for r in ppm.identify(table(spark, [(1, "a")]), nothing).collect()] == ["und"]
    assert ppm.identify(table(spark, []), model).count() == 0


# 3


def brute_repeats(docs):
    rows = [((i if i is not None else 1 << 62), i, (t or "").encode()) for i, t in docs]
    first = {}
    for key, _, t in sorted(rows, key=lambda r: r[0]):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], key)
    out = []
    for key, i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < key:
                gone[k : k + 50] = b"\x01" * 50
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((i, len(t), spans, bytes(c for c, x in zip(t, gone) if not x)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("piece,block", [(2 << 20, 1 << 19), (3000, 700)])
def test_repeats(spark, monkeypatch, piece, block):
    monkeypatch.setattr(repeats, "PIECE", piece)
    monkeypatch.setattr(repeats, "_BLOCK", block)
    monkeypatch.setattr(repeats, "_SORTED", block)
    rnd = random.Random(piece)
    line = "A very common line that stands in a large part of all the documents."
    docs = documents(7) + [(100 + i, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))) + line + "".join(rnd.choice("abcdefgh") for _ in range(60))) for i in range(40)]
    docs += [(200, "a" * 500), (201, "a" * 49), (202, "b" + "a" * 60)]
    got = repeats.remove_repeats(table(spark, docs).withColumn("piece", F.lit("clash"))).collect()
    assert sorted(((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in got), key=repr) == brute_repeats(docs)
    for r in got:
        assert r.n_bytes - sum(s.end - s.start for s in r.spans) == len(r.kept)


def test_repeats_disk(spark):
    """Short strings that most documents share, with other text around them, put no more on disk than the text's own anchors do."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(4, 8))) for _ in range(30)]
    docs = [(i, " ".join(rnd.choice(vocabulary) for _ in range(200))) for i in range(600)]
    docs.append((600, docs[0][1][100:400] + "." + docs[1][1]))
    folders = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files(tops):
        return {f: os.path.getsize(f) for top in tops for d, _, names in os.walk(top) for f in (os.path.join(d, x) for x in names)}

    before = files(folders)
    with staged_since() as staged:
        got = repeats.remove_repeats(table(spark, docs)).collect()
    written = sum(n for f, n in files([*folders, *staged]).items() if f not in before and f.endswith((".data", ".parquet")))
    assert sorted(((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in got), key=repr) == brute_repeats(docs)
    assert written < 2.2 * sum(len(t) for _, t in docs)


@pytest.mark.parametrize("crowd", [1, 2, 1000])
def test_repeats_by_hand(crowd, monkeypatch):
    """Pieces, anchors and suffix order called one after the other: every threshold of a crowd gives the same, and answers belong to the entries sent."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    docs = [(i, t or "") for i, t in documents(9)]
    docs += [(-(1 << 63) + 5, docs[2][1]), (300, "x" * 18 + docs[4][1]), (400, "short")]
    pieces = [repeats.Piece({"doc_ids": pa.scalar([i for i, _ in part], pa.list_(pa.int64())), "texts": pa.scalar([t for _, t in part], pa.list_(pa.string()))}) for part in (docs[:20], docs[20:21], docs[21:-1], docs[-1:])]

    def matched(function, sent):
        rows = [(b, k, x) for k, packed in enumerate(sent) for b, x in packed]
        for bucket in sorted({b for b, _, _ in rows}):
            mine = [r for r in rows if r[0] == bucket]
            yield from function(pa.table({"bucket": pa.array([bucket] * len(mine), pa.int32()), "piece": pa.array([k for _, k, _ in mine], pa.int64()), "packed": pa.array([x for _, _, x in mine], pa.binary())})).to_pylist()

    answers = [*matched(repeats.match_anchors, [repeats._anchor_rows(p, 5) for p in pieces])]
    told = [p.told([a for a in answers if a["piece"] == k], 5) for k, p in enumerate(pieces)]
    masks = [*matched(repeats.match_suffixes, [repeats._suffix_rows(p, t, 5) for p, t in zip(pieces, told)])]
    got = []
    for k, (p, t) in enumerate(zip(pieces, told)):
        pairs = np.frombuffer(b"".join(m["masks"] for m in masks if m["piece"] == k), "<u8").reshape(-1, 2)
        keys, which = np.unique(pairs[:, 0], return_inverse=True)
        bits = np.zeros(len(keys), np.uint64)
        np.bitwise_or.at(bits, which, pairs[:, 1])
        gone = repeats.repeated_bytes(p, t, keys, bits)
        for i, a, b in zip(p.doc_ids.to_pylist(), p.bounds, p.bounds[1:]):
            got.append((i, int(b - a), len(buffers.runs(gone[a:b])[0]), p.buf[a:b][~gone[a:b]].tobytes()))
    assert sorted(got, key=repr) == brute_repeats(docs)


@pytest.mark.parametrize("docs", [[5], [1, 2, 2, 130], [7, -7, 200], [1, 1 << 40, 3], [-(1 << 63), (1 << 63) - 1, 0, -(1 << 63)]])
def test_repeats_packed(docs):
    n = len(docs)
    key, string, doc = np.arange(n, dtype=np.uint64) << np.uint64(60), np.arange(n, dtype=np.uint64) + np.uint64(9), np.array(docs)
    for got, put in zip(repeats._unpack_anchors(repeats._pack_anchors(key, string, doc)), (key, string, doc)):
        assert got.tolist() == put.tolist()


def test_repeats_empty(spark):
    assert repeats.remove_repeats(table(spark, [])).count() == 0


# 4


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for k in range(150):
        n, bits = int(rng.integers(0, 2000)), int(rng.integers(1, 64))
        ids = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) >> np.uint64(64 - bits)
        if k % 2:
            ids = np.where(rng.random(n) < 0.5, ids >> np.uint64(min(bits - 1, 40)), ids)
        assert (token_files.unpack(token_files.pack(ids), n) == ids).all()


def test_simple8b_words_by_hand():
    assert token_files.pack(np.array([1, 2, 3], np.uint64)).tolist() == [14 - 12 << 60 | 1 | 2 << 2 | 3 << 4]
    assert token_files.pack(np.array([1 << 61], np.uint64)).tolist() == [0, 1 << 61]


def test_encoder_is_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), chunks.byte_encoder(path, plain=False)
    rnd = random.Random(2)
    alphabet = "abcdefghijklmnop ABC éüñ0123.,!?'’\n\t  <|> aaathe 日本²½\x1c"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) + ("<|endoftext|> x" if rnd.random() < 0.05 else "") for _ in range(3000)]
    _, _, first, found = chunks.chunked(pa.array(texts), lead=False)
    ids, size = encoder.encode(found)
    bounds = np.concatenate(([0], np.cumsum(size)))[first]
    for t, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 100)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = documents()
    listed = token_files.write_tokens(table(spark, docs).withColumn("part", F.lit("clash")), path, files=4)
    got = sorted(token_files.token_documents(listed).collect(), key=lambda r: r.start)
    want, start = [], 0
    for i, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_files.token_documents(token_files.write_tokens(table(spark, []), path)).count() == 0


# 5


def test_bpe_is_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.WordBpe(path, cached=50)
    rnd = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyzABC éüñß0123456789.,!?'’-_\n\t  <|>aaaaeethİΣς日本"
    tried = ["", "<|endoftext|>", "a<|startoftext|>B", "ΑΣ ΑΣΑ", unicodedata.normalize("NFD", "éñ"), "a" * 5000, "ab" * 3000]
    tried += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    for t in tried:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids
        assert own.decode(own.encode(t)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_characters_younger_than_the_tables_of_python():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    young = [c for c in map(chr, [*range(0x1C80, 0x1C90), *range(0xA7C0, 0xA7E0), *range(0x105C0, 0x10600), *range(0x10D40, 0x10D90), *range(0x1CC00, 0x1CD00), *range(0x1E5D0, 0x1E600)])]
    for c in young:
        text = f"a{c}b {c} É{c}1{c}"
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_bpe_tables(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = documents()
    coded = bpe.encode(table(spark, docs).withColumn("ids", F.lit("clash")), path, decoded=True)
    want = sorted(((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in docs), key=repr)
    assert sorted(((r.doc_id, tuple(r.ids)) for r in coded.collect()), key=repr) == want
    again = bpe.decode(coded.select("doc_id", "ids"), path).collect()
    assert sorted(r.text for r in again) == sorted(r.decoded for r in coded.collect())
    assert bpe.encode(table(spark, []), path).count() == 0


# 6


def test_chain_finds_categories(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(400):
        bad, worse = rnd.random() < 0.3, rnd.random() < 0.2
        text = [rnd.choice(["sun", "moon", "tree", "rock", "sea"]) for _ in range(20)] + ["grim"] * bad + ["vile"] * worse
        rnd.shuffle(text)
        rows.append((i, " ".join(text), int(bad), int(bad or worse)))
    rows += [(1000, None, 0, 0), (1001, "", None, 1)]
    given = spark.createDataFrame(rows, "doc_id bigint, text string, insult int, toxic int")
    chain = toxicity.fit(given.filter("doc_id % 4 > 0"), ["insult", "toxic"], least=5)
    assert len(chain.links[1].weights) == len(chain.vocabulary) + 1 and chain.links[1].weights[-1] > 0
    scored = toxicity.score(given, chain).join(given, "doc_id").filter("toxic is not null").collect()
    assert sum((r.p_toxic > 0.5) == r.toxic for r in scored) >= 0.97 * len(scored)
    assert sum((r.p_insult > 0.5) == r.insult for r in scored) >= 0.97 * len(scored)
    empty = toxicity.fit(given.limit(0), ["insult", "toxic"])
    assert {r.p_toxic for r in toxicity.score(table(spark, [(1, "a"), (None, None)]), empty).collect()} == {0.5}
    assert toxicity.score(table(spark, []), chain).count() == 0


def test_chain_learns_rare_words(spark):
    """A word in 12 of 6,000 labelled texts, all of them toxic, beside twelve common toxic words."""
    rnd = random.Random(60)
    plain, common = [f"plain{i}" for i in range(300)], [f"vile{i}" for i in range(12)]
    rows = []
    for i in range(6000):
        toxic = rnd.random() < 0.11
        rows.append((i, " ".join([rnd.choice(plain) for _ in range(20)] + [rnd.choice(common)] * toxic), int(toxic)))
    rows[:12] = [(i, " ".join([rnd.choice(plain) for _ in range(20)] + ["rareword"]), 1) for i in range(12)]
    chain = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int"), ["toxic"])
    scored = {r.doc_id: r.p_toxic for r in toxicity.score(table(spark, [(1, "plain1 rareword plain2"), (2, "plain1 plain2"), (3, "vile3 plain1"), (4, "unseen plain7")]), chain).collect()}
    assert scored[1] >= 0.35 and scored[3] >= 0.35
    assert scored[2] < 0.1 and scored[4] < 0.1
    few = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int"), ["toxic"], sample=600)
    assert toxicity.score(table(spark, [(1, "plain1 rareword plain2")]), few).first().p_toxic >= 0.35


# 7


def messages(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return df.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST] \\l \\b <|end|>"), (1, 1, "assistant", "<|turn|>x\nyé\\"), (1, 2, "assistant", ""), (2, 0, "ro\nle<", None), (2, 0, None, "b"), (2, 0, None, "b"), (None, None, "assistant", "z")]
    formatted = chat.format_conversations(messages(spark, rows))
    found = {r.conv_id: r for r in chat.parse_conversations(formatted).collect()}
    assert [(t.role, t.text) for t in found[1].turns] == [(r, t) for _, _, r, t in rows[:3]]
    assert found[1].loss_text == "<|turn|>x\nyé\\"
    assert [(t.role, t.text) for t in found[2].turns] == [("", "b"), ("", "b"), ("ro\nle<", "")]
    assert found[2].loss_text == "" and found[None].loss_text == "z"
    for r in formatted.collect():
        assert r.formatted.count("<|turn|>") == r.formatted.count("<|end|>") == r.n_turns
    assert chat.format_conversations(messages(spark, rows).limit(0)).count() == 0


def test_chat_parts(spark):
    leaf = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    parts = [("text", "see ", None, None, None), ("image", None, "i1", 2, None), ("document", None, "d1", 3, [leaf("text", "page <"), leaf("audio", ref="a1", units=4)]), ("text", " end", None, None, None)]
    rows = [(1, 0, "user", parts), (1, 1, "user", [("image", None, "i2", None, [])]), (1, 2, "user", None), (1, 3, "user", [("film", None, "f", 7, None)])]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}")
    r = chat.format_conversations(df).collect()[0]
    assert r.formatted == "<|turn|>user\nsee <|image:1|><|document:2|>page \\l<|audio:3|> end<|end|><|turn|>user\n<|image:4|><|end|><|turn|>user\n<|end|><|turn|>user\n<|film:5|><|end|>"
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "i1", 512), (0, "document", "d1", 1536), (0, "audio", "a1", 100), (1, "image", "i2", 256), (3, "film", "f", 7)]
    assert r.expanded_tokens == 512 + 1536 + 100 + 256 + 7


# 8


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    given = docs.select("doc_id", "text").join(labels, "doc_id")
    model = quality.fit(given.filter(remainder("doc_id", 5) != 0))
    seen = quality.score(docs, model).join(labels, "doc_id").filter(remainder("doc_id", 5) == 0).collect()
    assert sum((r.score >= 0.3) == (r.label == 1) for r in seen) >= 0.95 * len(seen)
    odd = quality.score(table(spark, [(1, None), (2, ""), (None, "x"), (2, "\n")]), model).collect()
    assert len({r.score for r in odd if r.doc_id}) == 1 and all(0 <= r.score <= 1 for r in odd)


def test_quality_features_are_those_of_the_definition():
    texts = ["ab ab  abc", "", "é", " x"]
    kinds = list(quality.features(*buffers.text_bytes(pa.array(texts)), 1 << 20, (3,)))
    tokens, again, grams = [[b[f[i] : f[i + 1]].tolist() for i in range(4)] for b, f in kinds]
    assert [len(t) for t in tokens] == [3, 0, 1, 1] and tokens[0][0] == tokens[0][1] != tokens[0][2]
    assert again == [[0], [], [], []]
    # " ab", "ab ", " ab", "ab ", " ab", "abc", "bc "; then " é" and "é "; two spaces of different words around " x "
    assert [len(g) for g in grams] == [7, 0, 2, 0] and grams[0][0] == grams[0][2] == grams[0][4]


def test_quality_without_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, label int")
    assert {r.score for r in quality.score(table(spark, [(1, "a"), (2, None)]), quality.fit(none)).collect()} == {0.5}


# 9


def brute_classes(docs):
    """Components of texts whose shingles, labelled with their number, agree to 0.8 in order (by full alignment)."""
    labelled = []
    for _, text in docs:
        w, seen, out = words(text), {}, []
        for k in range(max(len(w) - 4, min(len(w), 1))):
            s = tuple(w[k : k + 5])
            seen[s] = seen.get(s, 0) + 1
            out.append((s, seen[s]))
        labelled.append(out)
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(labelled):
        for j in range(i):
            b = labelled[j]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                row = [0] * (len(b) + 1)
                for x in a:
                    diagonal = 0
                    for k, y in enumerate(b, 1):
                        diagonal, row[k] = row[k], diagonal + 1 if x == y else max(row[k], row[k - 1])
                if row[-1] >= 0.8 * (len(a) + len(b) - row[-1]) - 1e-9:
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(docs))]


def test_near_copies(spark):
    docs = [(i, t) for i, t in documents(9, 90) if i is not None and t is not None]
    docs = [(k, t if len(words(t)) < 400 else t[:900]) for k, (_, t) in enumerate(docs)] + [(500, None), (501, "")]
    got = {r.doc_id: r for r in near_dedup.near_groups(table(spark, docs).withColumn("row", F.lit("clash"))).collect()}
    want = [docs[i][0] for i in brute_classes(docs)]
    assert [got[i].class_id for i, _ in docs] == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())
    assert len(set(want)) < len(docs) - 10


def test_chain_of_near_copies(spark):
    """Neighbours are alike, ends are not: one class all the same; a bucket's leaders change until that is known."""
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(f"x{k}" if k < 6 * i else w for k, w in enumerate(base))) for i in range(12)]
    docs += [(100 + i, " ".join([*base[:100], *(f"y{i}z{k}" for k in range(100))])) for i in range(8)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(table(spark, docs)).collect()}
    assert {got[i] for i in range(12)} == {0} and all(got[100 + i] == 100 + i for i in range(8))


def test_near_copies_move_little(spark, monkeypatch):
    """Texts are not written again, and what members have beyond leaders not once for each bucket; few pairs end the rounds."""
    made = []
    monkeypatch.setattr(near_dedup, "stage", lambda df, label="stage": made.append((label, df.columns)) or stage(df, label))
    passage = [f"p{i}" for i in range(60)]
    docs = [(i, " ".join([*passage, *(f"x{i % 50}y{k}" for k in range(60 - i // 50))])) for i in range(100)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(table(spark, docs)).collect()}
    assert got == {i: i % 50 for i in range(100)}
    assert not any({"text", "doc"} & set(c) for _, c in made)
    assert [c for label, c in made if label == "left-members"] and not any("rest" in c for label, c in made if label == "left-members")
    assert sum(label == "bucket-members" for label, _ in made) == 2


def test_near_copies_join_buckets_once(spark, monkeypatch):
    """The members of a round meet one row of their bucket, once; their components are carried along."""
    plans = []
    monkeypatch.setattr(near_dedup, "stage", lambda df, label="stage": plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or stage(df, label))
    passage = [f"p{i}" for i in range(60)]
    docs = [(i, " ".join([*passage, *(f"x{i % 50}y{k}" for k in range(60 - i // 50))])) for i in range(100)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(table(spark, docs)).collect()}
    assert got == {i: i % 50 for i in range(100)}
    rounds = [plan for label, plan in plans if label == "bucket-members"]
    assert len(rounds) == 2 and all(len(re.findall(r"Join Inner, .*bucket", plan)) == 1 and "LeftOuter" not in plan for plan in rounds)


def test_near_copies_repeated_ids(spark):
    docs = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words here"), (None, "a b c d e f g"), (None, None), (None, None)]
    got = near_dedup.near_groups(table(spark, docs)).collect()
    assert len(got) == 6 and sorted((r.class_size, r.kept) for r in got) == [(1, True)] * 3 + [(3, False)] * 2 + [(3, True)]
    left = near_dedup.drop_near_copies(table(spark, docs).withColumn("class", F.lit(1)))
    assert left.columns == ["doc_id", "text", "class"] and left.count() == 4
    assert near_dedup.near_groups(table(spark, [])).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20)]
    found = dict(map(tuple, components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert found == {1: 1, 2: 1, 3: 1, **dict.fromkeys(range(5, 11), 5)}


# 10


@pytest.mark.parametrize("block,slices", [(4096, 4096), (7, 3)])
def test_exact_copies(spark, block, slices):
    docs = documents()
    got = exact_dedup.exact_groups(table(spark, docs).withColumn("name", F.lit("clash")), block, slices).collect()
    same = {}
    for i, t in docs:
        same.setdefault(t or "", []).append(i)
    want = sorted(((i, max((x for x in same[t or ""] if x is not None), default=None), len(same[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == len(same) and all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact_dedup.drop_copies(table(spark, docs).withColumn("at", F.lit(1)), block, slices)
    assert left.columns == ["doc_id", "text", "at"] and left.count() == len(same)


def test_names_differ_for_different_texts(spark):
    texts = ["aab", "aba", "baa", "aa", "a", "", "aabaab", "aabaabaab", "aabaabaab"]
    df = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string").select("row", F.encode("text", "UTF-8").alias("bytes"))
    names = dict(map(tuple, exact_dedup.block_names(df, 2, 2).collect()))
    assert len(set(names.values())) == len(set(texts)) and names[7] == names[8]


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0
