"""Every stage of the pipeline against brute force on its own input, and the guard of the driver contract."""

from difflib import SequenceMatcher

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from sparcel.llm import queries  # noqa: F401
from sparcel.session import stage
from tests.llm.test_operators import words

SF = "/root/testdata/sf0.001"


def shingles(text):
    w, seen, out = words(text), {}, []
    for k in range(max(len(w) - 4, min(len(w), 1))):
        s = tuple(w[k : k + 5])
        seen[s] = seen.get(s, 0) + 1
        out.append((s, seen[s]))
    return out


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("input", docs)]
    for name, function in cp.STAGES:
        docs = stage(function(spark, docs, SF), "step")
        out.append((name, docs))
    return {name: df.toPandas().sort_values("doc_id").reset_index(drop=True) for name, df in out}


def test_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["quality", "exact dedup", "near dedup", "decontamination", "tokens"]
    for name in ("quality", "exact dedup", "near dedup", "decontamination"):
        assert list(steps[name].columns) == list(steps["input"].columns)


def test_quality(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    kept = set(steps["quality"].doc_id)
    assert sum((d in kept) == (q == 1) for d, q in zip(labels.doc_id, labels.quality)) >= 0.95 * len(labels)
    assert len(kept) < len(steps["input"])


def test_exact(steps):
    last = {}
    for d, t in zip(steps["quality"].doc_id, steps["quality"].text):
        last[t] = max(d, last.get(t, d))
    assert set(steps["exact dedup"].doc_id) == set(last.values())


def test_near(steps):
    docs = steps["exact dedup"]
    sets = [shingles(t) for t in docs.text]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(set(a) & set(b)) >= 0.4 * (len(a) + len(b)):
                m = sum(x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
                if m >= 0.8 * (len(a) + len(b) - m):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    assert set(steps["near dedup"].doc_id) == {docs.doc_id[i] for i in range(len(docs)) if find(i) == i}


def test_decontamination(spark, steps):
    windows = set()
    for text in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text:
        w = words(text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        w = words(text)
        return not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    docs = steps["near dedup"]
    assert set(steps["decontamination"].doc_id) == {d for d, t in zip(docs.doc_id, docs.text) if clean(t)}
    assert len(steps["decontamination"]) < len(docs)


def test_tokens(steps):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = dict(zip(steps["decontamination"].doc_id, steps["decontamination"].text))
    assert set(texts) == set(steps["tokens"].doc_id)
    for d, ids, decoded in zip(*(steps["tokens"][c] for c in ("doc_id", "ids", "decoded"))):
        want = library.encode(texts[d], add_special_tokens=False).ids
        assert list(ids) == want and decoded == library.decode(want, skip_special_tokens=False)


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert {"op1_winnowing_decontamination", "op7_typed_parts_chat", "op10_block_naming_dedup"} <= set(e.oracle_sql())


CLASH = ["row", "__row", "__n", "__h", "__doc", "doc", "__score", "score", "n", "key", "class", "keys"]


def test_odd_documents_pass_the_stages_that_filter(spark):
    """Nulls, empty and repeated texts and ids, and columns with the names used inside: rows come out as they went in."""
    poor = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1"), "doc_id").select("text").limit(3).toPandas().text.tolist()
    rows = [(1, None), (2, ""), (2, ""), (None, poor[0]), (5, poor[0]), (6, poor[1]), (6, poor[1]), (7, poor[2] + " " + "tail word " * 3), (8, "word " * 30_000), (9, None)]
    docs = spark.createDataFrame([(i, t, f"{k}") for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, tag string")
    docs = docs.selectExpr("*", *[f"concat('{c}', tag) AS `{c}`" for c in CLASH]).repartition(3)
    given = {r.tag: tuple(r) for r in docs.collect()}
    left = {}
    for name, function in cp.STAGES[:4]:
        out = stage(function(spark, docs, SF), "odd")
        assert out.columns == docs.columns
        got = out.collect()
        assert all(given[r.tag] == tuple(r) for r in got) and len({r.tag for r in got}) == len(got)
        left[name] = sorted(r.tag for r in got)
    texts = {tag: (r[0], r[1] or "") for tag, r in given.items()}
    last = {}
    for tag, (i, t) in sorted(texts.items()):
        last.setdefault(t, []).append((i if i is not None else -1, tag))
    exact = left["exact dedup"]
    assert len(exact) == len(last) and all(texts[tag][0] == (m if (m := max(i for i, _ in last[texts[tag][1]])) >= 0 else None) for tag in exact)
    assert {"0", "1", "2", "9"} <= set(left["near dedup"]) and len(left["near dedup"]) == 8  # rows without words are no copies of each other
    assert left["decontamination"] == sorted(given)
    tokens = cp.STAGES[4][1](spark, docs, SF)
    assert tokens.count() == len(rows) and tokens.filter("doc_id = 1").first().ids == []


def test_empty_documents_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, function in cp.STAGES:
        assert function(spark, docs, SF).count() == 0
