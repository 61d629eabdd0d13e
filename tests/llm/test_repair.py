"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from sparcel.llm import repair

SHAPE = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """Counts, cost, audit and digest of ordered (turn, role, text) by best-first search over (row, states of the initials)."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    counts = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs))
    # a prefix of initials is (first is s, number of initials behind it modulo 2, any)
    heap, done = [(0, "", 0, "", "")], set()
    while True:
        cost, audit, i, initials, said = heapq.heappop(heap)
        if i == len(rows) and SHAPE.fullmatch(initials):
            return *counts, cost, audit, hashlib.sha256(said[1:].encode()).hexdigest()
        key = (i, len(initials) > 0, initials[:1] == "s", initials[-1:])
        if key in done:
            continue
        done.add(key)

        def go(price, letter, j, initial, line):
            now = initials + initial
            if re.fullmatch(r"s?(ua)*u?", now) and (initial or letter == "D"):
                heapq.heappush(heap, (cost + price, audit + letter, j, now, said + line))

        for role in ("user", "assistant"):
            go(3, "I", i, role[0], f"\n{role}:")
        if i < len(rows):
            _, role, text = rows[i]
            go(4, "D", i + 1, "", "")
            if faults[i] in (None, "truncated"):
                more = 3 if faults[i] else 0
                go(more, "K", i + 1, role[:1] or "?", f"\n{role}:{text}")
                for other in ("user", "assistant"):
                    go(3 + more, "R", i + 1, other[0], f"\n{other}:{text}")


def conversation(rnd, n):
    rows = []
    for i in range(n):
        turn = rnd.choice([i, i, i, i + rnd.randint(0, 3), None])
        rows.append((turn, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u2"]), rnd.choice(["Yes.", "No!", "cut", " ", "", "é?\n", f"text {i}.", f"text {i}", "x" * 50])))
    return rows


def key(row):
    return (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode())


def expected(rows):
    groups = {}
    for conv_id, turn, role, text in rows:
        groups.setdefault(conv_id, []).append((turn, " " if role is None else role, " " if text is None else text))
    return sorted((repr((c, *brute(sorted(r, key=key)))) for c, r in groups.items()))


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_codes_against_search():
    rnd = random.Random(4)
    for _ in range(1500):
        rows = sorted(conversation(rnd, rnd.randint(0, 9)), key=key)
        assert repair.repair_rows(rows) == brute(rows), rows


@pytest.mark.parametrize("limits", [{}, {"most_rows": 3, "segment": 2}, {"most_bytes": 40, "segment": 5}])
def test_repair(spark, limits):
    rnd = random.Random(7)
    rows = [(c, *r) for c in range(60) for r in conversation(rnd, rnd.randint(1, 12))]
    rows += [(None, *r) for r in conversation(rnd, 9)] + [(77, None, None, None), (77, 1, None, "a."), (78, 1, "user", None), (79, 5, "", "x."), (80, 1, "user", "Hi."), (80, 1, "user", "Hi.")]
    rows += [(500, i // 3, ["user", "assistant"][i % 2], f"line {i % 40}" + "." * (i % 3 > 0)) for i in range(400)]
    rows += [(501, None, "user", "the same.")] * 150 + [(502, 3, "user", "long " * 40_000), (502, 4, "assistant", "long." * 40_000)]
    rnd.shuffle(rows)
    found = repair.repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5), **limits)
    assert sorted(repr(tuple(r)) for r in found.collect()) == expected(rows)


def test_odd_tables(spark):
    assert repair.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]
    odd = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as slice", "2 as seq", "3 as _salt", "4 as cost")
    assert [repr(tuple(r)) for r in repair.repair_conversations(odd).collect()] == expected(rows)


def test_damage(spark):
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["A. b! c?", "", None])) for c in [*range(40), None] for t in [*range(6), None]]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind:
            row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            want += [row] * (2 if kind == 3 else 1)
    found = repair.damage(spark.createDataFrame(rows, SCHEMA))
    assert sorted(repr(tuple(r)) for r in found.collect()) == sorted(map(repr, want))
