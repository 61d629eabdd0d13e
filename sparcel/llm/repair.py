"""Cheapest repair of the turn structure of conversations, by checkpointed dynamic programming.

A repaired conversation's role initials match ``(s?(ua)+)?``. Each row is kept, given the role that is due or deleted, and rows
without text may be put in; the cheapest edits are sought, and of these the ASCII-least string of their initials.

Seen from the end, a row turns a vector of costs (one for each of the four states that the initials so far can be in) into the
vector before it. Only vectors at checkpoints are stored, one for each square root of the number of rows; walking
forward, the vectors of a block are computed again from its checkpoint, and at each row the ASCII-least tight edit is taken.

Rows are range-partitioned by conversation and turn, so a conversation of any length spans many tasks. Those that lie inside
one slice are repaired there. Of the first and the last conversation of a slice, and of one too large to hold, the rows go on: they are cut into
segments, which are the blocks of the same scheme on the cluster. Each segment gives the cost of passing it between any two
states, from which follow the vectors at all segment ends; with these each segment walks forward from each state.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparcel.llm import buffers
from sparcel.session import stage

DROP, RENAME, INSERT, STALE = 4, 3, 3, 3  # costs: delete, give another role, put in, keep a truncated row
NEVER = 1 << 40

#: States: nothing yet, after s, after u, after a. Where each initial leads (s, u, a, any other), and the role that is due.
FOLLOW = [{0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2}]
DUE = [2, 2, 3, 2]
NAME = {2: "user", 3: "assistant"}  # by the state that the role leads to
END = (0, 2 * INSERT, INSERT, 0)

#: A row's code is 3 * initial + fault.
INITIALS = {"s": 0, "u": 1, "a": 2}
CLEAN, GONE, CUT_OFF = 0, 1, 2
_SPACE = " \t\n\x0b\x0c\r"


def fault_of(text: str) -> int:
    """Blank rows must go; a row whose last character is no end of a sentence is truncated."""
    seen = text.rstrip(_SPACE)
    return GONE if not seen else CLEAN if seen[-1] in ".!?" else CUT_OFF


@functools.cache
def step_back(after: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """The vector before a row, less its least cost, and that cost."""
    initial, fault = divmod(code, 3)
    costs = [DROP + after[s] for s in range(4)]
    if fault != GONE:
        stale = STALE if fault == CUT_OFF else 0
        for s in range(4):
            costs[s] = min(costs[s], RENAME + stale + after[DUE[s]])
            if initial in FOLLOW[s]:
                costs[s] = min(costs[s], stale + after[FOLLOW[s][initial]])
    for _ in range(3):
        costs = [min(costs[s], INSERT + costs[DUE[s]]) for s in range(4)]
    least = min(costs)
    return tuple(NEVER if c >= NEVER else c - least for c in costs), least


@functools.cache
def walk(after: tuple[int, ...], code: int, state: int) -> tuple[str, int]:
    """The ASCII-least tight edits up to and with a row, and the state behind it."""
    before, shift = step_back(after, code)
    initial, fault = divmod(code, 3)
    stale, letters = STALE if fault == CUT_OFF else 0, ""
    while True:
        cost = before[state] + shift
        if cost == DROP + after[state]:
            return letters + "D", state
        if cost == INSERT + before[DUE[state]] + shift:
            letters, state = letters + "I", DUE[state]
            continue
        if initial in FOLLOW[state] and cost == stale + after[FOLLOW[state][initial]]:
            return letters + "K", FOLLOW[state][initial]
        return letters + "R", DUE[state]


def backward(codes: bytes, end: tuple[int, ...]) -> tuple[list[tuple[int, ...]], int]:
    """Vectors at the checkpoints, first to last, and the least cost at the first row."""
    width = math.isqrt(len(codes)) + 1
    vector, total, kept = end, 0, []
    for i in range(len(codes) - 1, -1, -1):
        if (i + 1) % width == 0 or i == len(codes) - 1:
            kept.append(vector)
        vector, least = step_back(vector, codes[i])
        total += least
    return [*reversed(kept), vector], total


def forward(codes: bytes, kept: list[tuple[int, ...]], state: int) -> tuple[list[str], int]:
    """Edits of each row and the last state; the vectors of one block are computed again at a time."""
    width, edits = math.isqrt(len(codes)) + 1, []
    for block, begin in enumerate(range(0, len(codes), width)):
        part = codes[begin : begin + width]
        vectors = [kept[block]]
        for code in reversed(part[1:]):
            vectors.append(step_back(vectors[-1], code)[0])
        for code, after in zip(part, reversed(vectors)):
            letters, state = walk(after, code, state)
            edits.append(letters)
    return edits, state


def closing(state: int) -> str:
    """Edits behind the last row."""
    return "I" * (END[state] // INSERT)


def lines_of(edits: list[str], rows: list[tuple[str, str]], state: int) -> Iterator[str]:
    """``role:text`` of the rows that the edits leave; ``edits`` may have one string more than ``rows``, for what is put in at the end."""
    for k, letters in enumerate(edits):
        for letter in letters:
            if letter == "I":
                state = DUE[state]
                yield f"{NAME[state]}:"
            elif letter == "R":
                state = DUE[state]
                yield f"{NAME[state]}:{rows[k][1]}"
            elif letter == "K":
                role, text = rows[k]
                state = FOLLOW[state][INITIALS.get(role[:1], 3)]
                yield f"{role}:{text}"


def digest_of(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


@dataclass
class Tally:
    """What is counted along the rows of a conversation or of one segment of it."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first: str | None = None
    last: str | None = None

    def add(self, initial: str, turn: int | None) -> None:
        if self.last is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            self.turns += turn != self.last_turn
            self.last_turn = turn

    def join(self, later: Tally) -> None:
        """Add the tally of the segment behind."""
        seam = 0 if self.last is None else self.last + later.first not in ("su", "ua", "au")
        both = later.first_turn is not None and later.first_turn == self.last_turn
        self.blank, self.duplicate, self.truncated = self.blank + later.blank, self.duplicate + later.duplicate, self.truncated + later.truncated
        self.illegal += later.illegal + seam
        self.turns += later.turns - both
        self.first_turn = later.first_turn if self.first_turn is None else self.first_turn
        self.last_turn = self.last_turn if later.last_turn is None else later.last_turn
        self.first, self.last = later.first if self.first is None else self.first, later.last

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"
_OPEN = "slice int, seq bigint, turn bigint, role string, text string, code int, seen binary"


def repair_rows(rows: list[tuple[int | None, str, str]]) -> tuple:
    """Counts, audit and digest of one conversation, given as (turn, role, text) in order."""
    tally, codes, seen = Tally(), bytearray(), set()
    for turn, role, text in rows:
        fault = fault_of(text)
        if fault == GONE:
            tally.blank += 1
        elif (role, text) in seen:
            fault = GONE
            tally.duplicate += 1
        elif fault == CUT_OFF:
            tally.truncated += 1
        seen.add((role, text))
        tally.add(role[:1], turn)
        codes.append(3 * INITIALS.get(role[:1], 3) + fault)
    kept, total = backward(bytes(codes), END)
    edits, state = forward(bytes(codes), kept, 0)
    edits.append(closing(state))
    said = "\n".join(lines_of(edits, [r[1:] for r in rows], 0))
    return tally.gaps, tally.blank, tally.duplicate, tally.truncated, tally.illegal, total + kept[-1][0], "".join(edits), hashlib.sha256(said.encode()).hexdigest()


@dataclass
class _Slice:
    """Collects the rows of one slice: finished conversations, and rows that others must see."""

    number: int
    most_rows: int
    most_bytes: int
    seq: int = 0
    size: int = 0
    opened: bool = True
    held: list[tuple] = field(default_factory=list)
    done: list[tuple] = field(default_factory=list)
    passed: list[tuple] = field(default_factory=list)

    def let_go(self, conv_id) -> None:
        for turn, role, text in self.held:
            code = 3 * INITIALS.get(role[:1], 3) + fault_of(text)
            self.passed.append((conv_id, self.number, self.seq, turn, role, text, code, digest_of(role, text)))
            self.seq += 1
        self.held, self.size = [], 0

    def add(self, conv_id, turn, role, text) -> None:
        self.held.append((turn, role, text))
        self.size += len(text)
        if len(self.held) > self.most_rows or self.size > self.most_bytes:
            self.opened = True
        if self.opened and self.size > self.most_bytes // 8:
            self.let_go(conv_id)

    def finish(self, conv_id, last: bool = False) -> None:
        if self.opened or last:
            self.let_go(conv_id)
        else:
            self.done.append((conv_id, *repair_rows(self.held)))
            self.held, self.size = [], 0
        self.opened = False


def _sorted_slices(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Finished conversations (``slice`` is null) and the rows of the others, in slices of the whole order."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *(c.split(" ")[0] for c in f"{_RESULT}, {_OPEN}".split(", "))]
    n = len(_RESULT.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found, nothing, now = _Slice(TaskContext.get().partitionId(), most_rows, most_bytes), object(), None
        schema = None

        def batch_of() -> pa.RecordBatch:
            lines = [(*d, *[None] * 7) for d in found.done] + [(p[0], *[None] * n, *p[1:]) for p in found.passed]
            found.done, found.passed = [], []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in lines], t) for k, t in enumerate(schema)], names=names)

        now = nothing
        for batch in batches:
            schema = [batch.schema.field(0).type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary()]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now:
                    if now is not nothing:
                        found.finish(now)
                    now = row[0]
                found.add(*row)
            yield batch_of()
        if now is not nothing:
            found.finish(now, last=True)
            yield batch_of()

    # the last key splits even rows that are alike in everything
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_salt")]
    ranged = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")
    return ranged.mapInArrow(run, f"conv_id {kind}, {_RESULT}, {_OPEN}")


_TALLY = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, first_turn bigint, last_turn bigint, first string, last string"
_SPAN = ["slice", "at"]


def _segments(rows: DataFrame, kind: str, length: int) -> DataFrame:
    """One row per segment of at most ``length`` rows: its codes, tallies and the costs of passing it."""
    mine = F.struct("slice", "seq")
    first = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("seen").alias("_seen")).agg(F.min(mine).alias("_first"))
    marked = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("seen") == F.col("_seen"))).select(
        "conv_id", "slice", "seq", "turn", F.substring("role", 1, 1).alias("initial"), "code", (F.col("_first") < mine).alias("again"), F.expr(f"seq div {length}").alias("part")
    )

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by("seq")
        tally, codes = Tally(), bytearray()
        for turn, initial, code, again in zip(*(order.column(c).to_pylist() for c in ("turn", "initial", "code", "again"))):
            fault = code % 3
            if fault == GONE:
                tally.blank += 1
            elif again:
                code, tally.duplicate = code - fault + GONE, tally.duplicate + 1
            elif fault == CUT_OFF:
                tally.truncated += 1
            tally.add(initial, turn)
            codes.append(code)
        passing = []
        for leave in range(4):
            kept, total = backward(bytes(codes), tuple(0 if s == leave else NEVER for s in range(4)))
            passing += [NEVER if c >= NEVER else c + total for c in kept[-1]]
        values = [order.column("conv_id")[0].as_py(), order.column("slice")[0].as_py(), order.column("seq")[0].as_py(), bytes(codes), passing, *vars(tally).values()]
        types = [order.schema.field("conv_id").type, pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 7, pa.string(), pa.string()]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["conv_id", *_SPAN, "codes", "passing", *(c.split(" ")[0] for c in _TALLY.split(", "))])

    schema = f"conv_id {kind}, slice int, at bigint, codes binary, passing array<bigint>, {_TALLY}"
    return stage(marked.groupBy("conv_id", "slice", "part").applyInArrow(run, schema), "segments")


def _ends(segments: DataFrame, kind: str) -> DataFrame:
    """The vector at the end of each segment; one conversation's segments are a row per so many thousand rows of it."""

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by([("slice", "ascending"), ("at", "ascending")])
        vector, found = list(END), []
        for passing in reversed(order.column("passing").to_pylist()):
            found.append(vector)
            vector = [min(passing[4 * leave + s] + found[-1][leave] for leave in range(4)) for s in range(4)]
        return pa.Table.from_arrays([order.column("slice"), order.column("at"), pa.array(reversed(found), pa.list_(pa.int64())), pa.array([vector[0]] * len(found), pa.int64())], names=[*_SPAN, "end", "cost"])

    return segments.select("conv_id", *_SPAN, "passing").groupBy("conv_id").applyInArrow(run, "slice int, at bigint, end array<bigint>, cost bigint")


def _walks(segments: DataFrame, ends: DataFrame, kind: str) -> DataFrame:
    """Edits of each segment from each of the four states, rows parted by commas, and where they lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways = []
            for codes, end in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                least = min(end)
                kept, _ = backward(codes, tuple(c - least for c in end))
                ways.append([(",".join(edits), state) for edits, state in (forward(codes, kept, s) for s in range(4))])
            columns = [*batch.columns[:3], batch.column(5), pa.array([[e for e, _ in w] for w in ways], pa.list_(pa.string())), pa.array([[s for _, s in w] for w in ways], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", *_SPAN, "cost", "edits", "leads"])

    given = segments.select("conv_id", *_SPAN, "codes").join(ends, _SPAN).select("conv_id", *_SPAN, "codes", "end", "cost")
    return stage(given.mapInArrow(run, f"conv_id {kind}, slice int, at bigint, cost bigint, edits array<string>, leads array<int>"), "walks")


def _chains(segments: DataFrame, walks: DataFrame, kind: str) -> DataFrame:
    """The state before each segment, and on the last one the conversation's counts."""
    names = [c.split(" ")[0] for c in _TALLY.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by([("slice", "ascending"), ("at", "ascending")])
        state, starts, tally = 0, [], Tally()
        for row in order.select(["leads", *names]).to_pylist():
            starts.append(state)
            state = row.pop("leads")[state]
            tally.join(Tally(**row))
        last = [None] * (len(starts) - 1)
        counts = [tally.gaps, tally.blank, tally.duplicate, tally.truncated, tally.illegal]
        columns = [order.column("slice"), order.column("at"), pa.array(starts, pa.int32()), pa.array([*last, closing(state)], pa.string()), *(pa.array([*last, c], pa.int64()) for c in counts)]
        return pa.Table.from_arrays(columns, names=[*_SPAN, "state", "closing", *COUNTS[:5]])

    given = segments.drop("codes", "passing").join(walks.select(*_SPAN, "leads"), _SPAN)
    return given.groupBy("conv_id").applyInArrow(run, f"slice int, at bigint, state int, closing string, {', '.join(f'{c} bigint' for c in COUNTS[:5])}")


def _digests(rows: DataFrame, audits: DataFrame, kind: str, length: int) -> DataFrame:
    """Digest of the repaired rows of each conversation, read in order as a stream."""

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for role, text, letters, state in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 6))):
                said.append("".join(f"{line}\n" for line in lines_of([letters], [(role, text)], state)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(said, pa.string())], names=["conv_id", "slice", "seq", "said"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edits of single rows, each with the state before it."""
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for number, at, edits, end, codes, state in zip(*(c.to_pylist() for c in batch.columns)):
                for k, (letters, code) in enumerate(zip(edits.split(","), codes)):
                    # what is put in behind the conversation's last row goes with that row
                    for column, value in zip(out, (number, at + k, letters + (end or "" if k == len(codes) - 1 else ""), state)):
                        column.append(value)
                    for letter in letters:
                        state = state if letter == "D" else FOLLOW[state][code // 3] if letter == "K" else DUE[state]
                if len(out[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["slice", "seq", "letters", "state"])
                    out = [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.string(), pa.int32()))], names=["slice", "seq", "letters", "state"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        now, digest, first, kind_of = nothing, None, True, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind_of), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            kind_of = batch.schema.field(0).type
            for conv_id, said in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if conv_id != now:
                    if now is not nothing:
                        yield result()
                    now, digest, first = conv_id, hashlib.sha256(), True
                if said:
                    digest.update((said[:-1] if first else "\n" + said[:-1]).encode())
                    first = False
        if now is not nothing:
            yield result()

    single = audits.select("slice", "at", "chosen", "closing", "codes", "state").mapInArrow(states, "slice int, seq bigint, letters string, state int")
    said = rows.select("conv_id", "slice", "seq", "role", "text").join(single, ["slice", "seq"]).select("conv_id", "slice", "seq", "role", "text", "letters", "state")
    said = said.mapInArrow(edit, f"conv_id {kind}, slice int, seq bigint, said string")
    return said.repartition("conv_id").sortWithinPartitions("conv_id", "slice", "seq").mapInArrow(read, f"conv_id {kind}, repaired_sha256 string")


def repair_conversations(rows: DataFrame, most_rows: int = 20_000, most_bytes: int = 8 << 20, segment: int = 65_536) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn, null turns first; rows of the same turn by role and text. A null role or text counts as one space, a null conv_id is
    a conversation of its own. A row's initial is the first character of its role; an empty role has none and fits nowhere. Repeated rows
    are duplicates. An empty table gives no rows; further columns are not looked at. Conversations of more than ``most_rows`` rows or
    ``most_bytes`` characters are repaired in segments of ``segment`` rows; a conversation's digest is one stream, its audit one string.
    """
    buffers.bounded_batches(rows.sparkSession)
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    kind = given.schema["conv_id"].dataType.simpleString()
    sliced = stage(_sorted_slices(given, most_rows, most_bytes), "slices")
    finished = sliced.filter("slice is null").select("conv_id", *COUNTS, "audit", "repaired_sha256")
    open_rows = sliced.filter("slice is not null").select("conv_id", *(c.split(" ")[0] for c in _OPEN.split(", ")))
    segments = _segments(open_rows, kind, segment)
    walks = _walks(segments, _ends(segments, kind), kind)
    chained = walks.join(_chains(segments, walks, kind), _SPAN).join(segments.select(*_SPAN, "codes"), _SPAN)
    audits = stage(chained.withColumn("chosen", F.col("edits")[F.col("state")]).drop("edits", "leads"), "audits")
    parts = F.array_sort(F.collect_list(F.struct("slice", "at", F.concat(F.translate("chosen", ",", ""), F.coalesce("closing", F.lit(""))).alias("edits"))))
    whole = audits.groupBy("conv_id").agg(
        *[F.max(c).alias(c) for c in COUNTS], F.array_join(F.transform(parts, lambda p: p["edits"]), "").alias("audit")
    )
    digests = _digests(open_rows, audits, kind, segment).withColumnRenamed("conv_id", "_conv")
    late = whole.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    return finished.unionByName(late)


def damage(rows: DataFrame) -> DataFrame:
    """The damage that the query asks for: by the checksum of conversation and turn a row is dropped, emptied, stripped of its sentence
    ends, repeated or given to the user. Nulls count as one space."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat_ws(":", *said).cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return (
        rows.withColumn("_kind", kind)
        .filter("_kind <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(role).alias("role"),
            F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
            F.explode(F.sequence(F.lit(0), F.when(F.col("_kind") == 3, 1).otherwise(0))).alias("_copy"),
        )
        .drop("_copy")
    )
