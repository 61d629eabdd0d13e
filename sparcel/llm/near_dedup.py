"""Near-duplicate classes by order MinHash and banded alignment.

A text is the sequence of its shingles of five words (all its words, if there are fewer), each labelled with how
often it occurred before, so labelled shingles are unique within a text. A sketch takes the three
labelled shingles with the smallest values of one hash function and puts them back into text order; texts share
a bucket if a whole sketch agrees. So shared shingles count, and their order as well.

Two texts are near-duplicates if m labelled shingles can be aligned in order in both and m / (n1 + n2 - m)
is 0.8 or more. Aligned shingles then lie in a band of diagonals around the main one, whose width follows from the
threshold; the longest increasing chain of matches in the band is the alignment.

Classes are the connected components of near-duplicates. Equal word sequences are one text from the start.
The pairs of a bucket are listed only if it has ``SMALL`` members at most, so a member has a bounded
number of them. In a larger bucket all members meet up to three leaders, which belong to the largest
buckets and so are close to the text that the others were made from; together they have what single ones have
lost. What a member has and all leaders lack is its rest. Two members c and d whose rests are disjoint share
no more than the smaller of what each shares with the leaders, which rules most such pairs out; those it
can't are verified at once. All others have a shingle of their rests in
common and meet in a bucket of the next round, for which the smallest shingles of a rest are enough (a
prefix: of at least t common ones, one is among all but the last t - 1). A member hands its rest on once for each
set of leaders, in however many buckets it met them. Rounds go on while large buckets hold several
components, so no link between components is missed, whatever the size of a bucket. Once all large buckets together have
few pairs, as measured by the members of the first round, these are listed as well, which ends the rounds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.llm import buffers
from sparcel.llm.components import components
from sparcel.session import spread, stage

SHINGLE, SIMILARITY, SKETCHES, TAKEN = 5, 0.8, 16, 3

#: Members up to which the pairs of a bucket are listed.
SMALL = 16

#: Leaders of a larger bucket.
LEADERS = 3

#: Pairs for each member of the first round up to which all large buckets are listed at once.
LISTED = 2

#: Members and pairs up to which their ids are broadcast to the texts, which then need not be shuffled.
SENT_MEMBERS, SENT_PAIRS = 1_000_000, 100_000

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def labelled_shingles(hashes: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(values of labelled shingles, first of each text) from word hashes of texts that begin at ``first``."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.concatenate(([0], np.cumsum(count)))
    text = np.repeat(np.arange(len(n)), count)
    at = first[:-1][text] + np.arange(len(text)) - bounds[text]
    sums = buffers.code_sums(hashes | np.uint64(1))
    plain = buffers.span_hash(sums, at, at + np.minimum(size, n)[text])
    # how often the same shingle came before in the same text
    own = buffers.mix(plain + text.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(own, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = own[order[1:]] != own[order[:-1]]
    start = np.flatnonzero(new)
    before = np.empty(len(order), np.int64)
    before[order] = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return buffers.mix(plain + before.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), bounds


def sketches(values: np.ndarray, bounds: np.ndarray, count: int = SKETCHES, taken: int = TAKEN) -> np.ndarray:
    """[text, sketch]: hash of the ``taken`` labelled shingles with the smallest values of each function, in text order.

    All texts must have a shingle; those with fewer than ``taken`` give all they have.
    """
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)
    out = np.empty((len(n), count), np.uint64)
    for t in range(count):
        v = buffers.mix(values ^ np.uint64((t + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        places = np.full((len(n), taken), len(values))
        for k in range(taken):
            least = np.minimum.reduceat(v, bounds[:-1])
            hit = np.flatnonzero((v == least[text]) & (v != _TOP))
            places[text[hit], k] = hit
            v[hit] = _TOP
        places.sort(axis=1)
        chosen = np.append(values, np.uint64(0))[places]
        key = np.full(len(n), t, np.uint64)
        for k in range(taken):
            key = buffers.mix(key * np.uint64(0x9E3779B97F4A7C15) + chosen[:, k])
        out[:, t] = key
    return out


def _sketched(rows: DataFrame) -> DataFrame:
    """(row, doc_id, text) -> row, doc_id, h1, h2 (of the word sequence), n (shingles), keys, shingles; without words n is 0."""
    buffers.bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in buffers.pieces(batch):
                buf, bounds = buffers.text_bytes(piece.column(2))
                lower, starts, ends, first = buffers.words(buf, bounds)
                hashes = buffers.span_hash(buffers.byte_sums(lower), starts, ends)
                whole = [buffers.span_hash(buffers.code_sums(h), first[:-1], first[1:]).view(np.int64) for h in (hashes, buffers.mix(hashes))]
                values, at = labelled_shingles(hashes, first)
                some = np.flatnonzero(np.diff(at))
                keys = np.zeros((piece.num_rows, SKETCHES), np.uint64)
                if len(some):
                    keys[some] = sketches(values, np.append(at[some], at[-1]))
                stored = values.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0), piece.column(1), pa.array(whole[0]), pa.array(whole[1]), pa.array(np.diff(at).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, SKETCHES, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64))),
                        pa.array([stored[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()),
                    ],
                    names=["row", "doc_id", "h1", "h2", "n", "keys", "shingles"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "doc_id", "text").mapInArrow(run, f"row bigint, doc_id {kind}, h1 bigint, h2 bigint, n int, keys array<bigint>, shingles binary")


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> float:
    """Similarity of two sequences of labelled shingles, or 0 if it is below the threshold."""
    _, ia, ib = np.intersect1d(a, b, return_indices=True)
    return _chained(len(a) + len(b), ia, ib, threshold)


def _chained(total: int, ia: np.ndarray, ib: np.ndarray, threshold: float) -> float:
    """Similarity from the places of all matches."""
    band = int((1 - threshold) / (1 + threshold) * total + 1e-9)
    needed = threshold / (1 + threshold) * total - 1e-9
    inside = np.abs(ia - ib) <= band
    ia, ib = ia[inside], ib[inside]
    if len(ia) < needed:
        return 0.0
    chain = ib[np.argsort(ia)]
    m = len(chain)
    if (np.diff(chain) < 0).any():
        tails: list[int] = []
        for x in chain.tolist():
            at = bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        m = len(tails)
    return m / (total - m) if m >= needed else 0.0


def meet(leaders: list[np.ndarray], member: np.ndarray, threshold: float = SIMILARITY) -> tuple[list[bool], int, np.ndarray]:
    """(which leaders are near-duplicates, shingles shared with any of them, prefix of the member's rest)."""
    linked = [aligned(leader, member, threshold) > 0 for leader in leaders]
    rest = np.setdiff1d(member, np.concatenate(leaders))
    common = len(member) - len(rest)
    least = max(int(np.ceil(threshold * len(member) - 1e-9)) - common, 1)
    return linked, common, rest[: max(len(rest) - least + 1, 0)]


def _met(pairs: DataFrame, bodies: DataFrame, several: bool = False) -> DataFrame:
    """(leaders, row) -> leaders (one unless ``several``), row, linked (ids of leaders), common, rest, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"leaders": [], "row": [], "linked": [], "common": [], "rest": []}
            for ids, row, body, texts in zip(*(c.to_pylist() for c in batch.columns)):
                linked, common, rest = meet([np.frombuffer(t, "<u4") for t in texts], np.frombuffer(body, "<u4"))
                for column, value in zip(out.values(), (ids, row, [i for i, yes in zip(ids, linked) if yes], common, rest.view(np.int32))):
                    column.append(value)
            kinds = (pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds)], names=list(out))

    asked = stage(pairs.select("leaders", "row"), "asked-pairs")
    first = asked
    if asked.count() <= SENT_PAIRS:
        # only the texts that are asked for are shuffled, and those of members not at all
        first = F.broadcast(asked)
        bodies = bodies.join(F.broadcast(asked.select(F.explode(F.array_append("leaders", F.col("row"))).alias("row"))), "row", "left_semi")
    both = bodies.select("row", F.col("shingles").alias("body")).join(first, "row")
    if several:  # the texts of each set of leaders are brought together once
        leader = asked.select("leaders").distinct().select("leaders", F.explode("leaders").alias("row")).join(bodies, "row")
        sets = leader.groupBy("leaders").agg(F.sort_array(F.collect_list(F.struct("row", "shingles")))["shingles"].alias("texts"))
        both = both.join(sets, "leaders")
    else:
        both = both.withColumn("l", F.get("leaders", F.lit(0))).join(bodies.select(F.col("row").alias("l"), F.array("shingles").alias("texts")), "l")
    met = both.select("leaders", "row", "body", "texts").mapInArrow(run, "leaders array<bigint>, row bigint, linked array<bigint>, common int, rest array<int>")
    return stage(met, "met-pairs")


def _links(met: DataFrame) -> DataFrame:
    return met.select(F.explode("linked").alias("a"), F.col("row").alias("b"))


def _joined(found: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Components after further links."""
    if links.isEmpty():
        return found
    return components(links if found is None else links.union(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _with_component(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return rows.withColumn("component", F.col("row"))
    return rows.join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))


def _mixed(members: DataFrame) -> DataFrame:
    """Buckets with members of several components."""
    return members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).filter("low <> high").select("bucket", "size")


def _could_link(a: str, b: str) -> Column:
    """Whether texts a and b can be alike if the rests are disjoint."""
    return F.least(f"{a}.common", f"{b}.common") * F.lit(1 + SIMILARITY) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * F.lit(SIMILARITY) - 1e-6


def _linked_texts(texts: DataFrame, shingles: DataFrame) -> DataFrame:
    """(row, n, keys) of different texts and (row, shingles) of these at least -> (node, component) of those that have a near-duplicate."""
    members = texts.select(F.explode(F.array_distinct("keys")).alias("bucket"), "row", "n", F.col("row").alias("component"))
    found = seen = bodies = tried = pending = None
    while True:
        # most buckets have one member or one component: they go before anything else is joined to them
        members = members.join(_mixed(members), "bucket")
        members = stage(members.select("bucket", "row", "n", "component", "size"), "bucket-members")
        held, ahead = members.agg(F.count(F.lit(1)), F.sum(F.when(F.col("size") > SMALL, (F.col("size") - 1) / 2))).first()
        if not held:
            break
        if bodies is None:
            wanted, started = members.select("row").distinct(), held
            wanted = F.broadcast(wanted) if held <= SENT_MEMBERS else wanted
            bodies = stage(shingles.join(wanted, "row", "left_semi"), "bucket-texts")
        last = (ahead or 0) <= LISTED * started
        few = members if last else members.filter(F.col("size") <= SMALL)
        one, other = few.alias("c"), few.alias("d")
        alike = (F.col("c.component") != F.col("d.component")) & (F.least("c.n", "d.n") >= F.greatest("c.n", "d.n") * F.lit(SIMILARITY) - 1e-6)
        listed = one.join(other, (F.col("c.bucket") == F.col("d.bucket")) & (F.col("c.row") < F.col("d.row")) & alike)
        listed = listed.select(F.array("c.row").alias("leaders"), F.col("d.row").alias("row")).distinct()
        checked = _met(listed if tried is None else listed.join(tried, ["leaders", "row"], "left_anti"), bodies)
        tried = checked.select("leaders", "row") if tried is None else tried.union(checked.select("leaders", "row"))
        pending = _links(checked) if pending is None else pending.union(_links(checked))
        if last:
            break
        members = members.filter(F.col("size") > SMALL)
        if seen is not None:
            fresh = members.select("bucket", "row").join(seen, ["bucket", "row"], "left_anti").select("bucket").distinct()
            members = members.join(fresh, "bucket", "left_semi")
        members = stage(members, "large-buckets")
        if members.isEmpty():
            break
        seen = members.select("bucket", "row") if seen is None else seen.union(members.select("bucket", "row"))
        weight = members.groupBy("row").agg(F.sum("size").alias("weight"))
        best = members.select("bucket", "row").join(weight, "row").groupBy("bucket", F.pmod("row", F.lit(LEADERS)).alias("class")).agg(F.max(F.struct("weight", "row")).alias("best"))
        lead = best.groupBy("bucket").agg(F.sort_array(F.collect_list("best.row")).alias("leaders"))
        led = stage(members.join(lead, "bucket").select("bucket", "row", "n", "leaders"), "led-members")
        met = _met(led.select("leaders", "row").distinct(), bodies, several=True)
        # components once a round: what is linked after this shows in the next
        found, pending = _joined(found, pending.union(_links(met).filter("a <> b"))), None
        left = _with_component(led.filter(~F.array_contains("leaders", F.col("row"))), found)
        left = left.join(_mixed(left).select("bucket"), "bucket", "left_semi").join(met.select("leaders", "row", "common"), ["leaders", "row"])
        left = stage(left.select("bucket", "leaders", "row", "n", "component", "common"), "left-members")
        # pairs without a common shingle in their rests that may still be alike
        reach = F.floor(F.col("common") * F.lit((1 + SIMILARITY) / SIMILARITY) - F.col("n") + 1e-6)
        near = left.join(left.groupBy("bucket").agg(F.min("n").alias("low")), "bucket").filter(reach >= F.col("low"))
        near = stage(near.join(_mixed(near).select("bucket"), "bucket", "left_semi"), "near-members")
        c, d = near.alias("c"), near.alias("d")
        odd = c.join(d, (F.col("c.bucket") == F.col("d.bucket")) & (F.col("c.row") < F.col("d.row")) & (F.col("c.component") != F.col("d.component")) & _could_link("c", "d"))
        odd = odd.select(F.array("c.row").alias("leaders"), F.col("d.row").alias("row")).distinct()
        checked = _met(odd.join(tried, ["leaders", "row"], "left_anti"), bodies)
        tried = tried.union(checked.select("leaders", "row"))
        pending = _links(checked)
        # a rest counts once for its leaders, and is dealt out evenly before its shingles are rows; no component changes before the next round
        rests = spread(left.select("leaders", "row", "n", "component").distinct().join(met.select("leaders", "row", "rest"), ["leaders", "row"]), "leaders", "row")
        members = rests.select(F.explode("rest").alias("shingle"), "leaders", "row", "n", "component").select(F.xxhash64("leaders", "shingle").alias("bucket"), "row", "n", "component").distinct()
    found = found if pending is None else _joined(found, pending)
    return texts.sparkSession.createDataFrame([], "node bigint, component bigint") if found is None else found


def _classes(rows: DataFrame) -> DataFrame:
    """(row, doc_id, text) -> (row, doc_id, class): rows without a partner have their own row as class."""
    sketched = stage(_sketched(rows), "sketches")
    same = stage(sketched.filter("n > 0").groupBy("h1", "h2").agg(F.min("row").alias("first")), "equal-texts")
    # by a join on narrow rows, the shingles of a text do not move
    firsts = sketched.select("row", "n", "keys").join(same.select(F.col("first").alias("row")), "row", "left_semi")
    found = _linked_texts(firsts, sketched.select("row", "shingles"))
    owner = sketched.select("row", "doc_id", "h1", "h2", "n").join(same, ["h1", "h2"], "left").select("row", "doc_id", F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("row")).alias("first"))
    return owner.join(found.withColumnRenamed("node", "first"), "first", "left").select("row", "doc_id", F.coalesce("component", "first").alias("class"))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, class_size, kept.

    ``class_id`` is the smallest doc_id of the class, whose row is the one that is kept (of rows that repeat it, one).
    Rows without words (null or empty texts) are each a class of their own, as are texts without a
    near-duplicate. A null doc_id is larger than any other. No rows in, no rows out. Further columns are not looked at.
    """
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())  # frozen where the sketches are written
    return _groups(rows).select("doc_id", "class_id", "class_size", "kept")


def _groups(rows: DataFrame) -> DataFrame:
    member = stage(_classes(rows), "near-members")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    classes = member.groupBy("class").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("class_size"))
    return member.join(classes, "class").select("row", "doc_id", F.col("best.id").alias("class_id"), "class_size", (F.col("best.row") == F.col("row")).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class; all columns stay as they are, whatever their names."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")  # one column: no name of a field clashes
    kept = stage(docs.select(whole, F.monotonically_increasing_id().alias("row")), "near-documents")
    gone = _groups(kept.select("row", "doc.doc_id", "doc.text")).filter("not kept").select("row")
    return kept.join(gone, "row", "left_anti").select("doc.*")
