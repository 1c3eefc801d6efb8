"""Repair of conversation structure as a shortest path with small whole costs.

A conversation's rows and the roles written so far span a graph: its nodes are (rows consumed, state of the grammar
`(s?(ua)+)?` over role initials), its arcs the edits Keep, Rerole, Delete and Insert with costs 0 to 3. Dial's algorithm
settles the nodes from the goal backwards, out of one bucket for each distance instead of a heap. An arc is tight when the
distance of its node is its cost plus the distance behind it; a walk from the start that always takes the tight arc of the
ASCII-least initial (Delete, Insert, Keep, Rerole) is the cheapest repair and, of equally cheap ones, the one whose audit is
least, because a state and an initial lead to one node only.

Conversations of at most SEGMENT rows are repaired whole, one shuffle by conversation. Longer ones are sorted over all
partitions and cut into segments: every segment's distances from each state to each state, their combination from the last
segment to the first, a walk in every segment from each state it can be entered in, and one pass that strings the pieces
together. No task holds more than a segment, or one short row for each segment; rows that are equal in everything travel as
one row and a count. The audit and the hash of a conversation are single values, so its repaired bytes stream through one
task, piece by piece.

Edge cases: null role or text is one space, also in the key that chooses the damage; null turns come first; rows of one turn
stand in the order of role and text after damage; null conv_id is a conversation like others; a conversation of which every
row is dropped has zeros, an empty audit and the hash of the empty text; a text of blanks is blank; texts may be of any
length; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.llm.common import checked_join, stored, table
from basisline.llm.grouped import runs

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1  # added for a row that ends in the middle and stays
SEGMENT_BITS = 11
SEGMENT = 1 << SEGMENT_BITS  # rows of a conversation in one graph

# States: nothing written, system, user, assistant. Which role may follow, where an initial leads, where writing may end.
FREE = ("user", "user", "assistant", "user")
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WRITTEN = (2, 2, 3, 2)  # state after the one role of FREE
GOALS = (0, 3)
LEGAL = {"su", "ua", "au"}
INF = 1 << 60

NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]")


@dataclass
class Turn:
    """A row after damage; `forced`: it must go; `copies`: equal rows right behind it, which must go too."""

    role: str
    text: str
    forced: bool
    truncated: bool
    copies: int = 0

    @property
    def initial(self) -> str:
        return self.role[:1]


def is_blank(text: str) -> bool:
    return NOT_BLANK.search(text) is None


def is_truncated(text: str) -> bool:
    """Is the last character that is no blank something else than an end of a sentence?"""
    return text.rstrip(" \t\n\v\f\r")[-1:] not in (".", "!", "?")


def distances(turns: Sequence[Turn], goals: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Dial: for every node (place, state) its distance to the end, where state q costs what `goals` gives for it.

    Buckets hold nodes by distance and are emptied in order; an arc of cost 0 puts its node into the bucket being emptied.
    Copies are left out: they cost the same on every path.
    """
    n = len(turns)
    found = [[INF] * 4 for _ in range(n + 1)]
    buckets: list[list[tuple[int, int]]] = []

    def reach(i: int, q: int, d: int) -> None:
        if d < found[i][q]:
            found[i][q] = d
            while len(buckets) <= d:
                buckets.append([])
            buckets[d].append((i, q))

    for q, d in goals:
        reach(n, q, d)
    at = 0
    while at < len(buckets):
        while buckets[at]:
            i, q = buckets[at].pop()
            if found[i][q] < at:
                continue  # settled at a lower distance
            for p in range(4):  # a role was inserted
                if WRITTEN[p] == q:
                    reach(i, p, at + INSERT)
            if i:
                row = turns[i - 1]
                reach(i - 1, q, at + DELETE)
                if not row.forced:
                    stays = TRUNCATED if row.truncated else 0
                    for p in range(4):
                        if STEP[p].get(row.initial) == q:
                            reach(i - 1, p, at + KEEP + stays)
                        if WRITTEN[p] == q:
                            reach(i - 1, p, at + REROLE + stays)
        at += 1
    return found


def walk(turns: Sequence[Turn], found: list[list[int]], goals: Sequence[tuple[int, int]], state: int) -> tuple[str, list[tuple[str, str]], int]:
    """Audit, repaired (role, text) and last state of the tight walk from `state` whose audit is least.

    It ends behind the last row as soon as a goal's distance is met: inserts that could stand there too are left to what
    follows, where a deletion may come first.
    """
    audit, rows, i, q = [], [], 0, state
    while True:
        d = found[i][q]
        if i == len(turns) and (q, d) in goals:
            return "".join(audit), rows, q
        row = turns[i] if i < len(turns) else None
        stays = TRUNCATED if row is not None and row.truncated else 0
        if row is not None and d == DELETE + found[i + 1][q]:
            audit.append("D")
        elif d == INSERT + found[i][WRITTEN[q]]:
            audit.append("I")
            rows.append((FREE[q], ""))
            q = WRITTEN[q]
            continue
        elif row is not None and not row.forced and (p := STEP[q].get(row.initial)) is not None and d == KEEP + stays + found[i + 1][p]:
            audit.append("K")
            rows.append((row.role, row.text))
            q = p
        else:
            audit.append("R")
            rows.append((FREE[q], row.text))
            q = WRITTEN[q]
        audit.append("D" * row.copies)
        i += 1


def written(rows: Iterable[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


def illegal_pairs(turns: Sequence[Turn]) -> int:
    return sum(a.initial + b.initial not in LEGAL for a, b in pairwise(turns)) + sum(t.copies for t in turns)


def turns_of(roles: Sequence[str], texts: Sequence[str], copies: Sequence[int], repeated: Sequence[bool] | None = None) -> tuple[list[Turn], int, int, int]:
    """Rows in order, and how many are blank, duplicate and truncated; `repeated` tells rows seen before, else it is found."""
    seen: set[tuple[str, str]] = set()
    out, blank, duplicate, truncated = [], 0, 0, 0
    for k, (role, text, more) in enumerate(zip(roles, texts, copies, strict=True)):
        empty = is_blank(text)
        again = not empty and (repeated[k] if repeated is not None else (role, text) in seen)
        ends = not empty and not again and is_truncated(text)
        if not empty and repeated is None:
            seen.add((role, text))
        blank += (1 + more) * empty
        duplicate += 0 if empty else again + more
        truncated += ends
        out.append(Turn(role, text, empty or again, ends, more))
    return out, blank, duplicate, truncated


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text and `times`, how often the row stands after the damage (0: dropped)."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    hit = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return conversations.select("conv_id", "turn", text.alias("text"), role.alias("role"), hit.alias("hit")).select(
        "conv_id",
        "turn",
        F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).alias("times"),
    )


def grouping() -> list[Column]:
    """conv_id as two columns without nulls, by which rows are dealt, sorted and told apart."""
    return [F.col("conv_id").isNull().alias("g1"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("g2")]


RESULT = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _batch(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(like), like, strict=True)], schema=like)


def repaired_whole(rows: DataFrame) -> DataFrame:
    """Results of conversations that fit into one graph: all rows of each in one task, streamed conversation by conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in runs(batches, 2, 2048):
            ids, turn, role, text, times = (t.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "times"))
            out: list[tuple] = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                at = [k for k in range(lo, hi) if times[k]]
                turns, *faults = turns_of([role[k] for k in at], [text[k] for k in at], [times[k] - 1 for k in at])
                known = {turn[k] for k in at} - {None}
                goals = [(q, 0) for q in GOALS]
                found = distances(turns, goals)
                audit, left, _ = walk(turns, found, goals, 0)
                cost = found[0][0] + DELETE * sum(x.copies for x in turns)
                gaps = max(known) - min(known) + 1 - len(known) if known else 0
                out.append((ids[lo], gaps, *faults, illegal_pairs(turns), cost, audit, hashlib.sha256(written(left).encode()).hexdigest()))
            long, short = pa.int64(), pa.string()
            names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
            yield _batch(out, pa.schema(list(zip(names, (t.schema.field("conv_id").type, *[long] * 6, short, short), strict=True))))

    dealt = rows.select(*grouping(), "conv_id", "turn", "role", "text", "times").repartition("g1", "g2")
    return dealt.sortWithinPartitions("g1", "g2", F.asc_nulls_first("turn"), "role", "text").mapInArrow(run, RESULT.format(kind=kind))


def ordered(rows: DataFrame) -> DataFrame:
    """Rows of long conversations in one order over all partitions: pos, its segment, copies, and whether they repeat others.

    Equal rows are counted first, so no sort key is hot; a conversation of any length is cut wherever partitions end.
    """
    once = rows.where("times > 0").groupBy("conv_id", "turn", "role", "text").agg((F.sum("times") - 1).cast("int").alias("copies")).select(*grouping(), "*")
    order = ["g1", "g2", F.asc_nulls_first("turn"), "role", "text"]
    placed = once.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    placed = stored(placed.withColumns({"segment": F.shiftright("pos", SEGMENT_BITS), "said": said}), "long-rows")
    firsts = stored(placed.groupBy("g1", "g2", "said").agg(F.min("pos").alias("first")), "long-firsts")
    return stored(checked_join(placed, firsts, ["g1", "g2", "said"], "inner").withColumn("repeated", F.col("pos") > F.col("first")).drop("said", "first"), "long-turns")


def by_segment(rows: DataFrame, *more: str) -> DataFrame:
    keys = ["g1", "g2", "segment"]
    return rows.select(*keys, "role", "text", "copies", "repeated", *more, "pos").repartition(*keys).sortWithinPartitions(*keys, "pos")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[Turn], tuple, dict]]:
    """Key, rows, fault counts and the first row's further columns of every segment."""
    for t, bounds in runs(batches, 3, 2048):
        cols = {c: t.column(c).to_pylist() for c in t.column_names}
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            turns, *faults = turns_of(cols["role"][lo:hi], cols["text"][lo:hi], cols["copies"][lo:hi], cols["repeated"][lo:hi])
            yield (cols["g1"][lo], cols["g2"][lo], cols["segment"][lo]), turns, tuple(faults), {c: v[lo] for c, v in cols.items()}


def segment_costs(rows: DataFrame) -> DataFrame:
    """For every segment its cost from each state (row) to each state (column), as 16 numbers."""
    schema = pa.schema([("g1", pa.bool_()), ("g2", pa.string()), ("segment", pa.int64()), ("costs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, turns, _, _ in _segments(batches):
            to = [distances(turns, [(q, 0)])[0] for q in range(4)]
            yield _batch([(*key, [to[q][p] for p in range(4) for q in range(4)])], schema)

    return by_segment(rows).mapInArrow(run, "g1 boolean, g2 string, segment long, costs array<bigint>")


def boundaries(costs: DataFrame) -> DataFrame:
    """For every segment the distances to the goal behind it, less the least of them, and the cost from the conversation's start."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, behind, out = rows.sort_values("segment", ascending=False), [0 if q in GOALS else INF for q in range(4)], []
        for r in rows.itertuples():
            least = min(behind)
            ends = [min(d - least, INF) if d < INF else INF for d in behind]
            behind = [min(min(int(r.costs[4 * p + q]) + behind[q] for q in range(4)), INF) for p in range(4)]
            out.append((r.g1, r.g2, r.segment, ends, behind[0]))
        return pd.DataFrame(out, columns=["g1", "g2", "segment", "ends", "cost"])

    return costs.groupBy("g1", "g2").applyInPandas(run, "g1 boolean, g2 string, segment long, ends array<bigint>, cost long")


def segment_walks(rows: DataFrame) -> DataFrame:
    """For every segment and state it is entered in: audit, repaired text and last state; fault counts and outer initials."""
    names = ("g1", "g2", "segment", "state", "last", "audit", "repaired", "some", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "copies", "cost")
    kinds = (pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, turns, faults, own in _segments(batches):
            goals, out = [(q, d) for q, d in enumerate(own["ends"]) if d < INF], []
            found = distances(turns, goals)
            for state in range(4):
                audit, left, last = walk(turns, found, goals, state)
                out.append((*key, state, last, audit, written(left), bool(left), *faults, illegal_pairs(turns), turns[0].initial, turns[-1].initial, sum(x.copies for x in turns), own["cost"]))
            yield _batch(out, pa.schema(list(zip(names, kinds, strict=True))))

    schema = "g1 boolean, g2 string, segment long, state int, last int, audit string, repaired string, some boolean, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, copies long, cost long"
    return by_segment(rows, "ends", "cost").mapInArrow(run, schema)


def strung(walks: DataFrame) -> DataFrame:
    """The walks of each conversation strung together, streamed: g1, g2 and the results but gaps."""
    schema = pa.schema([("g1", pa.bool_()), ("g2", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if (r["g1"], r["g2"]) != key:
                    if key is not None:
                        done.append((*key, *counts, "".join(audit), digest.hexdigest()))
                    key, state, segment, initial, any_row = (r["g1"], r["g2"]), 0, None, "", False
                    counts, audit, digest = [0, 0, 0, 0, r["cost"]], [], hashlib.sha256()
                if r["state"] != state or r["segment"] == segment:
                    continue
                segment, state = r["segment"], r["last"]
                counts = [a + b for a, b in zip(counts, (r["blank"], r["duplicate"], r["truncated"], r["illegal"], DELETE * r["copies"]), strict=True)]
                counts[3] += len(audit) > 0 and initial + r["first_initial"] not in LEGAL
                initial = r["last_initial"]
                audit.append(r["audit"])
                if r["some"]:
                    digest.update((b"\n" if any_row else b"") + r["repaired"].encode())
                    any_row = True
            yield _batch(done, schema)
        if key is not None:
            yield _batch([(*key, *counts, "".join(audit), digest.hexdigest())], schema)

    dealt = walks.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "segment", "state")
    return dealt.mapInArrow(run, "g1 boolean, g2 string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired_long(rows: DataFrame) -> DataFrame:
    """Results of conversations of any length, segment by segment."""
    turns = ordered(rows)
    ends = stored(boundaries(segment_costs(turns)), "segment-ends")
    start = F.min_by("cost", "segment").alias("cost")  # the cost from the first segment on
    totals = stored(ends.groupBy("g1", "g2").agg(start), "long-costs")
    ends = stored(checked_join(ends.drop("cost"), totals, ["g1", "g2"], "inner"), "segment-costs")
    walks = stored(segment_walks(checked_join(turns, ends, ["g1", "g2", "segment"], "inner")), "segment-walks")
    known = rows.where("times > 0").select(*grouping(), "turn").groupBy("g1", "g2").agg((F.max("turn") - F.min("turn") + 1).alias("span"), F.count_distinct("turn").alias("turns"))
    result = strung(walks).join(known, ["g1", "g2"]).withColumn("gaps", F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).cast("long"))
    ids = rows.select(*grouping(), "conv_id").distinct()
    none = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    none |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))}
    return ids.join(result, ["g1", "g2"], "left").withColumns(none).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each conversation of rows conv_id, turn, role, text, times: its faults and its cheapest repair."""
    keyed = rows.select(*grouping(), "*")
    long = stored(keyed.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > segment).select("g1", "g2"), "long-conversations")
    if long.isEmpty():
        return repaired_whole(rows)
    short = checked_join(keyed, long, ["g1", "g2"], "left_anti").select(rows.columns)
    return repaired_whole(short).unionByName(repaired_long(stored(checked_join(keyed, long, ["g1", "g2"], "left_semi").select(rows.columns), "long")))


def op12_dial_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))
