"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots, bytes are summed per slot, and a versioned slot-to-shard map
assigns slots to shards. The first version deals the slots in turn; every run reads the latest version, edits it by
moving slots from full shards to empty ones, and stores the edit as the next version. Records never rehash, so a record
moves only if its slot does.

A record's slot follows from its key and its text, so a key that many records share, or none has, spreads like others.
Records that are equal in both spread by a number of their own; which of them stands where is all one.

Edge cases: null texts count no bytes (only the fixed overhead); null keys hash like any value; repeated rows spread and get
separate places; an empty table yields an empty result and leaves the map as it is; extra columns are ignored. A stored map of
another number of slots is refused, as its records would rehash. One record larger than a shard's share stays whole.
"""

from __future__ import annotations

import bisect
import uuid
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.llm.common import checked_join, shared_dir, stored, table
from basisline.llm.ranks import ranked, with_row_ids

CLOSE = 1000  # loads that differ by less than this part of the mean are equal enough
N_SLOTS = 8192  # fixed for the life of a dataset: what the driver holds is bounded by it


@dataclass(frozen=True)
class SlotMap:
    """Slot-to-shard map: position is the slot, value its shard."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    @staticmethod
    def dealt(n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
        """The first version, before any bytes are known: slots in turn."""
        return SlotMap(0, n_shards, tuple(s % n_shards for s in range(n_slots)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Store this version; one that is stored already is refused, never doubled or replaced."""
        rows = spark.range(0, len(self.shards), 1, 1).select(F.lit(self.n_shards).alias("n_shards"), F.col("id").cast("int").alias("slot"), self.shard_of(F.col("id")).alias("shard"))
        rows.write.mode("error").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """Read one version, by default the latest; None where no map is stored."""
        try:
            maps = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        version = maps.agg(F.max("version")).first()[0] if version is None else version
        rows = sorted(maps.where(F.col("version") == version).select("slot", "shard", "n_shards").collect())  # one row a slot
        return SlotMap(version, rows[0][2], tuple(r[1] for r in rows))

    def shard_of(self, slot: Column) -> Column:
        """Shard of a slot column, by a constant array of bounded size."""
        return F.split(F.lit(",".join(map(str, self.shards))), ",").cast("array<int>")[slot.cast("int")]


def virtual_slot(*parts: Column, n_slots: int = N_SLOTS) -> Column:
    """Slot of a record from what tells it apart."""
    return F.pmod(F.xxhash64(*parts), F.lit(n_slots)).cast("int")


def slotted(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Add virtual_slot to rows (key, text_hash, row): by key and text, and by row too where these repeat."""
    repeated = stored(rows.groupBy("key", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("k"), F.col("text_hash").alias("h")), "repeated-records")
    found = checked_join(rows, repeated.withColumn("twice", F.lit(True)), F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")), "left")
    slot = F.when(F.col("twice"), virtual_slot(F.col("key"), F.col("text_hash"), F.col("row"), n_slots=n_slots)).otherwise(virtual_slot(F.col("key"), F.col("text_hash"), n_slots=n_slots))
    return found.withColumn("virtual_slot", slot).drop("k", "h", "twice", "text_hash")


def record_size(text: Column, overhead: int = 8) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def better(full: list[tuple[int, int]], empty: list[tuple[int, int]], gap: int) -> tuple[tuple[int, int], tuple[int, int] | None] | None:
    """The slot to move from the full to the empty shard and the one to give back for it (None: none), whose sizes differ by
    the most nearly half of the gap; a move comes before an exchange, and None if neither narrows the gap."""
    fits = [x for x in full if 0 < x[0] < gap]
    if fits:
        return min(fits, key=lambda x: (abs(gap - 2 * x[0]), x[1])), None
    back = sorted(empty)
    found = []
    for x in full:
        k = bisect.bisect(back, (x[0] - gap // 2, -1))
        found += [(abs(gap - 2 * (x[0] - y[0])), x, y) for y in back[max(k - 1, 0) : k + 1] if 0 < x[0] - y[0] < gap]
    return min(found)[1:] if found else None


def rebalanced(old: SlotMap, slot_bytes: dict[int, int], n_shards: int | None = None) -> SlotMap:
    """Next version: edit the old map, moving slots from the fullest shard to the emptiest one, or exchanging two of theirs,
    while it helps and the loads differ by more than the mean / CLOSE."""
    n = n_shards or old.n_shards
    shards = [s if s < n else -1 for s in old.shards]
    loads, held = [0] * n, [[] for _ in range(n)]
    homeless = []
    for slot, shard in enumerate(shards):
        size = slot_bytes.get(slot, 0)
        if shard < 0:
            homeless.append((size, slot))
        else:
            loads[shard] += size
            held[shard].append((size, slot))
    for size, slot in sorted(homeless, reverse=True):
        shard = min(range(n), key=lambda s: (loads[s], s))
        shards[slot], loads[shard] = shard, loads[shard] + size
        held[shard].append((size, slot))
    while True:  # every step lowers the sum of the squared loads, so this ends
        order = sorted(range(n), key=lambda s: (loads[s], s))
        if (loads[order[-1]] - loads[order[0]]) * n * CLOSE <= sum(loads):
            break
        # The fullest shard gives to the emptiest that can take, else the emptiest takes from the fullest that can give.
        pairs = [(order[-1], dst) for dst in order[:-1]] + [(src, order[0]) for src in reversed(order[1:-1])]
        steps = ((src, dst, better(held[src], held[dst], loads[src] - loads[dst])) for src, dst in pairs)
        src, dst, step = next((x for x in steps if x[2]), (0, 0, None))
        if step is None:
            break
        for (size, slot), a, b in [(step[0], src, dst)] + ([(step[1], dst, src)] if step[1] else []):
            held[a].remove((size, slot))
            held[b].append((size, slot))
            shards[slot], loads[a], loads[b] = b, loads[a] - size, loads[b] + size
    return replace(old, version=old.version + 1, n_shards=n, shards=tuple(shards))


def bytes_per_slot(records: DataFrame, slot: str = "virtual_slot", size: str = "size") -> DataFrame:
    return records.groupBy(slot).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def shard_documents(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """One row per record: key, size, text_crc32, virtual_slot, shard and a gapless place in the shard.

    The map at `map_path` (a new one by default) is read, rebalanced for these bytes and stored again if that moved a slot.
    Only narrow rows are shuffled, by virtual slot and salt; a slot's first place comes from the bounded per-slot counts, so
    no task ever holds a whole shard or a whole hot slot.
    """
    spark = docs.sparkSession
    rows = with_row_ids(
        docs.select(
            F.col(key).alias("key"),
            record_size(F.col(text)).alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
        ),
        "shard-records",
    )
    rows = stored(slotted(rows, n_slots), "shard-rows")
    sums = {r[0]: (r[1], r[2]) for r in bytes_per_slot(rows).collect()}  # at most n_slots rows
    path = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    old = SlotMap.load(spark, path)
    if old is None:
        old = SlotMap.dealt(n_shards, n_slots)
        old.save(spark, path)
    if len(old.shards) != n_slots:
        raise ValueError(f"the map at {path} has {len(old.shards)} slots, not {n_slots}; a dataset keeps its number of slots")
    slots = rebalanced(old, {s: b for s, (b, _) in sums.items()}, n_shards)
    if slots.shards != old.shards or slots.n_shards != old.n_shards:
        slots.save(spark, path)
    first, filled = [0] * n_slots, [0] * n_shards
    for s in range(n_slots):
        shard = slots.shards[s]
        first[s] = filled[shard]
        filled[shard] += sums.get(s, (0, 0))[1]
    starts = F.split(F.lit(",".join(map(str, first))), ",").cast("array<bigint>")
    placed = ranked(rows, "virtual_slot", {s: n for s, (_, n) in sums.items()})
    return placed.select("key", "size", "text_crc32", "virtual_slot", slots.shard_of(F.col("virtual_slot")).alias("shard"), (starts[F.col("virtual_slot")] + F.col("rank")).alias("place"))


def op3_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
