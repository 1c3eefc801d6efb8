"""Near-duplicate components by circulant MinHash: two permutations give all signature values.

Shingles are numbers below 2**64. The first permutation scatters them once; the second, shifted circularly by k places,
gives value k of the signature: the least of `second(first(v) - k)` over the shingles v of a text. One pass over the
scattered shingles thus gives any number of values from two permutations.

1. Texts with the same shingle set are one node (copies are never expanded).
2. Bands of the signature put nodes into buckets. In every bucket one node is the pivot (the one whose buckets are fullest,
   so the common original of many versions); every other node of the bucket is compared with it on whole sets. Large groups
   of near copies join here at the cost of one comparison a node and bucket, never by all their pairs.
3. Buckets whose nodes are not in one component yet are dealt out in blocks. Pairs of different components are compared in
   the first band they share, by signature first (a linked pair fails with probability 1e-9), and exactly on whole sets.
4. Components of all true links are the result.

A pair at the threshold shares no band with probability 7e-8, so a link may be lost with about that chance if no other path
joins its texts.

Edge cases: texts of fewer than five words are one shingle of all their words; null, empty and wordless texts have no shingle
and are linked to nothing; repeated rows are copies of one node and all are returned; a null doc_id counts only where its
component has no other, and is kept there; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.llm import shingles as sh
from basisline.llm.common import checked_join, stored, table
from basisline.llm.components import components
from basisline.llm.grouped import runs
from basisline.llm.near_duplicates import block_pairs, common_counts, forest, in_blocks

LINK, OF = 85, 100  # texts are linked when OF * intersection >= LINK * union
ROWS, BANDS = 5, 28  # a pair at 0.85 shares no band with probability (1 - 0.85**5)**28 = 7e-8
VALUES = ROWS * BANDS
PIVOT_BLOCK = 64  # nodes compared with one pivot in a group
MISS = 1e-9  # chance that a linked pair fails the comparison of signatures

_FIRST = np.uint64(0xD6E8FEB86659FD93)
_SECOND = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_PLACES = np.random.default_rng(20250131).integers(0, 1 << 63, ROWS, dtype="uint64") * np.uint64(2) + np.uint64(1)
_SHIFTS = np.arange(VALUES, dtype="uint64") * _SECOND[0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Signature values (uint32) of a non-empty set of 64-bit shingles.

    Both permutations are products of odd multiplications and xor-shifts, which are one-to-one on 64 bits. The shift by k
    places is taken inside the second one's first multiplication: (x - k) * c = x * c - k * c.
    """
    best = np.full(VALUES, np.iinfo("uint64").max, "uint64")
    scattered = sh.mix(shingles * _FIRST) * _SECOND[0]
    for i in range(0, len(scattered), 1024):
        shifted = scattered[i : i + 1024] - _SHIFTS[:, None]
        shifted ^= shifted >> np.uint64(32)
        shifted *= _SECOND[1]
        np.minimum(best, shifted.min(axis=1), out=best)
    return (best >> np.uint64(32)).astype("uint32")


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature; the band's number is part of it."""
    mixed = sh.mix((values.reshape(BANDS, ROWS).astype("uint64") * _PLACES).sum(axis=1, dtype="uint64"))
    return sh.mix(mixed + np.arange(1, BANDS + 1, dtype="uint64") * _FIRST).view("int64")


@lru_cache(maxsize=4)
def least_matches(similarity: float = LINK / OF, miss: float = MISS) -> int:
    """The most matching values that a pair of this similarity falls short of with at most the chance `miss`."""
    below, p = 0.0, (1 - similarity) ** VALUES
    for m in range(VALUES + 1):
        below += p
        if below > miss:
            return m
        p *= (VALUES - m) / (m + 1) * similarity / (1 - similarity)
    return VALUES


def alike(common: np.ndarray, union: np.ndarray) -> np.ndarray:
    """Is the similarity at the threshold or above? In whole numbers."""
    return OF * common.astype("int64") >= LINK * union.astype("int64")


def sizes_allow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sets of these sizes can be linked: the smaller one holds the intersection, the larger one lies in the union."""
    return OF * np.minimum(a, b) >= LINK * np.maximum(a, b)


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows doc_id, node (identity of the shingle set, null if empty), n_shingles, bands, low (low bytes of the signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, bands, low = [], [], [], []
            for _, s in sh.shingle_sets(batch.column(1), sh.NOT_BLANK):
                v = signature(s) if len(s) else None
                node.append(sh.set_id(s) if len(s) else None)
                size.append(len(s))
                bands.append(band_keys(v) if len(s) else None)
                low.append(v.astype("uint8").tobytes() if len(s) else None)
            out = [batch.column(0), pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "node", "n_shingles", "bands", "low"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"doc_id {kind}, node binary, n_shingles long, bands array<bigint>, low binary")


def sets_of(docs: DataFrame, members: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, shingles): the whole sets of the nodes in `members` (node, rep), read again from the text of a document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, sets = batch.column(0).to_pylist(), []
            for row, s in sh.shingle_sets(batch.column(1), sh.NOT_BLANK):
                sets.append(s.tobytes() if len(s) and sh.set_id(s) == own[row] else None)  # a key may stand on several texts
            t = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])
            yield t.filter(pa.array([s is not None for s in sets], pa.bool_()))

    texts = checked_join(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), members, F.col("__key").eqNullSafe(F.col("rep")), "inner")
    return texts.select("node", "__text").mapInArrow(run, "node binary, shingles binary").dropDuplicates(["node"])


def pivot_links(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """True links (a, b) among the pairs (pivot, node), on whole sets.

    The nodes of a pivot are salted in blocks; the pivot's set goes to each block once, so a pivot of any number of nodes
    is spread over tasks and none holds more than a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in runs(batches, 2, 512):
            pivots, nodes, blobs, a, b = t.column("pivot").to_pylist(), t.column("node").to_pylist(), t.column("shingles"), [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.frombuffer(blobs[lo].as_py(), "uint64")  # the null node sorts first: the pivot itself
                for k in range(lo + 1, hi):
                    s = np.frombuffer(blobs[k].as_py(), "uint64")
                    common = np.count_nonzero(own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s)
                    if alike(np.int64(common), np.int64(len(own) + len(s) - common)):
                        a.append(pivots[k])
                        b.append(nodes[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    counts = stored(edges.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PIVOT_BLOCK).cast("int").alias("salts")), "pivots")
    dealt = checked_join(edges.select("pivot", "node"), counts, ["pivot"], "inner").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    nodes = dealt.select("pivot", "salt", "node").join(sets, "node").select("pivot", "salt", "node", "shingles")
    own = counts.join(sets, F.col("pivot") == F.col("node")).select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("node"), "shingles")
    both = own.unionByName(nodes).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.asc_nulls_first("node"))
    return both.mapInArrow(run, "a binary, b binary")


def surviving_nodes(buckets: DataFrame) -> DataFrame:
    """Rows (key, ci, cj, c, node): nodes of a bucket's blocks that have a pair left to verify there.

    buckets: rows key, ci, cj, c (as `in_blocks` deals them), node, label, n_shingles, bands, low.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches()
        for t, bounds in runs(batches, 3, 512):
            key, size = t.column("key").to_numpy(), t.column("n_shingles").to_numpy()
            ci, cj, c = (t.column(x).to_numpy() for x in ("ci", "cj", "c"))
            _, label = np.unique(np.asarray(t.column("label").to_pylist(), dtype=object), return_inverse=True)
            bands = np.asarray(t.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
            low = np.frombuffer(b"".join(t.column("low").to_pylist()), "uint8").reshape(-1, VALUES)
            left = np.zeros(t.num_rows, bool)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                i, j = block_pairs(lo, hi, ci[lo], cj[lo], c)
                at = np.flatnonzero((label[i] != label[j]) & sizes_allow(size[i], size[j]))
                i, j = i[at], j[at]
                if len(i):
                    same = bands[i] == bands[j]
                    here = bands[i, same.argmax(axis=1)] == key[lo]  # the first band they share is this bucket's
                    i, j = i[here], j[here]
                    at = (low[i] == low[j]).sum(axis=1) >= least
                    left[i[at]] = left[j[at]] = True
            yield from t.select(["key", "ci", "cj", "c", "node"]).filter(pa.array(left)).combine_chunks().to_batches()

    keys = ["key", "ci", "cj"]
    dealt = buckets.select(*keys, "c", "node", "label", "n_shingles", "bands", "low").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "key long, ci int, cj int, c int, node binary")


def block_links(rows: DataFrame) -> DataFrame:
    """Spanning forests (a, b) of the true links between the nodes of each block pair: key, ci, cj, c, node, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in runs(batches, 3, 512):
            nodes, blobs, a, b = t.column("node").to_pylist(), t.column("shingles"), [], []
            c, ci, cj = (t.column(x).to_numpy() for x in ("c", "ci", "cj"))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                sets = [np.frombuffer(blobs[k].as_py(), "uint64") for k in range(lo, hi)]
                left, right = np.flatnonzero(c[lo:hi] == ci[lo]), np.flatnonzero(c[lo:hi] == cj[lo])
                if hi - lo < 2 or not len(left) or not len(right):
                    continue
                i, j = np.nonzero(alike(*common_counts(sets, left, right)))
                root = forest(hi - lo, left[i], right[j])
                for k in np.flatnonzero(root != np.arange(hi - lo)).tolist():
                    a.append(nodes[lo + root[k]])
                    b.append(nodes[lo + k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    keys = ["key", "ci", "cj"]
    return rows.select(*keys, "c", "node", "shingles").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a binary, b binary")


def linked_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id of its component), kept (is it that one?)."""
    own = stored(signed(docs, key, text), "signed")
    nodes = own.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    nodes = stored(nodes, "set-nodes")
    full = stored(nodes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "full-buckets")
    shared = stored(checked_join(nodes.select(F.explode("bands").alias("key"), "node", "n_shingles"), full, ["key"], "inner"), "shared-buckets")
    members = shared.groupBy("node").agg(F.sum("n").alias("score"))
    members = stored(members.join(nodes.select("node", "rep"), "node"), "bucket-members")
    sets = stored(sets_of(docs, members.select("node", "rep"), key, text), "member-sets")

    scored = checked_join(shared, members.select("node", "score"), ["node"], "inner")
    pivots = stored(scored.groupBy("key").agg(F.max(F.struct("score", "node", "n_shingles")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.n_shingles").alias("of")), "bucket-pivots")
    edges = checked_join(shared, pivots, ["key"], "inner").where("node <> pivot").where(OF * F.least("of", "n_shingles") >= LINK * F.greatest("of", "n_shingles"))
    first = stored(pivot_links(stored(edges.select("pivot", "node").distinct(), "pivot-pairs"), sets), "pivot-links")

    label = components(first)
    labelled = stored(checked_join(shared.drop("n"), label, ["node"], "left").withColumn("label", F.coalesce("label", "node")), "labelled-buckets")
    apart = stored(labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most").select("key", "n"), "open-buckets")
    rest = in_blocks(checked_join(labelled, nodes.select("node", "bands", "low"), ["node"], "inner"), ["key"], apart)
    left = stored(surviving_nodes(rest), "open-nodes")
    links = stored(block_links(checked_join(left, sets, ["node"], "inner")).unionByName(first), "true-links")

    named = nodes.select("node", "rep").join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stored(named.join(named.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("node", "component_id"), "named-nodes")
    out = checked_join(own.where("node is not null").select("doc_id", "n_shingles", "node"), named, ["node"], "inner").select("doc_id", "n_shingles", "component_id")
    alone = own.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"))
