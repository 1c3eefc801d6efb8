"""N-gram Jaccard join with Bayesian candidate pruning.

1. Every text becomes its set of five-word shingles; texts with the same set are one node (copies are never expanded).
2. MinHash bands put nodes into buckets. In a bucket, pairs compare their MinHash values 16 at a time and are dropped as
   soon as the posterior probability of reaching the threshold falls below the tolerance. Large buckets are dealt out in
   salted blocks; survivors leave as a spanning forest, never as all pairs.
3. Components of the surviving pairs are small clusters; each node's whole shingle set goes to its cluster (large clusters
   again in blocks), where all pairs are verified exactly. Out come link counts and a spanning forest of true links.
4. Components of the true links are the classes.

Cost: linear but for the comparisons inside one bucket or cluster, which are counted in tasks of bounded size. Links are
counted exactly, so a cluster of n different texts that are all alike costs its n (n - 1) / 2 comparisons, and each of its sets
goes to n / BLOCK tasks; copies of one text cost nothing, whatever their number.

Edge cases: texts of fewer than five words are one shingle of all their words; null, empty and wordless texts have no
shingle, are linked to nothing and form a class each; repeated rows are copies of one node; null keys are allowed; empty
tables give empty results; extra columns are ignored by `similar` and kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from basisline.llm import shingles as sh
from basisline.llm.common import checked_join, stored, table
from basisline.llm.components import components
from basisline.llm.grouped import runs

THRESHOLD = 0.8
TOLERANCE = 1e-5  # a pair goes when its posterior chance of reaching the threshold is below this
STEP = 16  # MinHash values compared at a time
BLOCK = 256  # nodes of a bucket or cluster in one block

SKETCHED = "doc_id {kind}, h long, r long, node binary, bands array<bigint>, sketch binary"


def row_hash(docs: DataFrame) -> Column:
    """Hash of all of a row's columns (but maps): tells rows of one key and text apart."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)])


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows doc_id, h (text hash), r (row hash), node (identity of the shingle set, null if empty), bands, sketch (low bytes of MinHash values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, bands, sketch = [], [], []
            for _, s in sh.shingle_sets(batch.column(3)):
                v = sh.minhash(s) if len(s) else None
                node.append(sh.set_id(s) if len(s) else None)
                bands.append(sh.band_keys(v) if len(s) else None)
                sketch.append(v.astype("uint8").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "h", "r", "node", "bands", "sketch"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.xxhash64(text), row_hash(docs), F.col(text)).mapInArrow(run, SKETCHED.format(kind=kind))


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For 16, 32, ... compared values: the fewest matches that keep a pair, under a uniform prior on the similarity.

    Values are compared by one byte, so a match has the chance r = s + (1 - s) / 256 for similarity s.
    """
    r = np.linspace(1 / 256, 1, 20_001)[:-1] + (1 - 1 / 256) / 40_000
    high = r >= threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, sh.N_HASHES + 1, STEP):
        for m in range(n + 1):
            p = m * np.log(r) + (n - m) * np.log1p(-r)
            p = np.exp(p - p.max())
            if p[high].sum() / p.sum() >= tolerance:
                out.append(m)
                break
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (i of a, j of b) left after the incremental comparison."""
    seen = np.zeros(len(i), "int64")
    for k, m in enumerate(least):
        cut = slice(k * STEP, (k + 1) * STEP)
        seen = seen + (a[i, cut] == b[j, cut]).sum(axis=1)
        keep = seen >= m
        i, j, seen = i[keep], j[keep], seen[keep]
        if not len(i):
            break
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest connected index for each of n indexes under the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def in_blocks(rows: DataFrame, group: list[str], sizes: DataFrame, node: str = "node", block: int = BLOCK) -> DataFrame:
    """Deal rows of groups of n rows (joined from `sizes`) into block pairs: adds ci <= cj and the row's own block c.

    A group within the block size stays whole. A larger one is salted into blocks; a row goes to each pair of its block.
    """
    dealt = checked_join(rows, sizes, group, "inner").withColumn("m", F.ceil(F.col("n") / block).cast("int"))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64(node, F.lit(11)), F.col("m")).cast("int"))
    dealt = dealt.withColumn("cc", F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda x: F.struct(F.least("c", x).alias("ci"), F.greatest("c", x).alias("cj")))))
    return dealt.select(*group, F.col("cc.ci").alias("ci"), F.col("cc.cj").alias("cj"), "c", *[x for x in rows.columns if x not in group])


def block_pairs(lo: int, hi: int, ci: int, cj: int, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows lo..hi of one block, or between its two blocks."""
    if ci == cj:
        i, j = np.triu_indices(hi - lo, 1)
        return i + lo, j + lo
    a, b = np.flatnonzero(c[lo:hi] == ci) + lo, np.flatnonzero(c[lo:hi] == cj) + lo
    return np.repeat(a, len(b)), np.tile(b, len(a))


def pruned_edges(buckets: DataFrame) -> DataFrame:
    """Edges (a, b): spanning forests of the bucket pairs that survive the Bayesian comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches()
        for t, bounds in runs(batches, 3):
            nodes, index = np.unique(np.asarray(t.column("node").to_pylist(), dtype=object), return_inverse=True)
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "uint8").reshape(-1, sh.N_HASHES)
            c, ci, cj = (t.column(x).to_numpy() for x in ("c", "ci", "cj"))
            size, kept = np.diff(bounds), []
            alike = ci[bounds[:-1]] == cj[bounds[:-1]]
            for n in np.unique(size[(size <= 24) & alike]).tolist():  # many small buckets at once
                at = bounds[:-1][(size == n) & alike]
                i, j = np.triu_indices(n, 1)
                kept.append(surviving(sketch, sketch, (at[:, None] + i).ravel(), (at[:, None] + j).ravel(), least))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo > 24 or ci[lo] != cj[lo]:
                    i, j = block_pairs(lo, hi, ci[lo], cj[lo], c)
                    kept.append(surviving(sketch, sketch, i, j, least))
            i, j = (index[np.concatenate([k[x] for k in kept]).astype("int64")] if kept else np.zeros(0, "int64") for x in (0, 1))
            label = forest(len(nodes), i, j)
            far = np.flatnonzero(label != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[label[far]], pa.binary()), pa.array(nodes[far], pa.binary())], names=["a", "b"])

    keys = ["key", "ci", "cj"]
    dealt = buckets.select(*keys, "c", "node", "sketch").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact intersection and union sizes between two lists of set indexes (a product of incidence matrices)."""
    size = np.asarray([len(s) for s in sets])
    both = np.concatenate([left, right])
    flat = np.concatenate([sets[k] for k in both])
    owner = np.repeat(np.arange(len(both)), size[both])
    vocab, place = np.unique(flat, return_inverse=True)
    common = np.zeros((len(left), len(right)), "float32")
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for v in range(0, len(vocab), 4096):  # float32 counts are exact up to 2**24 shingles
        a, b = np.searchsorted(place, [v, v + 4096])
        m = np.zeros((len(both), 4096), "float32")
        m[owner[a:b], place[a:b] - v] = 1
        common += m[: len(left)] @ m[len(left) :].T
    return common, size[left][:, None] + size[right][None, :] - common


def exact_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs between two lists of set indexes."""
    common, union = common_counts(sets, left, right)
    i, j = np.nonzero(common >= threshold * union - 1e-9 * union)
    return left[i], right[j]


def verified(members: DataFrame) -> DataFrame:
    """Rows (a, b, texts, docs): link counts of node a (b null), and edges (a, b) of spanning forests of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in runs(batches, 3, 512):
            out: tuple[list, list, list, list] = ([], [], [], [])
            c, ci, cj, docs = (t.column(x).to_numpy() for x in ("c", "ci", "cj", "docs"))
            nodes, blobs = t.column("node").to_pylist(), t.column("shingles")
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                first = {nodes[k]: k for k in range(hi - 1, lo - 1, -1)}  # repeated rows once
                at = np.asarray(sorted(first.values()))
                sets = [np.frombuffer(blobs[k].as_py(), "uint64") for k in at.tolist()]
                here = np.arange(len(at))
                left = here[c[at] == ci[lo]]
                right = left if ci[lo] == cj[lo] else here[c[at] == cj[lo]]
                if not len(left) or not len(right):
                    continue
                i, j = exact_links(sets, left, right)
                if ci[lo] == cj[lo]:
                    i, j = i[i < j], j[i < j]
                texts, weight = np.bincount(np.concatenate([i, j]), minlength=len(at)), np.zeros(len(at), "int64")
                np.add.at(weight, i, docs[at[j]])
                np.add.at(weight, j, docs[at[i]])
                label = forest(len(at), i, j)
                for k in np.flatnonzero(texts).tolist():
                    out[0].append(nodes[at[k]]), out[1].append(nodes[at[label[k]]]), out[2].append(int(texts[k])), out[3].append(int(weight[k]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["a", "b", "texts", "docs"])

    keys = ["label", "ci", "cj"]
    dealt = members.select(*keys, "c", "node", "docs", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a binary, b binary, texts long, docs long")


def with_shingles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole shingle sets of the documents that stand for the nodes in column `node`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, sets = batch.column(0).to_pylist(), []
            for row, s in sh.shingle_sets(batch.column(3)):
                sets.append(s.tobytes() if len(s) and sh.set_id(s) == own[row] else None)
            out = [batch.column(0), batch.column(1), batch.column(2), pa.array(sets, pa.binary())]
            t = pa.RecordBatch.from_arrays(out, names=["node", "label", "docs", "shingles"])
            yield t.filter(pa.array([s is not None for s in sets], pa.bool_()))

    return docs.select("node", "label", "docs", F.col(text)).mapInArrow(run, "node binary, label binary, docs long, shingles binary")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, h (text hash), class_id (smallest doc_id of its class), class_size, n_links (other
    documents at the threshold or more, copies included) and n_text_links (other shingle sets); r (row hash) and label (of
    the class, null without shingles) tell rows and classes apart whatever their keys."""
    own = stored(sketches(docs, key, text), "sketches")
    nodes = own.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("docs"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = stored(nodes, "nodes")
    keyed = nodes.select(F.explode("bands").alias("key"), "node")
    buckets = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    keyed = nodes.select(F.explode("bands").alias("key"), "node", "sketch")
    near = stored(pruned_edges(in_blocks(keyed, ["key"], buckets)), "pruned-edges")
    clusters = components(near)
    members = stored(clusters.join(nodes.select("node", "rep", "docs"), "node"), "clusters")
    texts = checked_join(docs.select(F.col(key).alias("doc_id"), F.col(text)), members, F.col("doc_id").eqNullSafe(F.col("rep")), "inner")
    sizes = stored(members.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "cluster-sizes")
    links = stored(verified(in_blocks(with_shingles(texts, key, text), ["label"], sizes)), "links")
    classes = components(links.select("a", "b"))
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("texts").alias("texts"), F.sum("docs").alias("linked"))
    named = nodes.select("node", "rep", "docs").join(classes, "node", "left").join(counts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_class = named.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("docs").alias("class_size"))
    named = stored(named.join(by_class, "label").select("node", "label", "class_id", "class_size", "docs", "linked", "texts"), "classes")
    out = checked_join(own.where("node is not null").select("doc_id", "h", "r", "node"), named, ["node"], "inner")
    links = (F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links")
    out = out.select("doc_id", "h", "r", "label", "class_id", F.col("class_size").cast("long").alias("class_size"), links, F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"))
    none = F.lit(0).cast("long")
    alone = own.where("node is null").select("doc_id", "h", "r", F.lit(None).cast("binary").alias("label"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), none.alias("n_links"), none.alias("n_text_links"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class stays, with all its columns: that of the smallest doc_id (null last), and of several of those
    the smallest by hashes of text and row. Rows without shingles are like nothing and all stay."""
    found = stored(similar(docs), "similar").where("class_size > 1").select("label", F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h", "r").alias("row"))
    best = stored(found.groupBy("label").agg(F.min("row").alias("best")), "class-rows")
    gone = checked_join(found, best, ["label"], "inner").where(~F.col("row").eqNullSafe(F.col("best")))
    gone = stored(gone.select(F.col("row.doc_id").alias("gk"), F.col("row.h").alias("gh"), F.col("row.r").alias("gr")).distinct(), "dropped")
    twice = stored(found.groupBy("row").count().where("count > 1").select(F.col("row.doc_id").alias("gk"), F.col("row.h").alias("gh"), F.col("row.r").alias("gr")), "repeated")
    tagged = docs.select(F.col("doc_id").alias("k"), F.xxhash64("text").alias("h"), row_hash(docs).alias("r"), F.struct("*").alias("__row"))
    same = F.col("k").eqNullSafe(F.col("gk")) & (F.col("h") == F.col("gh")) & (F.col("r") == F.col("gr"))
    kept = checked_join(tagged, gone, same, "left_anti")
    if twice.isEmpty():
        return kept.select("__row.*")
    once = checked_join(kept, twice, same, "left_semi").dropDuplicates(["k", "h", "r"])  # rows that are equal in everything
    rest = checked_join(kept, twice, same, "left_anti")
    return rest.select("__row.*").unionByName(once.select("__row.*"))


def op7_bayesian_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links", "n_text_links")
