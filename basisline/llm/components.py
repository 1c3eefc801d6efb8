"""Connected components of an edge table, by hooking roots with pointer jumping. Nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basisline.llm.common import discard, stored


def flat(parents: DataFrame) -> DataFrame:
    """Rows (node, label) with the root of each node's tree; a root's label is itself. Each round halves the depths."""
    while True:
        up = parents.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        new = stored(parents.join(up, F.col("label") == F.col("n2"), "left").select("node", F.col("label").alias("old"), F.coalesce("l2", "label").alias("label")), "cc-parents")
        discard(parents)
        parents = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for every node of `edges` (a, b): label is the smallest node of its component.

    Each round hooks every root to the smallest root next to it, flattens the trees by pointer jumping and leaves only the
    edges between different roots. A root that hooks to none either has another hooked to it or gets a smaller neighbour
    for the next round, so the roots of an unfinished component at least halve in two rounds, whatever its shape and ids,
    and the loop ends by itself. Every round is stored, so a lost executor costs one round at most,
    and takes the place of the round before. Labels of a giant component are one join key: Spark's adaptive skew join splits it.
    """
    left = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "cc-edges")
    labels = None
    while True:
        roots = flat(stored(left.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "cc-parents"))
        up = roots.select(F.col("node").alias("n1"), F.col("label").alias("l1"))
        other = roots.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        rest = left.join(up, F.col("a") == F.col("n1")).join(other, F.col("b") == F.col("n2")).where("l1 <> l2")
        rest = stored(rest.select(F.col("l1").alias("a"), F.col("l2").alias("b")).distinct(), "cc-edges")
        discard(left)
        left = rest
        if labels is None:
            labels = roots
        else:
            new = stored(labels.join(up, F.col("label") == F.col("n1"), "left").select("node", F.coalesce("l1", "label").alias("label")), "cc-labels")
            discard(labels)
            discard(roots)
            labels = new
        if left.isEmpty():
            discard(left)
            return labels
