"""Gapless numbers within groups of any size, without one task ever holding a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basisline.llm.common import checked_join, stored

GROUP_ROWS = 1000  # rows of one group numbered together


def with_row_ids(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once with a number of their own (`row`): it tells equal rows apart and no rerun changes it."""
    return stored(df.withColumn("row", F.monotonically_increasing_id()), name)


def ranked(rows: DataFrame, group: str, counts: dict[int, int]) -> DataFrame:
    """Add `rank`, from 0 without gaps within each value of the int column `group`.

    rows: as `with_row_ids` gives them; counts: rows by group (small numbers, a bounded set). A group of n rows is dealt
    over n / GROUP_ROWS salts by a hash of the row number, so repeated rows spread like any others; each salt is numbered
    in one task and shifted by the sizes of the salts before it.
    """
    salts = F.split(F.lit(",".join(str(-(-counts.get(n, 0) // GROUP_ROWS)) for n in range(max(counts, default=0) + 1))), ",").cast("array<bigint>")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), salts[F.col(group).cast("int")])))
    sizes = salted.groupBy(group, "salt").agg(F.count(F.lit(1)).alias("n"))
    shift = F.sum("n").over(W.partitionBy(group).orderBy("salt")) - F.col("n")
    offsets = stored(sizes.select(group, "salt", shift.alias("shift")), "rank-offsets")
    numbered = salted.withColumn("place", F.row_number().over(W.partitionBy(group, "salt").orderBy("row")))
    return checked_join(numbered, offsets, [group, "salt"], "inner").withColumn("rank", F.col("shift") + F.col("place") - 1).drop("salt", "place", "shift", "row")
