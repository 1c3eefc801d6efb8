"""Set operations and reshaping: unions by name, order-preserving distincts, long and wide forms, headings filled down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union_aligned(frames: list[DataFrame]) -> DataFrame:
    """All rows under the columns of all frames; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def settled(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed once however often later expressions use it: the optimizer does not copy
    expressions through the one-row explode in between, so chains of label readings don't multiply."""
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("__row")).select("__row.*")


def in_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; missing ones are empty text."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns])


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; `order` must end in something unique."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def keep_last(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last row of each key, with `repeats`: how many rows it replaced."""
    w = W.partitionBy(*keys)
    out = df.withColumns({"__n": F.row_number().over(w.orderBy(F.col(position).desc())), "repeats": F.count(F.lit(1)).over(w) - 1})
    return out.where("__n = 1").drop("__n")


def distinct_in_order(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the first position of each."""
    return df.groupBy(value).agg(F.min(position).alias("first_position"))


def to_long(df: DataFrame, ids: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def to_wide(df: DataFrame, ids: list[str], name: str, values: list[str], agg: Column) -> DataFrame:
    """One column per listed name, so the pivot needs no extra pass."""
    return df.groupBy(*ids).pivot(name, values).agg(agg)


def filled_down(df: DataFrame, group: list[str], position: str, heading: str) -> DataFrame:
    """Rows with the latest heading at or before them in document order."""
    w = W.partitionBy(*group).orderBy(position).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(heading, F.last(heading, ignorenulls=True).over(w))


def with_forced(rows: DataFrame, forced: DataFrame, key: str) -> DataFrame:
    """Rows, and those forced ones whose key is not there yet."""
    return rows.unionByName(forced.join(rows.select(key), key, "left_anti").select(rows.columns))


def merged(stored: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Upsert: new rows are added; of existing ones the fields that the update names replace the stored ones."""
    new = updates.select(F.col(key), *[F.col(c).alias(f"__n_{c}") for c in updates.columns if c != key])
    both = stored.join(new, key, "full_outer")
    return both.select(key, *[F.coalesce(f"__n_{c}", c).alias(c) if c in updates.columns else F.col(c) for c in stored.columns if c != key])


def undelivered(subscribers: DataFrame, ledger: DataFrame, issue: str, retry_failed: bool = False) -> DataFrame:
    """Subscribers that an issue has still to reach: sent and pending ones never again, failed ones on request."""
    done = ledger.where(F.col("issue_key") == issue)
    done = done.where(F.col("status") != "failed") if retry_failed else done
    return subscribers.where("is_active").join(done.select("subscriber_id").distinct(), "subscriber_id", "left_anti")
