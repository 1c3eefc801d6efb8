"""Shared helpers of the training-data operators: stored intermediates and size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.storage import _written, discard, scratch, shared_dir, stored

__all__ = ["_written", "discard", "scratch", "shared_dir", "stored"]

#: A side is broadcast only when its counted rows and then its measured bytes stay within these bounds; beyond them Spark
#: joins by shuffle.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20

#: `[^\x20\x09-\x0D]+` words are what remains between runs of these separators.
BLANKS = r"[ \x09-\x0D]+"


def bind(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once, however often later expressions (lambdas too) use them."""
    packed = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__b")
    return df.select(*keep, packed).select(*keep, *[F.col(f"__b.{n}").alias(n) for n in columns])


def is_small(df: DataFrame, bound: int = BROADCAST_ROWS, limit: int = BROADCAST_BYTES) -> bool:
    """Do a stored table's rows and bytes stay within the bounds? Bytes (of the rows as JSON, which is wider than they are)
    are measured only once the rows are known to be few."""
    if df.count() > bound:
        return False
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0]
    return (size or 0) <= limit


def checked_join(left: DataFrame, right: DataFrame, on: Column | list[str], how: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a stored right side: broadcast when it is small by count and bytes, else shuffled by Spark."""
    return left.join(F.broadcast(right) if is_small(right, bound) else right, on, how)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salt: Column, salts: int = 16) -> DataFrame:
    """Inner join with a stored right side that has each key once: broadcast when it is small, else every right row stands
    under `salts` keys and the left rows are dealt over them, so a hot left key never meets in one task."""
    if is_small(right):
        return left.join(F.broadcast(right), on)
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int")).join(copies, [*on, "__salt"]).drop("__salt")


def crc_text(col: Column) -> Column:
    """crc32 of a value written as text; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only. Plain ASCII texts take the fast built-in; others are translated letter by letter."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
