"""Facets that are kept up to date: distinct keys by day and label as bitmaps, merged over the days and labels asked for.

Every key has a number; a day and label hold the set of their keys' numbers in bitmaps of 32,768 bits. Sets merge by OR, so
distinct counts over any days are exact and read states only, never the observations; labels that differ in spelling are
merged into their canonical label the same way, and keys under two spellings count once.

Edge cases: null labels and null keys count nothing; a day without rows has no state; a range without days gives no rows;
repeated rows change nothing; keys that appear later get numbers behind those there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basisline.storage import stored

_BLOCK = 33  # bits below the partition in monotonically increasing ids


def numbered(keys: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(key, number) of the distinct keys of a column `key`: numbers are dense within each part of the keys' order, and those
    of `known` keys stay."""
    fresh = keys.select("key").where("key is not null").distinct()
    if known is None:
        start = 0
    else:
        fresh = fresh.join(known.select("key"), "key", "left_anti")
        last = known.agg(F.max("number")).first()[0]
        start = 0 if last is None else ((last >> _BLOCK) + 1) << _BLOCK
    out = fresh.repartitionByRange("key").sortWithinPartitions("key").withColumn("number", F.monotonically_increasing_id() + F.lit(start))
    out = stored(out, "key-numbers")
    return out if known is None else known.select("key", "number").unionByName(out)


def day_states(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """(day, label, bucket, bits) of rows day, label, key: one bitmap for each day, label and 32,768 numbers."""
    own = rows.select("day", "label", "key").where("label is not null").distinct().join(numbers, "key")
    return own.groupBy("day", "label", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def facet(states: DataFrame, first_day: object = None, last_day: object = None, label: Column | None = None) -> DataFrame:
    """(name, market_count) over a range of days (both ends included; None: open), under `label` of the states' labels."""
    if first_day is not None:
        states = states.where(F.col("day") >= F.lit(first_day))
    if last_day is not None:
        states = states.where(F.col("day") <= F.lit(last_day))
    named = states.select((F.col("label") if label is None else label).alias("name"), "bucket", "bits").where("name is not null")
    merged = named.groupBy("name", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("name").agg(F.sum(F.bitmap_count("bits")).cast("long").alias("market_count"))


def canonical_facet(labels: DataFrame, canonical: Column, column: str = "label") -> DataFrame:
    """Facet values in canonical spelling: the distinct raw labels are read once each and collapse to (name, variants)."""
    return labels.select(column).distinct().select(canonical.alias("name"), column).where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("variants"))
