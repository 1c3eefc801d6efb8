"""Joins that broadcast a side only after measuring it, and label functions computed once a distinct label."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basisline.storage import stored

#: A side is broadcast only while its rows and its bytes (as JSON, which is wider than the rows) stay within both.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
ROWS_OF_PART = 100_000  # rows of a part that is dealt by its count


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Does the frame stay within both bounds? One pass over it."""
    found = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")), F.lit(0))).first()
    return found[0] <= rows and found[1] <= size


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """The frame, marked for broadcast if it is small."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def parts_of(df: DataFrame, rows: int = ROWS_OF_PART) -> int:
    """How many parts of about `rows` rows a frame makes. Counts its rows."""
    return max(1, -(-df.count() // rows))


def dealt_by(df: DataFrame, key: str, rows: int = ROWS_OF_PART) -> DataFrame:
    """The rows dealt by key into parts of about `rows` rows. For work that the bytes of a shuffle understate: rows that compress
    well, or that a parser reads, would otherwise meet in few parts that grow with the input. Counts the rows first."""
    return df.repartition(parts_of(df, rows), key)


def by_distinct(df: DataFrame, columns: list[str], **computed: Column) -> DataFrame:
    """Add columns computed from `columns` alone, once for each of their distinct values instead of once a row.

    Labels are few and repeat: costly readings of them run on the distinct ones, are stored once and come back by a join,
    which is a broadcast when they are measured to be few. Null labels are values like others. Give all columns in one call:
    each call reads the labels and stores their readings as soon as it is made.
    """
    names = [f"__d{i}" for i in range(len(columns))]
    labels = df.select(*columns).distinct()
    found = stored(labels.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], *[c.alias(n) for n, c in computed.items()]), "labels")
    same = F.lit(True)
    for c, n in zip(columns, names, strict=True):
        same = same & df[c].eqNullSafe(F.col(n))
    return df.join(small_or_shuffled(found), same, "left").drop(*names)


def by_labels(df: DataFrame, readings: Mapping[str, Mapping[str, Callable[[Column], Column]]]) -> DataFrame:
    """Add columns that are read from one label column each: {label column: {new column: reading}}.

    The distinct labels of all these columns are found in one pass and stored; each column's readings run on its own labels
    and come back by a join, a broadcast when the labels are measured to be few. Null labels are values like others.
    """
    columns = list(readings)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(columns)]))
    found = stored(df.select(pairs.alias("p")).select("p.c", "p.v").distinct(), "labels")
    small = is_small(found)
    for i, c in enumerate(columns):
        label = F.col("__v")
        own = found.where(F.col("c") == i).select(F.col("v").alias("__v")).select(label, *[read(label).alias(name) for name, read in readings[c].items()])
        df = df.join(F.broadcast(own) if small else own, F.col(f"`{c}`").cast("string").eqNullSafe(label), "left").drop("__v")
    return df
