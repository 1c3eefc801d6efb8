"""Sinks: append-only history, dated and latest exports, reports, and inserts that skip what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basisline.functions.text import spreadsheet_safe


def append_history(df: DataFrame, path: str, at: str = "captured_at") -> None:
    """Append observations, partitioned by capture day so later reads of a day or range prune the rest.

    Rows are dealt by day before the write: each day's rows are spread over as many files as their size asks for.
    """
    out = df.withColumn("capture_date", F.to_date(at))
    out.hint("rebalance", "capture_date").write.mode("append").partitionBy("capture_date").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; text cells can't turn into formulas."""
    kinds = dict(df.dtypes)
    df.select(*[(spreadsheet_safe(F.col(f"`{c}`")) if kinds[c] == "string" else F.col(f"`{c}`")).alias(c) for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def export_by_source(df: DataFrame, folder: str, day: str, source: str = "Source") -> None:
    """The day's consolidated rows, one folder per source, and the same rows as 'latest'."""
    for name in (f"dated/{day}", "latest"):
        df.hint("rebalance", source).write.mode("overwrite").partitionBy(source).option("header", True).csv(f"{folder}/{name}")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def new_rows(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet, one per key (the smallest row): insert with conflicts ignored."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]) if rest else df.select(*keys).distinct()
    return one.join(existing.select(*keys), keys, "left_anti").select(df.columns)
