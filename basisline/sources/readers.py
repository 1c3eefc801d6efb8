"""Readers of price sheets and history tables.

Columnar and CSV inputs go through Spark's own readers. Only bytes that no reader takes (mixed encodings, workbooks as a
folder of sheets) pass through a small Arrow function per file.
"""

from __future__ import annotations

import csv
import io
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_SUFFIXES = {"csv", "parquet", "json", "orc"}


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every cell as text."""
    return spark.read.option("header", True).option("multiLine", True).csv(path)


def read_typed_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with inferred types; NaN becomes null."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns])


def decoded(payload: bytes) -> str:
    """Text of bytes: UTF-8 with or without a mark, else Latin-1."""
    try:
        return payload.decode("utf-8-sig")
    except UnicodeDecodeError:
        return payload.decode("latin-1")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of unknown encoding as rows (path, position, cells: map of header to text), one file at a time.

    A file is read by one task as a whole, so it must fit a value of Spark (2 GB) and a worker's memory: uploads are sheets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for name, data in zip(*batch.columns, strict=True):
                reader = csv.DictReader(io.StringIO(decoded(data.as_py())))
                block: list[list[tuple[str, str | None]]] = []
                start = 0
                for row in reader:
                    block.append([(k, v if isinstance(v, str) else None) for k, v in row.items() if k is not None])
                    if len(block) == 4096:
                        yield _block(name.as_py(), start, block, kind)
                        start, block = start + len(block), []
                if block:
                    yield _block(name.as_py(), start, block, kind)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, position long, cells map<string,string>")


def _block(name: str, start: int, block: list, kind: pa.DataType) -> pa.RecordBatch:
    places = pa.array(range(start, start + len(block)), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([name] * len(block), pa.string()), places, pa.array(block, kind)], names=["path", "position", "cells"])


def read_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """A workbook saved as one CSV per sheet: all rows with `source_name` (the Source column, else the sheet's name)."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).csv(f"{folder}/*.csv")
    sheet = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    own = F.nullif(F.trim("Source"), F.lit("")) if "Source" in df.columns else F.lit(None).cast("string")
    return df.withColumn("source_name", F.coalesce(own, sheet))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """The reader for a path's suffix; an unknown suffix is an error."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in TABLE_SUFFIXES:
        raise ValueError(f"cannot read {path}: expected one of {', '.join(sorted(TABLE_SUFFIXES))}")
    return read_text_csv(spark, path) if suffix == "csv" else spark.read.format(suffix).load(path)


def dated_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files named <anything>_YYYY-MM-DD.csv with their date and time of change; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path", "modificationTime")
    return files.withColumn("file_date", F.try_to_date(F.regexp_extract("path", r"_(\d{4}-\d{2}-\d{2})\.csv$", 1)))


def previous_file(spark: SparkSession, folder: str, before: str) -> str | None:
    """Path of the latest dated file before a day."""
    return dated_files(spark, folder).where(F.col("file_date") < F.lit(before).cast("date")).agg(F.max_by("path", F.struct("file_date", "path"))).first()[0]


def newest_file(spark: SparkSession, folder: str) -> str | None:
    return dated_files(spark, folder).agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def payload_field(payload: Column, name: str) -> Column:
    """Text of one field of a JSON payload."""
    return F.get_json_object(payload, f"$.{name}")


def read_settings(spark: SparkSession, path: str) -> dict:
    """Settings of one TOML file, read by Spark so that any store will do."""
    return tomllib.loads(spark.read.text(path, wholetext=True).first()[0])


def setting_rows(spark: SparkSession, settings: dict, name: str, schema: str) -> DataFrame:
    """An array of tables in the settings (dotted name) as rows; fields that a table leaves out are null, others are ignored."""
    found = settings
    for part in name.split("."):
        found = found.get(part, {})
    kept = T.StructType.fromDDL(schema).names
    return spark.createDataFrame([tuple(row.get(c) for c in kept) for row in found or []], schema)
