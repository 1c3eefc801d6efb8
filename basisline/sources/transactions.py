"""Batches that become visible as a whole: every table of a batch is staged, then one manifest row shows them all.

A batch stages its tables under `table/tx_batch=n/tx_attempt=a`, each attempt under a name of its own, and commits by renaming
one finished file to `_commits/batch=n.json`. Readers join the manifest, so a batch that stopped between two tables shows
nothing, a batch that ran twice shows its first commit only, and `vacuum` deletes what no commit names. Batch and attempt are
partition columns: the join with the manifest prunes files.

Edge cases: a committed batch is never staged again (`staged` is refused, so callers skip it); an empty table is committed
like any other; a table of which no batch is committed reads as None, one that some batches lack has their rows only.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.operators.sizes import small_or_shuffled
from basisline.storage import delete

MANIFEST = "batch long, attempt string, tables array<string>, committed_at double"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's entries; none if there is no such folder."""
    fs, p = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


@dataclass
class Transaction:
    """One attempt to write a batch."""

    spark: SparkSession
    root: str
    batch: int
    attempt: str = field(default_factory=lambda: f"a{uuid.uuid4().hex}")
    tables: list[str] = field(default_factory=list)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}/tx_batch={self.batch}/tx_attempt={self.attempt}"

    def stage(self, table: str, df: DataFrame) -> str:
        """Write a table of the batch, which no reader sees yet; its path."""
        if is_committed(self.spark, self.root, self.batch):
            raise ValueError(f"batch {self.batch} is committed already")
        df.write.mode("error").parquet(self.path(table))
        self.tables.append(table)
        return self.path(table)

    def commit(self) -> bool:
        """Show all staged tables at once. False if another attempt of the batch was committed before: nothing changes then."""
        fs, done = _fs(self.spark, f"{self.root}/_commits/batch={self.batch}.json")
        _, draft = _fs(self.spark, f"{self.root}/_commits/.{self.attempt}")
        fs.mkdirs(done.getParent())
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"batch": self.batch, "attempt": self.attempt, "tables": self.tables, "committed_at": time.time()}).encode()))
        out.close()
        try:
            won = not fs.exists(done) and fs.rename(draft, done)
        except Py4JJavaError:  # some file systems raise where a file of that name has appeared meanwhile
            won = False
        if not won:
            fs.delete(draft, False)
        return won


def is_committed(spark: SparkSession, root: str, batch: int) -> bool:
    fs, done = _fs(spark, f"{root}/_commits/batch={batch}.json")
    return fs.exists(done)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Committed batches: batch, attempt, tables, committed_at."""
    if not any(n.startswith("batch=") for n in _names(spark, f"{root}/_commits")):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{root}/_commits/batch=*.json")


def committed(spark: SparkSession, root: str, table: str, schema: str | None = None) -> DataFrame | None:
    """The rows of a table's committed batches, with `batch` (unless the table has a column of that name); None before the
    first commit."""
    shown = manifest(spark, root).where(F.array_contains("tables", table)).select(F.col("batch").alias("tx_batch"), F.col("attempt").alias("tx_attempt"))
    if shown.isEmpty():
        return None
    reader = spark.read.option("basePath", f"{root}/{table}")
    rows = (reader.schema(schema) if schema else reader).parquet(f"{root}/{table}")
    rows = rows.withColumns({"tx_batch": F.col("tx_batch").cast("long"), "tx_attempt": F.col("tx_attempt").cast("string")})
    rows = rows.join(small_or_shuffled(shown), ["tx_batch", "tx_attempt"]).drop("tx_attempt")
    return rows.drop("tx_batch") if "batch" in rows.columns else rows.withColumnRenamed("tx_batch", "batch")


def latest(spark: SparkSession, root: str, table: str) -> tuple[int, str] | None:
    """Number and path of the last committed batch that has the table: for tables that each batch replaces."""
    last = manifest(spark, root).where(F.array_contains("tables", table)).agg(F.max_by(F.struct("batch", "attempt"), "batch").alias("m")).first()[0]
    return None if last is None else (last["batch"], f"{root}/{table}/tx_batch={last['batch']}/tx_attempt={last['attempt']}")


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete the attempts that no commit names; their number. Run it when no batch is being written."""
    kept = {(r["batch"], r["attempt"]) for r in manifest(spark, root).select("batch", "attempt").collect()}  # one row a batch
    gone = 0
    for table in _names(spark, root):
        if table.startswith("_"):
            continue
        for b in _names(spark, f"{root}/{table}"):
            for a in _names(spark, f"{root}/{table}/{b}"):
                if (int(b.removeprefix("tx_batch=")), a.removeprefix("tx_attempt=")) not in kept:
                    delete(spark, f"{root}/{table}/{b}/{a}")
                    gone += 1
    return gone
