"""Stored intermediates: written once to the folder that the cluster shares, read back without their lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local folder of its own only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the executors share")
    path = "file://" + tempfile.mkdtemp(prefix="basisline-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_written: list[str] = []  # folders of intermediates that have not been deleted


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if path in _written:
        _written.remove(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    names = {file.rsplit("/", 2)[1] for file in df.inputFiles()}
    for path in [p for p in _written if p.rsplit("/", 1)[1] in names]:
        delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediates that are stored inside are deleted at the end; write or collect the results before it."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            delete(spark, path)
