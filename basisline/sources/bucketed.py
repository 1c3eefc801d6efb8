"""Tables that lie in buckets by a key, so a join or window by that key reads them without a shuffle.

Bucket numbers are part of the file names and the layout is declared whenever the table is opened, so a session that has never
seen it can use it: nothing depends on a metastore.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession


def _name(path: str) -> str:
    return f"basisline_{zlib.crc32(path.encode()):08x}_{zlib.adler32(path.encode()):08x}"


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write rows in buckets by `key`, each sorted by it; one file a bucket, if the rows are dealt by key into as many parts."""
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).mode("error").saveAsTable(_name(path))


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """Open such a table."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def forget(spark: SparkSession, path: str) -> None:
    """Drop the declaration; the files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
