"""Stored tables that are changed file by file and read by the row groups that matter.

A table is a folder of Parquet files and a line of versions, each a list of the files that are live. An update finds the files
that hold one of its keys (by `_metadata.file_path`, reading the key column alone), rewrites only those and commits the next
version by renaming one finished file; all others keep their names. Files are clustered by key and carry Bloom filters on it,
so keyed reads skip files and row groups.

Edge cases: an update of no known key only adds its new rows; a key on several stored rows changes all of them; a key on several
rows of an update is refused; null keys match nothing and are added; two writers of one version: the second fails and its files
are not live; an empty update makes no version. The lists of files pass through the driver: their length is that of the table
in files, not in rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.operators.sizes import small_or_shuffled
from basisline.sources.transactions import _fs, _names
from basisline.storage import stored

IN_LIST = 1000  # keys that a read may name in its filter; more of them join


def write_skippable(df: DataFrame, path: str, key: str, files: int | None = None, row_group_bytes: int = 16 << 20, distinct_keys: int = 1_000_000) -> None:
    """Append rows clustered and sorted by key, with Bloom filters on it and row groups small enough to be worth skipping."""
    dealt = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    out = dealt.sortWithinPartitions(key).write.mode("append").option("parquet.block.size", row_group_bytes)
    out.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", distinct_keys).parquet(path)


def with_keys(df: DataFrame, keys: DataFrame, key: str, most: int = IN_LIST) -> DataFrame:
    """Rows whose key is among `keys` (one column `key`): few keys become a filter that skips row groups, more a semi join."""
    few = keys.select(key).where(F.col(key).isNotNull()).distinct().limit(most + 1).collect()  # a bounded number
    if len(few) <= most:
        return df.where(F.col(key).isin([r[0] for r in few]))
    return df.join(small_or_shuffled(stored(keys.select(key).distinct(), "keys")), key, "left_semi")


@dataclass(frozen=True)
class FileTable:
    """A table of live files under `root`, keyed by one column."""

    spark: SparkSession
    root: str
    key: str

    def version(self) -> int:
        """Number of the last version; 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in _names(self.spark, f"{self.root}/_versions") if n.endswith(".json") and not n.startswith(".")), default=0)

    def files(self, version: int | None = None) -> list[str]:
        """Names of the live files, below the root."""
        v = self.version() if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/_versions/{v}.json", wholetext=True).first()[0]) if v else []

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last."""
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in self.files(version)])

    def _write(self, df: DataFrame, files: int | None = None) -> list[str]:
        """Names of the files that hold these rows."""
        folder = f"data/{uuid.uuid4().hex}"
        write_skippable(df, f"{self.root}/{folder}", self.key, files)
        return [f"{folder}/{n}" for n in _names(self.spark, f"{self.root}/{folder}") if n.endswith(".parquet")]

    def _commit(self, version: int, files: Sequence[str]) -> None:
        fs, done = _fs(self.spark, f"{self.root}/_versions/{version}.json")
        _, draft = _fs(self.spark, f"{self.root}/_versions/.{uuid.uuid4().hex}")
        fs.mkdirs(done.getParent())
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(list(files)).encode()))
        out.close()
        try:
            won = not fs.exists(done) and fs.rename(draft, done)
        except Py4JJavaError:
            won = False
        if not won:
            fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.root} was written by another job; read it and try again")

    def create(self, df: DataFrame, files: int | None = None) -> None:
        self._commit(1, self._write(df, files))

    def touched(self, keys: DataFrame) -> list[str]:
        """Live files that hold one of the keys."""
        prefix = unquote(self.root.split(":", 1)[-1].rstrip("/").lstrip("/"))
        found = with_keys(self.read().select(self.key, F.col("_metadata.file_path").alias("__file")), keys, self.key)
        paths = [unquote(r[0]) for r in found.select("__file").distinct().collect()]  # files, not rows
        return sorted(p.split(prefix + "/", 1)[1] for p in paths)

    def update(self, updates: DataFrame) -> tuple[int, int]:
        """Apply changed rows: of stored keys the fields that `updates` names replace the stored ones, other keys are added with
        the fields they have. How many files were rewritten, and the number of the version."""
        updates = stored(updates, "updates")
        if updates.isEmpty():
            return 0, self.version()
        if not updates.where(F.col(self.key).isNotNull()).groupBy(self.key).count().where("count > 1").isEmpty():
            raise ValueError(f"several updates of one {self.key}")
        version, live = self.version(), self.files()
        touched = self.touched(updates)
        schema = self.read(version).schema
        value = lambda f: F.col(f"__u.{f}") if f in updates.columns else F.lit(None)
        new = updates.select(F.col(self.key).alias("__k"), F.struct("*").alias("__u"))
        out, added = [], new
        if touched:
            old = self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in touched])
            both = old.join(small_or_shuffled(new), F.col(self.key) == F.col("__k"), "left")
            fresh = [F.when(F.col("__k").isNotNull(), value(f.name)).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in updates.columns else F.col(f.name) for f in schema]
            out += self._write(both.select(*fresh), len(touched))
            added = new.join(small_or_shuffled(stored(old.select(F.col(self.key).alias("__k")).distinct(), "known-keys")), "__k", "left_anti")
        added = added.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in schema])
        if not added.isEmpty():
            out += self._write(added)
        self._commit(version + 1, [*(f for f in live if f not in set(touched)), *out])
        return len(touched), version + 1


def changed_columns(df: DataFrame, **fields: Column) -> DataFrame:
    """Rows with these fields only where they differ (null-safely) from what the row holds: what an update should carry."""
    differs = F.lit(False)
    for name, value in fields.items():
        differs = differs | ~F.col(name).eqNullSafe(value)
    return df.where(differs).withColumns(fields)
