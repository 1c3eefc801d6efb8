"""Updates that rewrite only the files they touch, reads that skip row groups, searches by distinct labels."""

import random
import re

import pytest
from pyspark.sql import functions as F

from basisline.operators.label_index import LabelIndex
from basisline.sources.filetable import FileTable, changed_columns, with_keys, write_skippable


def rows_read(df):
    """Rows that the file scans of a query gave out, after it ran."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollectPublic()

    def scans(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return scans(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return scans(plan.plan())
        if name == "FileSourceScanExec":
            return plan.metrics().apply("numOutputRows").value()
        kids = plan.children()
        return sum(scans(kids.apply(i)) for i in range(kids.size()))

    return scans(execution.executedPlan())


def test_unaffected_files_keep_their_names(spark, tmp_path):
    t = FileTable(spark, f"file://{tmp_path}/t x", "id")
    t.create(spark.range(1000).select("id", (F.col("id") % 7).alias("v"), F.lit("old").alias("note")), 10)
    before = t.files()
    assert len(before) == 10 and t.version() == 1
    changed = spark.createDataFrame([(3, 100), (4, None), (2000, 5), (None, 6)], "id long, v long")
    assert t.update(changed) == (1, 2)
    after = t.files()
    assert len(set(before) & set(after)) == 9 and t.version() == 2
    got = {r.id: (r.v, r.note) for r in t.read().collect()}
    want = {i: (i % 7, "old") for i in range(1000)} | {3: (100, "old"), 4: (None, "old"), 2000: (5, None), None: (6, None)}
    assert got == want and t.read().count() == 1002
    assert t.read(1).count() == 1000 and t.read(1).where("id = 3").first().v == 3  # the version before
    assert t.update(changed.limit(0)) == (0, 2)
    with pytest.raises(ValueError, match="several updates"):
        t.update(spark.createDataFrame([(1, 1), (1, 2)], "id long, v long"))
    with pytest.raises(RuntimeError, match="another job"):
        t._commit(2, [])
    assert t.update(spark.createDataFrame([(9000, 1)], "id long, v long")) == (0, 3)
    few = changed_columns(spark.createDataFrame([(1, "a"), (2, None)], "id long, v string"), v=F.lit("a"))
    assert [r.id for r in few.collect()] == [2]


def test_keyed_reads_skip_row_groups(spark, tmp_path):
    path = f"file://{tmp_path}/h"
    history = spark.range(200_000).select(F.concat(F.lit("key "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("composite_key"), F.rand(1).alias("basis"))
    write_skippable(history, path, "composite_key", files=4, row_group_bytes=1 << 18, distinct_keys=50_000)
    stored = spark.read.parquet(path)
    keys = spark.createDataFrame([("key 000123",), ("key 150000",), ("missing",), (None,)], "composite_key string")
    few = with_keys(stored, keys, "composite_key")
    assert "PushedFilters: [In(composite_key" in few._jdf.queryExecution().executedPlan().toString()
    assert rows_read(few) < 60_000 and few.count() == 2
    assert rows_read(with_keys(stored, keys.limit(1), "composite_key")) < 30_000
    many = with_keys(stored, history.select("composite_key").limit(3000), "composite_key")
    assert many.count() == 3000


def test_searches_by_label(spark, tmp_path):
    rng = random.Random(5)
    labels = ["Dover Corn", "DOVER  soybeans", "Port Lambton", "Öl Mühle", "a", "ab", "abab", "", None, "100% %_x", "aaa aaaa"]
    history = spark.createDataFrame([(i, rng.choice(labels)) for i in range(4000)], "id long, label string")
    path = f"file://{tmp_path}/h"
    write_skippable(history, path, "label", files=2)
    stored = spark.read.parquet(path)
    index = LabelIndex.of(stored.where("id < 3000"), "label").grown(stored.where("id >= 3000"))
    for text in ("dover", "OVER", "mühle", "ab", "a", "", "abab", "%_x", "0%", "aaaa", "nothing here", "r  s"):
        want = {r.id for r in stored.where(F.contains(F.lower("label"), F.lit(text.lower()))).collect()}
        found = index.search(stored, text)
        assert {r.id for r in found.collect()} == want, text
    plan = index.search(stored, "dover")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[In\(label, \[(DOVER  soybeans|Dover Corn),", plan)
