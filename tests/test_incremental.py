"""Batches against the latest state of each key, and tables that become visible together."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from basisline.operators import history, latest
from basisline.plans import ingest, ingest_queries
from basisline.sources import bucketed, transactions

ROWS = "composite_key string, captured_at timestamp_ntz, position int, basis double, cash double"
START = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(k, START + dt.timedelta(hours=h), n, *v) for k, h, n, *v in rows], ROWS)


def batches(rng, keys, n):
    """Rows (key, hour, position, basis, cash) of n batches, several of a key in a batch, values that rest, move and miss."""
    out, at = [], 0
    for b in range(n):
        rows = []
        for k in keys:
            rows += [(k, b * 10 + rng.randrange(5), (at := at + 1), rng.choice([1.0, 1.0, 1.5, None]), rng.choice([5.0, 6.0])) for _ in range(rng.randrange(3))]
        out.append(rows)
    return out


def test_state_gives_what_the_history_gives(spark, tmp_path):
    rng = random.Random(4)
    parts = batches(rng, [f"k{i}" for i in range(30)], 6)
    got, state = [], None
    for n, rows in enumerate(parts):
        out = latest.changed(frame(spark, rows), state, "composite_key", "captured_at", "position", ["basis", "cash"], "basis", 4)
        got += out.collect()
        path = f"file://{tmp_path}/s{n}"
        bucketed.write_bucketed(latest.next_state(out, state, "composite_key", "captured_at", "position", ["basis", "cash"]), path, "composite_key", 4)
        state = bucketed.read_bucketed(spark, path, "composite_key", 4)
    whole = frame(spark, [r for rows in parts for r in rows])
    whole = history.carried_change(history.prior_run(whole, "composite_key", "captured_at", "position", "basis", "cash"), "composite_key", "captured_at", "position", "basis")
    cols = ["position", "prior_basis", "basis_delta", "prior_cash", "cash_delta", "change", "changed_at"]
    assert sorted(str([r[c] for c in cols]) for r in got) == sorted(str([r[c] for c in cols]) for r in whole.collect())


def test_late_rows_and_null_keys(spark, tmp_path):
    first = latest.changed(frame(spark, [("k", 5, 1, 1.0, 2.0), (None, 5, 2, 1.0, 2.0)]), None, "composite_key", "captured_at", "position", ["basis"], "basis", 2)
    path = f"file://{tmp_path}/s"
    bucketed.write_bucketed(latest.next_state(first, None, "composite_key", "captured_at", "position", ["basis"]), path, "composite_key", 2)
    state = bucketed.read_bucketed(spark, path, "composite_key", 2)
    assert [r.composite_key for r in state.collect()] == ["k"]
    second = latest.changed(frame(spark, [("k", 4, 3, 9.0, 2.0), ("k", 6, 4, 3.0, 2.0), (None, 6, 5, 7.0, 2.0)]), state, "composite_key", "captured_at", "position", ["basis"], "basis", 2)
    assert {r.position: (r.late, r.prior_basis, r.change) for r in second.collect()} == {3: (True, None, None), 4: (False, 1.0, 2.0), 5: (False, None, 0.0)}
    after = latest.next_state(second, state, "composite_key", "captured_at", "position", ["basis"]).collect()
    assert [(r.composite_key, r["last"].basis, r.mark.by) for r in after] == [("k", 3.0, 2.0)]
    empty = latest.changed(frame(spark, []), state, "composite_key", "captured_at", "position", ["basis"], "basis", 2)
    assert empty.count() == 0 and latest.next_state(empty, state, "composite_key", "captured_at", "position", ["basis"]).count() == 1


def shuffled_scans(plan, name):
    """Does any Exchange of a physical plan stand above a scan of this table?"""
    text = plan.treeString() if hasattr(plan, "treeString") else str(plan)
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    above = []
    for line in text.split("\n"):
        d = depth(line)
        above = [(x, n) for x, n in above if x < d]
        if name in line and "Scan" in line and any(n for _, n in above):
            return True
        above.append((d, "Exchange" in line))
    return False


def test_the_state_is_read_without_a_shuffle(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    rows = frame(spark, [(f"k{i}", 5, i, 1.0, 2.0) for i in range(100)])
    bucketed.write_bucketed(latest.next_state(latest.changed(rows, None, "composite_key", "captured_at", "position", ["basis"], "basis", 8), None, "composite_key", "captured_at", "position", ["basis"]), path, "composite_key", 8)
    bucketed.forget(spark, path)  # as in another session
    state = bucketed.read_bucketed(spark, path, "composite_key", 8)
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = latest.changed(rows, state, "composite_key", "captured_at", "position", ["basis"], "basis", 8)
        after = latest.next_state(out, state, "composite_key", "captured_at", "position", ["basis"])
        for df in (out, after):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and plan.count("Scan parquet") >= 1 and not shuffled_scans(plan, "basisline_")
            assert plan.count("Exchange hashpartitioning") == 1  # that of the batch
        assert after.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)


def test_a_batch_that_breaks_off_shows_nothing(spark, sf, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/r"
    rows = lambda n: ingest.normalized(ingest_queries.sheet(spark, sf, n, 3), "position", ingest_queries.OPTIONS)
    at = lambda n: F.lit(ingest_queries.BATCH_TIMES[n]).cast("timestamp_ntz")
    assert transactions.committed(spark, root, "runs") is None and transactions.latest(spark, root, "state") is None
    assert ingest.ingest_batch(rows(0), root, 0, "feed", at(0), 4)
    before = transactions.committed(spark, root, "observations").count()
    real = transactions.Transaction.stage

    def fails(self, table, df):
        if table == "runs":
            raise OSError("disk gone")
        return real(self, table, df)

    monkeypatch.setattr(transactions.Transaction, "stage", fails)
    with pytest.raises(OSError, match="disk gone"):
        ingest.ingest_batch(rows(1), root, 1, "feed", at(1), 4)
    monkeypatch.setattr(transactions.Transaction, "stage", real)
    assert transactions.committed(spark, root, "observations").count() == before and transactions.committed(spark, root, "runs").count() == 1
    assert transactions.latest(spark, root, "state")[0] == 0 and not transactions.is_committed(spark, root, 1)
    assert transactions.vacuum(spark, root) == 2  # its observations and its state
    assert ingest.ingest_batch(rows(1), root, 1, "feed", at(1), 4) and not ingest.ingest_batch(rows(1), root, 1, "feed", at(1), 4)
    assert transactions.committed(spark, root, "runs").count() == 2 and transactions.vacuum(spark, root) == 0


def test_of_two_attempts_one_is_seen(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    one, two = transactions.Transaction(spark, root, 7), transactions.Transaction(spark, root, 7)
    one.stage("t", spark.range(3))
    two.stage("t", spark.range(5))
    assert two.commit() and not one.commit()
    assert transactions.committed(spark, root, "t").count() == 5 and transactions.committed(spark, root, "u") is None
    with pytest.raises(ValueError, match="committed already"):
        transactions.Transaction(spark, root, 7).stage("t", spark.range(1))
    third = transactions.Transaction(spark, root, 8)
    third.stage("t", spark.range(0))
    assert third.commit() and sorted(r.batch for r in transactions.manifest(spark, root).collect()) == [7, 8]


def test_a_batch_normalizes_its_sheet_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "stored", lambda df, name: kept.append(df) or df.limit(0), raising=False)
    kept: list = []
    rows = spark.createDataFrame([(1, ["missing_basis"], "k")], "position int, reasons array<string>, composite_key string")
    rows = rows.selectExpr("*", "'x' as futures_text", *[f"cast(1 as double) as {c}" for c in ingest.PRICES])
    assert ingest.ingest_batch(rows, f"file://{tmp_path}/r", 0, "feed", F.lit("1999-01-04").cast("timestamp_ntz"), 2)
    assert kept == [rows]  # everything that follows reads the stored rows
    assert transactions.committed(spark, f"file://{tmp_path}/r", "runs").first().raw_row_count == 0
