"""The delivery ledger through crashes, facets from day states, workbooks that are read back."""

import glob
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from basisline.operators import facet_states
from basisline.sources import office, transactions
from basisline.sources.workbooks import write_workbooks
from basisline.streaming.ledger import Ledger


def test_crashes_neither_skip_nor_repeat(spark, tmp_path, monkeypatch):
    people = spark.createDataFrame([(i, i % 5 != 0) for i in range(20)] + [(None, True)], "subscriber_id long, is_active boolean")
    ledger, inbox = Ledger(spark, f"file://{tmp_path}/l", "2024-05-01"), {}

    def deliver(rows):  # the receiver drops repeated tokens
        for r in rows:
            inbox.setdefault(r.token, r.subscriber_id)

    first = ledger.reserve(people).collect()
    assert len(first) == 16
    deliver(first[:7])  # the run dies here, before any confirmation
    again = ledger.reserve(people).collect()
    assert sorted(again) == sorted(first)  # same attempts, same tokens
    deliver(again)
    monkeypatch.setattr(transactions.Transaction, "commit", lambda self: (_ for _ in ()).throw(OSError("gone")))
    done = spark.createDataFrame([(r.subscriber_id, r.attempt, r.subscriber_id != 3) for r in again], "subscriber_id long, attempt int, sent boolean")
    with pytest.raises(OSError, match="gone"):
        ledger.confirm(done)  # dies before the confirmation is seen
    monkeypatch.undo()
    assert len(ledger.reserve(people).collect()) == 16
    ledger.confirm(done)
    ledger.confirm(done.limit(0))
    assert ledger.reserve(people).collect() == [] and sorted(inbox.values()) == sorted(r.subscriber_id for r in first)
    retry = ledger.reserve(people, retry_failed=True).collect()
    assert [(r.subscriber_id, r.attempt) for r in retry] == [(3, 1)] and retry[0].token not in inbox
    ledger.confirm(spark.createDataFrame([(3, 1, True), (999, 0, True)], "subscriber_id long, attempt int, sent boolean"))
    assert ledger.reserve(people, retry_failed=True).collect() == [] and ledger.state().where("phase = 'sent'").count() == 16
    assert Ledger(spark, f"file://{tmp_path}/l", "2024-05-02").reserve(people).count() == 16


def test_of_two_writers_one_reserves(spark, tmp_path, monkeypatch):
    people = spark.createDataFrame([(1, True)], "subscriber_id long, is_active boolean")
    one, two = Ledger(spark, f"file://{tmp_path}/l", "a"), Ledger(spark, f"file://{tmp_path}/l", "a")
    real, raced = transactions.Transaction.commit, []

    def late(self):
        if not raced:
            raced.append(1)
            two.reserve(people)
        return real(self)

    monkeypatch.setattr(transactions.Transaction, "commit", late)
    assert [(r.subscriber_id, r.attempt) for r in one.reserve(people).collect()] == [(1, 0)]
    assert one.entries().count() == 1


def test_facets_from_day_states(spark):
    rng = random.Random(3)
    rows = [(d, rng.choice(["Corn", "corn ", "Soy", None]), rng.choice([f"k{i}" for i in range(50)] + [None])) for d in range(12) for _ in range(80)]
    df = spark.createDataFrame(rows, "day int, label string, key string")
    old = facet_states.numbered(df.where("day < 6"))
    numbers = facet_states.numbered(df, old)
    assert numbers.join(old, ["key", "number"]).count() == old.count() and numbers.select("number").distinct().count() == numbers.count() == 50
    states = facet_states.day_states(df.where("day < 6"), numbers).unionByName(facet_states.day_states(df.where("day >= 6"), numbers))
    canonical = F.initcap(F.trim("label"))
    for lo, hi in ((None, None), (3, 8), (0, 0), (50, 60)):
        sets = {}
        for d, label, key in rows:
            if label and key and (lo is None or lo <= d <= hi):
                sets.setdefault(label.strip().title(), set()).add(key)
        assert {r.name: r.market_count for r in facet_states.facet(states, lo, hi, canonical).collect()} == {k: len(v) for k, v in sets.items()}
    assert {r.name: r.variants for r in facet_states.canonical_facet(df, canonical).collect()} == {"Corn": 2, "Soy": 1}


def test_workbooks_round_trip(spark, tmp_path):
    rows = [("a", "GLG: x", i, f"place {i} <&> é\x01", i / 4, None if i % 3 else "=SUM(A1)", i % 2 == 0) for i in range(25)] + [("a", "Other", 1, "only", float("nan"), "", True), ("b/c", None, 1, "p", 1.5, "q", None)]
    df = spark.createDataFrame(rows, "book string, source string, at int, Location string, Basis double, Note string, Flag boolean").repartition(5)
    out = {r.file: (r.sheets, r.n_rows) for r in write_workbooks(df, f"file://{tmp_path}/out", "book", "source", "at", limit=11).collect()}
    assert out == {"a": (4, 26), "b/c": (1, 1)}
    files = sorted(os.path.basename(f) for f in glob.glob(f"{tmp_path}/out/*"))
    assert files == ["a.xlsx", "b_c.xlsx"] and all(zipfile.ZipFile(f"{tmp_path}/out/{f}").testzip() is None for f in files)
    back = office.read_workbooks(spark, f"{tmp_path}/out/*.xlsx").collect()
    assert {r.sheet for r in back if r.path.endswith("a.xlsx")} == {"GLG  x", "GLG  x (2)", "GLG  x (3)", "Other"}
    assert all(r.headers == ["Location", "Basis", "Note", "Flag"] for r in back)
    got = [r.cells for r in sorted(back, key=lambda r: (r.path, r.sheet, r.position)) if r.sheet.startswith("GLG")]
    assert got == [[f"place {i} <&> é", str(i / 4), None if i % 3 else "=SUM(A1)", "1" if i % 2 == 0 else "0"] for i in range(25)]
    assert [r.cells for r in back if r.sheet == "Other"] == [["only", None, "", "1"]]
