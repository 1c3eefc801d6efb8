"""Streams with a watermark: keys that are forgotten, repeats across batches, closed windows."""

import datetime as dt

import pytest

from basisline.streaming import expiring

START = dt.datetime(2024, 1, 1)
ROWS = "key string, tie long, at timestamp, value double"


def at(hours):
    return START + dt.timedelta(hours=hours)


@pytest.fixture()
def stream(spark, tmp_path):
    """feed(rows, make): writes the rows as one more file and runs the stream over what has come; rows that came out."""
    for k, v in expiring.state_settings().items():
        spark.conf.set(k, v)
    n = [0]

    def feed(rows, make, name="q"):
        n[0] += 1
        spark.createDataFrame([(k, t, at(h), v) for k, t, h, v in rows], ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/b{n[0]:03d}")
        out = []
        source = spark.readStream.schema(ROWS).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        query = make(source).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination()
        return out

    yield feed
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_keys_expire(spark, stream, tmp_path):
    make = lambda s: expiring.carried_with_expiry(s, "key", "at", "tie", "value", keep_hours=24)
    kept = lambda: sorted(r.key.key for r in spark.read.format("statestore").option("stateVarName", "carry").load(f"{tmp_path}/q").collect())
    got = {r.tie: (r.change, r.late) for r in stream([("a", 1, 0, 5.0), ("a", 2, 1, 6.0), ("b", 3, 1, 2.0)], make)}
    assert got == {1: (0.0, False), 2: (1.0, False), 3: (0.0, False)} and kept() == ["a", "b"]
    got = {r.tie: r.change for r in stream([("b", 4, 20, 2.5), ("a", 5, 12, 6.0)], make)}
    assert got == {4: 0.5, 5: 1.0}  # the move of 1 h is carried at 12 h
    stream([("b", 6, 42, 2.5)], make)  # a was last seen at 12 h: it ends at 36 h
    got = {r.tie: r.change for r in stream([("a", 7, 43, 9.0), ("b", 8, 43, 2.0)], make)}
    assert got[8] == -0.5 and got[7] == 0.0 and kept() == ["a", "b"]  # a starts anew
    stream([("b", 9, 90, 2.0)], make)
    stream([("b", 10, 91, 3.0)], make)
    assert kept() == ["b"]


def test_late_rows_within_the_watermark(stream):
    make = lambda s: expiring.carried_with_expiry(s, "key", "at", "tie", "value", delay="5 hours")
    stream([("a", 1, 10, 5.0)], make)
    got = {r.tie: (r.late, r.change) for r in stream([("a", 2, 9, 7.0), ("a", 3, 11, 6.0), ("a", 4, 1, 1.0)], make)}
    assert got[3] == (False, 1.0) and got[2][0] is True and 4 not in got  # the row of 1 h is behind the watermark


def test_repeated_deliveries(spark, stream):
    make = lambda s: expiring.delivered_once(s, ["key", "tie"], "at", "10 hours")
    assert sorted((r.key, r.tie) for r in stream([("a", 1, 0, 1.0), ("a", 1, 0, 1.0), ("a", 2, 1, 1.0)], make)) == [("a", 1), ("a", 2)]
    assert [(r.key, r.tie) for r in stream([("a", 1, 0, 1.0), ("a", 3, 2, 1.0), ("a", 2, 1, 1.0)], make)] == [("a", 3)]
    stream([("z", 9, 40, 1.0)], make)
    assert [(r.key, r.tie) for r in stream([("a", 1, 0, 1.0), ("a", 4, 41, 1.0)], make)] == [("a", 4)]  # too late, and gone from the state


def test_last_rows_of_closed_windows(stream):
    make = lambda s: expiring.last_of_window(s, ["key"], "at", "tie", "1 day", "2 hours")
    assert stream([("a", 1, 1, 1.0), ("a", 2, 5, 2.0), ("b", 3, 2, 9.0)], make) == []
    out = stream([("a", 4, 5, 3.0), ("a", 5, 30, 4.0)], make) + stream([("a", 6, 31, 5.0)], make)
    assert {r.key: (r.tie, r.value, r.repeats) for r in out} == {"a": (4, 3.0, 2), "b": (3, 9.0, 0)}
