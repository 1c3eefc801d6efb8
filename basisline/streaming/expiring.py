"""Streams whose state ends: carried changes of keys that are forgotten, repeated deliveries dropped, last rows of a window.

All of it follows event time and a watermark, so what is kept is bounded by the rows of the time kept, whatever the stream's
age. State lives in RocksDB (`state_settings`), since it may exceed an executor's heap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from basisline.streaming.incremental import carried_rows

HOUR_MS = 3600 * 1000


def state_settings() -> dict[str, str]:
    """What a session needs for the operators here."""
    return {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class CarriedChange(StatefulProcessor):
    """Value state of one key and one timer: the state goes when its key has not been seen for `keep_ms` of event time."""

    def __init__(self, key: str, at_us: str, tie: str, value: str, keep_ms: int):
        self.names, self.keep_ms = (key, at_us, tie, value), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carry = handle.getValueState("carry", "value double, change double, changed_us long, at_us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        name, at_us, tie, value = self.names
        pdf, new = carried_rows(pd.concat(list(rows)), at_us, tie, value, self.carry.get() if self.carry.exists() else None)
        if new is not None:
            self.carry.update(new)
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(new[3] // 1000 + self.keep_ms)
        yield pd.DataFrame({name: key[0], tie: pdf[tie], at_us: pdf[at_us], value: pdf[value], "change": pdf["change"], "changed_us": pdf["changed_us"].astype("Int64"), "late": pdf["late"]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.carry.clear()
        return iter(())

    def close(self) -> None:
        pass


def carried_with_expiry(rows: DataFrame, key: str, at: str, tie: str, value: str, keep_hours: int = 14 * 24, delay: str = "1 hour") -> DataFrame:
    """Streaming `carried_change` by timestamp `at`, with keys forgotten `keep_hours` after their last row.

    It equals the batch form for keys whose rows are never further apart than that; a key that comes back later starts anew.
    Rows that come later than `delay` behind the newest are dropped by the watermark; `late` marks those within it that are
    older than what their key has seen.
    """
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    output = f"{key} {kind[key]}, {tie} {kind[tie]}, at_us long, {value} double, change double, changed_us long, late boolean"
    timed = rows.withWatermark(at, delay).select(key, tie, at, F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"), F.col(value).cast("double").alias(value))
    return timed.groupBy(key).transformWithStateInPandas(CarriedChange(key, "at_us", tie, value, keep_hours * HOUR_MS), output, "Append", "EventTime")


def delivered_once(rows: DataFrame, keys: list[str], at: str, delay: str = "1 day") -> DataFrame:
    """The first delivery of each key: repeats within `delay` of event time are dropped, in whatever batch they come.

    A key is remembered until the watermark has passed its time by `delay`, so state is bounded; rows behind the watermark
    are dropped as too late.
    """
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def last_of_window(rows: DataFrame, keys: list[str], at: str, position: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """The last row of each key and window with `repeats`, how many rows it replaced; it comes once its window is closed."""
    rest = [c for c in rows.columns if c not in keys]
    grouped = rows.withWatermark(at, delay).groupBy(F.window(at, window).alias("__w"), *keys)
    out = grouped.agg(F.max_by(F.struct(*rest), F.struct(at, position)).alias("__r"), (F.count(F.lit(1)) - 1).alias("repeats"))
    return out.select(*keys, "__r.*", "repeats", F.col("__w.start").alias("window_start"))
