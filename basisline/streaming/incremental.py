"""Structured Streaming forms of the stateful parts: carried basis changes and alerts, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from basisline.operators import alerts
from basisline.plans import ingest

CARRY_US = 24 * 3600 * 1_000_000
_STATE = "value double, change double, changed_us long, at_us long"


def carried_rows(rows: pd.DataFrame, at_us: str, tie: str, value: str, state: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
    """One key's new rows with late, change and changed_us, and its next state (value, change, changed_us, at_us).

    Times are microseconds. Rows are put in time order; those older than the state's time are late, have no change and leave
    the state as it is.
    """
    last, change, since, seen = state if state is not None else (None, None, None, None)
    pdf = rows.sort_values([at_us, tie], ignore_index=True)
    pdf["late"] = False if seen is None else pdf[at_us] < seen
    on_time = pdf[~pdf["late"]]
    if len(on_time):
        # The state stands before the batch as a row of its own; marks are moves and resets, the last one holds.
        before = on_time[value].shift(1, fill_value=float("nan") if last is None else last)
        moved = on_time[value] - before
        mark = moved.isna() | (moved != 0)
        by = moved.where(mark).where(moved.notna(), 0.0).where(mark).ffill().fillna(0.0 if change is None else change)
        marked_at = on_time[at_us].astype("Int64").where(mark & moved.notna()).where(~mark | moved.notna())
        run = mark.cumsum()
        marked_at = marked_at.groupby(run).transform("first")
        if since is not None:
            marked_at = marked_at.where(run > 0, since)
        ok = (marked_at.notna() & (on_time[at_us] - marked_at <= CARRY_US)).fillna(False).astype(bool)
        pdf.loc[on_time.index, "change"] = by.where(ok, 0.0)
        pdf["changed_us"] = marked_at.where(ok).reindex(pdf.index)
        end = on_time.index[-1]
        now = on_time[value].iloc[-1]
        state = (None if pd.isna(now) else float(now), float(pdf.loc[end, "change"]), None if pd.isna(pdf.loc[end, "changed_us"]) else int(pdf.loc[end, "changed_us"]), int(on_time[at_us].iloc[-1]))
    else:
        pdf["change"], pdf["changed_us"] = float("nan"), pd.array([None] * len(pdf), dtype="Int64")
    return pdf, state


def carried_stream(rows: DataFrame, key: str, at_us: str, tie: str, value: str) -> DataFrame:
    """Streaming `carried_change`: key, tie, at_us, value, change, changed_us, late of every row, appended.

    State is one small tuple per key, kept for ever (see `expiring.carried_with_expiry` for keys that end); rows of a key
    within a micro-batch are put in time order, so it equals the batch form as long as batches themselves come in order. A
    row older than what its key has seen in an earlier batch comes out with `late` true and no change.
    """
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    output = f"{key} {kind[key]}, {tie} {kind[tie]}, {at_us} long, {value} double, change double, changed_us long, late boolean"

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf, new = carried_rows(pd.concat(list(frames)), at_us, tie, value, state.get if state.exists else None)
        if new is not None:
            state.update(new)
        yield pd.DataFrame({key: group[0], tie: pdf[tie], at_us: pdf[at_us], value: pdf[value], "change": pdf["change"], "changed_us": pdf["changed_us"].astype("Int64"), "late": pdf["late"]})

    return rows.select(key, tie, at_us, value).groupBy(key).applyInPandasWithState(step, output, _STATE, "append", GroupStateTimeout.NoTimeout)


def alert_sink(rules: DataFrame, alerts_path: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: writes a batch's new alerts that no open one of other batches repeats.

    `make` turns triggered rows into (rule_id, message, status, triggered_at). A batch owns the partition of its number and
    replaces it, so a batch that runs again after a failure adds nothing twice and leaves no half of its files behind.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = make(alerts.triggered(batch, rules)).dropDuplicates(["rule_id", "message"])
        try:
            known = spark.read.parquet(alerts_path)
        except AnalysisException as e:  # the first batch finds no table
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            found = alerts.without_open(found, known.where(F.col("batch") != number))
        found.write.mode("overwrite").parquet(f"{alerts_path}/batch={number}")

    return write


def ingest_sink(root: str, source: str, position: str, at: str, options: ingest.SheetOptions | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: a batch of sheet rows becomes observations, one run record and the next latest state, visible
    together under `root` (see `ingest.ingest_batch`). A batch that runs again after its commit changes nothing.

    `at` is the capture time column of the sheet.
    """

    def write(batch: DataFrame, number: int) -> None:
        captured = batch.agg(F.max(at)).first()[0]
        if captured is not None:  # something arrived
            ingest.ingest_batch(ingest.normalized(batch.drop(at), position, options), root, number, source, F.lit(captured), buckets)

    return write


def latest_first(rows: DataFrame, path: str, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run what has arrived through a sink once and stop."""
    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
