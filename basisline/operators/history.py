"""Price history: changes against earlier observations of the same key, and the 24-hour carry-forward of basis changes.

All of it is windows partitioned by the observation key, so one shuffle by key serves every column. Ties in time are
broken by an id, and `as of` times are parameters or columns, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def is_weekday(at: Column) -> Column:
    return F.weekday(at) < 5


def within_carry(now: Column, then: Column) -> Column:
    """Is a change of `then` still carried at `now`?"""
    return (now >= then) & (now - then <= F.expr("INTERVAL '24' HOUR"))


def prior_run(df: DataFrame, key: str, at: str, tie: str, *values: str) -> DataFrame:
    """Add prior_<value> (of the key's observation just before) and <value>_delta."""
    w = W.partitionBy(key).orderBy(at, tie)
    return df.withColumns({f"prior_{v}": F.lag(v).over(w) for v in values}).withColumns({f"{v}_delta": F.col(v) - F.col(f"prior_{v}") for v in values})


def carried_change(df: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """Add `change` and `changed_at`: a move stays visible while the value rests, for 24 hours.

    A differing value sets the change; an equal one inherits it as long as it is young enough; a missing one resets it.
    The state machine closes over the last move or reset of the key, so no row waits for its predecessor.
    """
    w = W.partitionBy(key).orderBy(at, tie)
    moved = F.col(value) - F.lag(value).over(w)
    mark = F.when(moved.isNull() | (moved != 0), F.struct(F.col(at).alias("at"), moved.alias("by")))
    last = F.last("__mark", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    out = df.withColumn("__mark", mark).withColumn("__last", last)
    ok = F.col("__last.by").isNotNull() & within_carry(F.col(at), F.col("__last.at"))
    zero = F.lit(0).cast(df.schema[value].dataType)
    out = out.withColumns({"change": F.when(ok, F.col("__last.by")).otherwise(zero), "changed_at": F.when(ok, F.col("__last.at"))})
    return out.drop("__mark", "__last")


def carried_change_on_weekdays(df: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """As `carried_change`, with weekend rows compared only within their own day.

    The row before is the latest one of the same day, or else of an earlier weekday. Weekday rows therefore never see a
    weekend; a weekend day starts from the last weekday row and then follows itself.
    """
    run = W.partitionBy(key).orderBy(at, tie)
    workday = is_weekday(F.col(at))
    kind = df.schema[value].dataType
    days = df.withColumn("__day", F.to_date(at)).withColumn("__weekday", workday)
    on_weekdays = carried_change(days.where("__weekday"), key, at, tie, value)
    weekend = days.where("not __weekday").withColumns({"change": F.lit(None).cast(kind), "changed_at": F.lit(None).cast(df.schema[at].dataType)})
    both = on_weekdays.unionByName(weekend)
    seed = F.last(F.when(F.col("__weekday"), F.struct(F.col(value).alias("value"), F.col("change").alias("change"), F.col("changed_at").alias("at"))), ignorenulls=True)
    both = both.withColumn("__seed", seed.over(run.rowsBetween(W.unboundedPreceding, -1)))
    day = W.partitionBy(key, "__day").orderBy(at, tie)
    before = F.when(F.row_number().over(day) == 1, F.col("__seed.value")).otherwise(F.lag(value).over(day))
    both = both.withColumn("__moved", F.col(value) - before)
    both = both.withColumn("__mark", F.when(F.col("__moved").isNull() | (F.col("__moved") != 0), F.struct(F.col(at).alias("at"), F.col("__moved").alias("by"))))
    both = both.withColumn("__last", F.last("__mark", ignorenulls=True).over(day.rowsBetween(W.unboundedPreceding, W.currentRow)))
    own = F.when(F.col("__last").isNotNull(), F.col("__last")).otherwise(F.struct(F.col("__seed.at").alias("at"), F.col("__seed.change").alias("by")))
    both = both.withColumn("__own", own)
    ok = F.col("__own.by").isNotNull() & F.coalesce(within_carry(F.col(at), F.col("__own.at")), F.lit(False))
    return both.select(
        *df.columns,
        F.when(F.col("__weekday"), F.col("change")).when(ok, F.col("__own.by")).otherwise(F.lit(0).cast(kind)).alias("change"),
        F.when(F.col("__weekday"), F.col("changed_at")).when(ok, F.col("__own.at")).alias("changed_at"),
    )


def strict_change(df: DataFrame, batch: str, key: str, at: str, tie: str, value: str) -> DataFrame:
    """Add prior_day, prior_day_value and strict_change: against the last weekday before the batch's day.

    The prior day is one per batch (a column naming the capture): the latest weekday before its day on which any of the
    batch's keys was seen. A key without a row on that day gets null, even if it was seen earlier.
    """
    seen = df.where(is_weekday(F.col(at))).select(F.col(key).alias("__k"), F.to_date(at).alias("__d"), F.col(at).alias("__at"), F.col(tie).alias("__tie"), F.col(value).alias("__v"))
    last_of_day = seen.groupBy("__k", "__d").agg(F.max_by("__v", F.struct("__at", "__tie")).alias("__v"))
    # For every key and day, its latest earlier weekday: a window over the days of the key, not a range join.
    days = df.select(F.col(key).alias("__k"), F.to_date(at).alias("__d")).distinct().join(last_of_day.select("__k", "__d", F.lit(1).alias("__w")), ["__k", "__d"], "left")
    before = F.last(F.when(F.col("__w") == 1, F.col("__d")), ignorenulls=True).over(W.partitionBy("__k").orderBy("__d").rowsBetween(W.unboundedPreceding, -1))
    days = days.withColumn("__before", before).select("__k", "__d", "__before")
    rows = df.withColumn("__d", F.to_date(at)).withColumn("__k", F.col(key))
    per_batch = rows.select(batch, "__k", "__d").distinct().join(days, ["__k", "__d"]).groupBy(batch).agg(F.max("__before").alias("prior_day"))
    rows = rows.join(per_batch, batch, "left")
    prior = last_of_day.select("__k", F.col("__d").alias("prior_day"), F.col("__v").alias("prior_day_value"))
    out = rows.join(prior, ["__k", "prior_day"], "left")
    return out.select(*df.columns, "prior_day", "prior_day_value", (F.col(value) - F.col("prior_day_value")).alias("strict_change"))


def previous_file(today: DataFrame, before: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """Add prior_<value>: from the previous file's last row of each key (by input position); and <value>_change."""
    last = before.groupBy(key).agg(F.max_by(value, position).alias(f"prior_{value}"))
    return today.join(last, key, "left").withColumn(f"{value}_change", F.col(value) - F.col(f"prior_{value}"))


def replayed(df: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """Backfill of a whole history: the carry policy with weekday rules, plus the change against the last weekday row.

    A replay's 'prior day' moves on with each weekday capture, so on a weekday it is simply the weekday row before.
    """
    w = W.partitionBy(key).orderBy(at, tie).rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(is_weekday(F.col(at)), F.struct(F.col(value).alias("v"))), ignorenulls=True).over(w)
    return carried_change_on_weekdays(df, key, at, tie, value).withColumn("__prior", last).withColumn("strict_change", F.col(value) - F.col("__prior.v")).drop("__prior")


def changed_only(current: DataFrame, desired: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of `desired` that differ (null-safely) from `current` in any of the columns, or are new: what to write back."""
    old = current.select(F.col(key), *[F.col(c).alias(f"__old_{c}") for c in columns], F.lit(True).alias("__there"))
    differs = F.col("__there").isNull()
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__old_{c}"))
    return desired.join(old, key, "left").where(differs).select(desired.columns)
