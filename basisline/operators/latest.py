"""Changes of a new batch against the latest state of each key, instead of windows over the whole history.

The state has one row a key: its last values, its time, and the last move or reset of the carried value. A batch is dealt by
key into as many parts as the state has buckets; everything else happens within these parts, so the state is read in place and
no history at all: the cost of a batch follows its own rows and the number of keys.

Edge cases: a key without state starts like the first row of a history; rows of a key within the batch stand in order of time
and tie; a row older than its key's state is `late`, has no changes and leaves the state as it is; a null value resets the
carried change; a row with a null key has no history: it starts anew in each batch and is not kept in the state; an empty
batch gives no rows and leaves the state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basisline.operators.history import within_carry


def changed(batch: DataFrame, state: DataFrame | None, key: str, at: str, tie: str, values: Sequence[str], carried: str, buckets: int) -> DataFrame:
    """The batch with late, prior_<value> and <value>_delta of every value, change and changed_at of the carried one, and
    `__mark` (the carried value's last move or reset), which `next_state` stores."""
    dealt = batch.repartition(buckets, key)
    if state is None:
        out = dealt.withColumn("__seen", F.lit(None).cast(batch.schema[at].dataType))
        had = lambda v: F.lit(None).cast(batch.schema[v].dataType)
        old_mark = F.lit(None).cast(f"struct<at: {batch.schema[at].dataType.simpleString()}, by: {batch.schema[carried].dataType.simpleString()}>")
    else:
        old = state.select(F.col(key).alias("__state_key"), F.col("seen_at").alias("__seen"), F.col("last").alias("__last"), F.col("mark").alias("__old"))
        out = dealt.join(old, F.col(key) == F.col("__state_key"), "left").drop("__state_key")
        had = lambda v: F.col(f"__last.{v}")
        old_mark = F.col("__old")
    out = out.withColumn("late", F.coalesce(F.col(at) < F.col("__seen"), F.lit(False)))
    w = W.partitionBy(key, "late").orderBy(at, tie)
    first = F.row_number().over(w) == 1
    priors = {f"prior_{v}": F.when(~F.col("late"), F.when(first, had(v)).otherwise(F.lag(v).over(w))) for v in values}
    out = out.withColumns(priors).withColumns({f"{v}_delta": F.col(v) - F.col(f"prior_{v}") for v in values})
    moved = F.col(f"{carried}_delta")
    out = out.withColumn("__own", F.when(~F.col("late") & (moved.isNull() | (moved != 0)), F.struct(F.col(at).alias("at"), moved.alias("by"))))
    out = out.withColumn("__mark", F.coalesce(F.last("__own", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), old_mark))
    ok = ~F.col("late") & F.col("__mark.by").isNotNull() & within_carry(F.col(at), F.col("__mark.at"))
    zero = F.when(~F.col("late"), F.lit(0).cast(batch.schema[carried].dataType))
    out = out.withColumns({"change": F.when(ok, F.col("__mark.by")).otherwise(zero), "changed_at": F.when(ok, F.col("__mark.at"))})
    return out.drop("__seen", "__last", "__old", "__own")


def next_state(changes: DataFrame, state: DataFrame | None, key: str, at: str, tie: str, values: Sequence[str]) -> DataFrame:
    """The state after a batch: keys of the batch have its last row that isn't late, all others stay."""
    row = F.struct(F.col(at).alias("seen_at"), F.struct(*[F.col(v) for v in values]).alias("last"), F.col("__mark").alias("mark"))
    new = changes.where(~F.col("late") & F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, F.struct(at, tie)).alias("__new"))
    if state is None:
        return new.select(key, "__new.*")
    old = state.select(F.col(key).alias("__state_key"), F.struct("seen_at", "last", "mark").alias("__state"))
    both = new.join(old, F.col(key) == F.col("__state_key"), "full_outer")
    return both.select(F.coalesce(key, "__state_key").alias(key), F.coalesce("__new", "__state").alias("__s")).select(key, "__s.*")
