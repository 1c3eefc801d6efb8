"""A delivery ledger in two phases: reserve, send, confirm. A run that stops anywhere neither skips nor repeats a subscriber.

Every step is one transaction of the issue's own ledger. A reservation gives a subscriber an attempt and a token that follows
from issue, subscriber and attempt; a run after a crash gets the reservations that have no outcome again, with the same
tokens, so a receiver that drops repeated tokens gets each issue once, whether the crash came before or after the sending.

Edge cases: inactive subscribers are never reserved; sent ones never again; failed ones on request, as their next attempt;
outcomes without a reservation are ignored; of several outcomes of one attempt 'sent' counts; null subscribers are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.sources import transactions
from basisline.storage import stored

ENTRY = "subscriber_id long, attempt int, phase string"
PHASES = ("reserved", "failed", "sent")  # the furthest of an attempt counts


@dataclass(frozen=True)
class Ledger:
    """The ledger of one issue under `root`: issues have folders and writers of their own."""

    spark: SparkSession
    root: str
    issue: str

    @property
    def path(self) -> str:
        return f"{self.root}/issue={self.issue}"

    def entries(self) -> DataFrame:
        found = transactions.committed(self.spark, self.path, "entries", ENTRY)
        return self.spark.createDataFrame([], ENTRY) if found is None else found.select("subscriber_id", "attempt", "phase")

    def state(self) -> DataFrame:
        """subscriber_id, attempt (the last) and phase of it, for every subscriber with a reservation."""
        rank = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase"))
        by_attempt = self.entries().groupBy("subscriber_id", "attempt").agg(F.max(F.struct(rank.alias("r"), "phase")).alias("p"), F.max(F.col("phase") == "reserved").alias("known")).where("known")
        return by_attempt.groupBy("subscriber_id").agg(F.max(F.struct("attempt", F.col("p.phase").alias("phase"))).alias("s")).select("subscriber_id", "s.*")

    def _append(self, rows: DataFrame) -> bool:
        done = transactions.manifest(self.spark, self.path).agg(F.max("batch")).first()[0]
        step = transactions.Transaction(self.spark, self.path, 0 if done is None else done + 1)
        step.stage("entries", rows)
        return step.commit()

    def reserve(self, subscribers: DataFrame, retry_failed: bool = False) -> DataFrame:
        """Who is to be sent the issue now: subscriber_id, attempt, token. New reservations are in the ledger before they are
        returned; another writer of the issue at the same time makes this one look again."""
        active = subscribers.where("is_active and subscriber_id is not null").select(F.col("subscriber_id").cast("long").alias("subscriber_id")).distinct()
        while True:
            state = stored(self.state(), "ledger-state")
            fresh = active.join(state, "subscriber_id", "left_anti").withColumn("attempt", F.lit(0))
            if retry_failed:
                again = state.where("phase = 'failed'").join(active, "subscriber_id", "left_semi").select("subscriber_id", (F.col("attempt") + 1).alias("attempt"))
                fresh = fresh.unionByName(again)
            fresh = stored(fresh.select("subscriber_id", F.col("attempt").cast("int").alias("attempt"), F.lit("reserved").alias("phase")), "reservations")
            if fresh.isEmpty() or self._append(fresh):
                break
        waiting = state.where("phase = 'reserved'").join(active, "subscriber_id", "left_semi").select("subscriber_id", "attempt")
        token = F.sha2(F.concat_ws("|", F.lit(self.issue), F.col("subscriber_id").cast("string"), F.col("attempt").cast("string")), 256)
        return waiting.unionByName(fresh.select("subscriber_id", "attempt")).withColumn("token", token)

    def confirm(self, outcomes: DataFrame) -> None:
        """Record what became of reservations: subscriber_id, attempt, sent (boolean)."""
        rows = stored(outcomes.select(F.col("subscriber_id").cast("long").alias("subscriber_id"), F.col("attempt").cast("int").alias("attempt"), F.when(F.col("sent"), "sent").otherwise("failed").alias("phase")), "outcomes")
        while not rows.isEmpty() and not self._append(rows):
            pass
