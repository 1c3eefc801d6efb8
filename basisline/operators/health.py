"""Source health: confidence, staleness, failures since the last success, service levels, expected run windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basisline.operators.diagnostics import blank, file_quality, latest_runs

SLOW_MS = 60_000


def confidence(failures: Column, latency_ms: Column) -> Column:
    """1, less 0.15 a failure (0.6 at most), less 0.1 if the last run was slow; never below 0."""
    lost = F.least(F.lit(0.6), F.coalesce(failures, F.lit(0)) * 0.15)
    slow = F.when(F.coalesce(latency_ms, F.lit(0)) > SLOW_MS, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.bround(1 - lost - slow, 3))


def minutes_since(then: Column, now: Column) -> Column:
    """Whole minutes, at least 0; null for never."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0), F.floor(seconds / 60))).cast("long")


def stale(last_success: Column, poll_minutes: Column, now: Column) -> Column:
    """No success within twice the polling interval, or never one."""
    age = minutes_since(last_success, now)
    return age.isNull() | (age > 2 * poll_minutes)


def promotion(kind: Column, pilot: Column, active: Column, successes: Column, needed: int = 3) -> Column:
    """Stage of an adapter on its way into service."""
    return (
        F.when(kind != "automated", "n/a").when(~pilot, "not_pilot").when(active & (successes >= needed), "promoted").when(active, "pilot").otherwise("pilot_pending")
    )


def failures_now(runs: DataFrame, source: str, at: str, tie: str, ok: Column) -> DataFrame:
    """By source: runs failed since its last success, that success, and the last run's time.

    Two aggregations that combine before they shuffle: the last success of each source, then the failures after it.
    """
    marked = runs.select(F.col(source).alias("__s"), F.struct(at, tie).alias("at"), ok.alias("ok"))
    ends = marked.groupBy("__s").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("success"), F.max(f"at.{at}").alias("last_run_at"))
    failed = marked.where(~F.col("ok")).select("__s", "at").join(ends.select("__s", "success"), "__s")
    failed = failed.where(F.col("success").isNull() | (F.col("at") > F.col("success"))).groupBy("__s").agg(F.count(F.lit(1)).alias("n"))
    out = ends.join(failed, "__s", "left")
    return out.select(F.col("__s").alias(source), F.coalesce("n", F.lit(0)).alias("consecutive_failures"), F.col(f"success.{at}").alias("last_success_at"), "last_run_at")


def service_levels(sources: DataFrame, now: Column) -> DataFrame:
    """One row: sources in all, fresh, stale and failing."""
    is_stale = stale(F.col("last_success_at"), F.col("polling_interval_minutes"), now)
    failing = F.coalesce(F.col("consecutive_failures") > 0, F.lit(False))
    return sources.agg(F.count(F.lit(1)).alias("sources"), F.count_if(~is_stale).alias("fresh"), F.count_if(is_stale).alias("stale"), F.count_if(failing).alias("failing"))


def with_health(sources: DataFrame, runs: DataFrame, now: Column, pilots: list[str], scanned: int | None = 2000) -> DataFrame:
    """Sources with their age, staleness, latest run (among the last `scanned`; None: of all), completed runs and promotion stage.

    Runs carry source_name, id, started_at, status, parse_success_rate and rejected_row_count; they meet sources by name.
    """
    latest = latest_runs(runs, "source_name", "started_at", "id", scanned)
    latest = latest.select(F.col("source_name").alias("name"), F.col("status").alias("latest_run_status"), F.col("parse_success_rate").alias("latest_parse_success_rate"), F.col("rejected_row_count").alias("latest_rejected_row_count"))
    done = runs.where("status = 'completed'").groupBy(F.col("source_name").alias("name")).agg(F.count(F.lit(1)).alias("done"))
    poll = F.coalesce("polling_interval_minutes", F.lit(15))
    successes = F.coalesce("done", F.lit(0))
    out = sources.join(latest, "name", "left").join(done, "name", "left")
    return out.withColumns(
        {
            "stale_age_minutes": minutes_since(F.col("last_success_at"), now),
            "is_stale": stale(F.col("last_success_at"), poll, now),
            "successful_run_count": successes,
            "promotion_status": promotion(F.col("source_type"), F.coalesce(F.col("adapter_key").isin(*pilots), F.lit(False)), F.col("is_active"), successes),
            "can_refresh": F.col("source_type") == "automated",
        }
    ).drop("done")


def logical_sources(sources: DataFrame, snapshots: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """The sources inside each file source's latest snapshot, listed as sources of their own below it.

    `rows` has snapshot_id, source_name, key and reasons; unnamed rows are left to their file.
    """
    latest = snapshots.groupBy("source_id").agg(F.max_by("id", F.struct("captured_at", "id")).alias("snapshot_id"), F.max("captured_at").alias("last_success_at"))
    files = sources.where("source_type = 'file'").drop("last_success_at").join(latest, F.col("id") == F.col("source_id")).drop("source_id")
    named = rows.where(~blank(F.col("source_name"))).join(latest.select("snapshot_id"), "snapshot_id", "left_semi")
    groups = file_quality(named.withColumn("__group", F.struct("snapshot_id", "source_name")), "__group", "key", "reasons")
    groups = groups.select("__group.snapshot_id", F.col("__group.source_name").alias("logical"), F.col("raw_rows").alias("logical_row_count"), F.col("success_rate").alias("latest_parse_success_rate"), F.col("rejected_rows").alias("latest_rejected_row_count"))
    out = files.withColumnRenamed("name", "logical_parent_source_name").join(groups, "snapshot_id").drop("snapshot_id")
    return out.withColumns(
        {
            "id": F.concat_ws(":", F.col("id").cast("string"), "logical"),
            "name": F.col("logical"),
            "source_type": F.lit("file_logical"),
            "latest_run_status": F.lit("completed"),
            "stale_age_minutes": minutes_since(F.col("last_success_at"), now),
            "is_stale": stale(F.col("last_success_at"), F.coalesce("polling_interval_minutes", F.lit(15)), now),
            "successful_run_count": F.lit(1).cast("long"),
            "promotion_status": F.lit("n/a"),
            "can_refresh": F.lit(False),
        }
    ).drop("logical")


def due(sources: DataFrame, now: Column, pilots: list[str]) -> DataFrame:
    """Active automated pilot sources whose next poll has come."""
    ready = F.col("next_poll_at").isNull() | (F.col("next_poll_at") <= now)
    return sources.where(F.col("is_active") & (F.col("source_type") == "automated") & F.col("adapter_key").isin(*pilots) & ready)


def next_poll(now: Column, interval_minutes: Column) -> Column:
    return now + F.make_dt_interval(mins=interval_minutes)


def missed_windows(runs: DataFrame, expected: DataFrame, grace_minutes: int, zone: str | None = None) -> DataFrame:
    """Expected starts (source, expected_at) with the runs that began within the grace time, and whether none did.

    A range join on top of an equi-join by source and hour bucket, so no source's runs meet all of its windows.
    """
    started = F.from_utc_timestamp("started_at", zone) if zone else F.col("started_at")
    hours = grace_minutes // 60 + 1
    bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / 3600)
    wanted = expected.withColumn("__b", F.explode(F.sequence(bucket(F.col("expected_at")), bucket(F.col("expected_at")) + hours)))
    ran = runs.where("status = 'completed'").select(F.col("source").alias("__s"), started.alias("__at")).withColumn("__b2", bucket(F.col("__at")))
    end = F.col("expected_at") + F.make_dt_interval(mins=F.lit(grace_minutes))
    hit = (F.col("source") == F.col("__s")) & (F.col("__b") == F.col("__b2")) & (F.col("__at") >= F.col("expected_at")) & (F.col("__at") <= end)
    out = wanted.join(ran, hit, "left").groupBy("source", "expected_at").agg(F.count("__at").alias("runs_in_window"))
    return out.withColumn("missed", F.col("runs_in_window") == 0)


def forecast_health(forecasts: DataFrame, now: Column, stale_minutes: int = 180) -> DataFrame:
    """One row: forecasts, the latest one, its age, and whether the feed is stale."""
    age = minutes_since(F.max("created_at"), now)
    return forecasts.agg(F.count(F.lit(1)).alias("forecasts"), F.max("created_at").alias("latest_at"), age.alias("age_minutes"), (age.isNull() | (age >= stale_minutes)).alias("stale"))
