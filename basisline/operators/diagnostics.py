"""Data quality: why rows were rejected, how good each source's file was, how changes were carried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basisline.functions.text import canonical_location


def missing(checks: dict[str, Column]) -> Column:
    """Array of 'missing_<name>' for every check that holds, in order; empty: the row is complete."""
    return F.array_compact(F.array(*[F.when(c, F.lit(f"missing_{name}")) for name, c in checks.items()]))


def blank(column: Column) -> Column:
    return F.trim(F.coalesce(column, F.lit(""))) == ""


def reject_reasons() -> Column:
    """Reasons that keep a normalized row out. A missing futures change is no reason."""
    return missing(
        {
            "source_name": blank(F.col("source_name")),
            "delivery_window": blank(F.col("delivery_end")) & blank(F.col("delivery_label")),
            "futures_month": blank(F.col("futures_month")),
            "basis": F.col("basis").isNull(),
            "cash_price_bu": F.col("cash_price_bu").isNull(),
            "cash_price_mt": F.col("cash_price_mt").isNull(),
        }
    )


def reason_counts(rows: DataFrame, reasons: str, source: str) -> DataFrame:
    """Counts by reason (source null) and by source and reason: one pass with grouping sets."""
    each = rows.select(F.col(source).alias("source"), F.explode(reasons).alias("reason"))
    return each.groupingSets([[F.col("reason")], [F.col("source"), F.col("reason")]], "source", "reason").agg(F.grouping("source").cast("int").alias("overall"), F.count(F.lit(1)).alias("n"))


def reasons_as_maps(counts: DataFrame) -> DataFrame:
    """One row: reasons map<reason, n> and by_source map<source, map<reason, n>>. Sizes are bounded by sources x reasons."""
    per = counts.where("overall = 0").groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("m"))
    total = counts.where("overall = 1").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    nested = per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("unknown_source")).alias("source"), F.map_entries("m").alias("m"))))).alias("by_source"))
    return total.join(nested.select(F.transform_values("by_source", lambda _, v: F.map_from_entries(v)).alias("by_source")), F.lit(True))


def file_quality(rows: DataFrame, source: str, key: str, reasons: str) -> DataFrame:
    """By source: rows, rejected rows, repeated keys among the rest, success rate (repeats don't lower it)."""
    ok = F.size(reasons) == 0
    raw, good, keyed = F.count(F.lit(1)), F.count_if(ok), F.when(ok, F.col(key))
    return rows.groupBy(source).agg(
        raw.alias("raw_rows"),
        (raw - good).alias("rejected_rows"),
        (F.count(keyed) - F.count_distinct(keyed)).alias("duplicate_keys"),
        F.when(raw > 0, good / raw).otherwise(0.0).alias("success_rate"),
    )


def quality_summary(raw: Column, normalized: Column, rejected: Column, rate: Column) -> Column:
    """struct(parse_success_rate, rejection_rate): stored rate, else normalized over raw; 0 without rows."""
    share = lambda a: F.when(raw > 0, a / raw).otherwise(0.0)
    return F.struct(F.coalesce(rate, share(normalized)).alias("parse_success_rate"), share(rejected).alias("rejection_rate"))


def split_breakdown(stored: Column) -> Column:
    """struct(reasons, nested): plain counts apart from the nested sections, whose names begin with an underscore."""
    return F.struct(F.map_filter(stored, lambda k, _: ~k.startswith("_")).alias("reasons"), F.map_filter(stored, lambda k, _: k.startswith("_")).alias("nested"))


def latest_group(df: DataFrame, group: str, at: str, least: int) -> DataFrame:
    """The latest group of at least `least` rows; else the latest that has any."""
    sizes = df.groupBy(group).agg(F.max(at).alias("at"), F.count(F.lit(1)).alias("n"))
    return sizes.orderBy((F.col("n") >= least).desc(), F.col("at").desc(), F.col(group).desc()).limit(1)


def change_flags(df: DataFrame, at: Column) -> DataFrame:
    """Add how the strict and the carried change of each row disagree, and how old the carried one is."""
    strict, carried = (F.coalesce(F.col(c) != 0, F.lit(False)) for c in ("basis_change_strict", "basis_change"))
    age = F.unix_timestamp(at) - F.unix_timestamp("basis_last_changed_at")
    return df.withColumns(
        {
            "strict_non_zero": strict,
            "carried_non_zero": carried,
            "carried_only": carried & ~strict,
            "strict_only": strict & ~carried,
            "value_mismatch": strict & carried & (F.col("basis_change") != F.col("basis_change_strict")),
            "age_hours": F.greatest(F.lit(0.0), age / 3600),
            "stale": F.coalesce(carried & (age > 24 * 3600), F.lit(False)),
        }
    )


def change_summary(flagged: DataFrame) -> DataFrame:
    counts = {
        "strict_non_zero_count": "strict_non_zero",
        "carried_non_zero_count": "carried_non_zero",
        "carried_without_strict_count": "carried_only",
        "strict_without_carried_count": "strict_only",
        "strict_vs_carried_value_mismatch_count": "value_mismatch",
        "stale_non_zero_carried_count": "stale",
    }
    return flagged.agg(F.count(F.lit(1)).alias("row_count"), *[F.count_if(F.col(c)).alias(n) for n, c in counts.items()], F.count("basis_last_changed_at").alias("rows_with_basis_last_changed_at"))


def change_samples(flagged: DataFrame, limit: int, tie: str = "id") -> DataFrame:
    """Rows that disagree or are stale: stale first, then the largest differences, then by place and crop."""
    diff = F.abs(F.coalesce(F.col("basis_change") - F.col("basis_change_strict"), F.lit(0)))
    rows = flagged.where(F.col("carried_only") | F.col("strict_only") | F.col("value_mismatch") | F.col("stale"))
    return rows.orderBy(F.col("stale").desc(), diff.desc(), F.lower(F.coalesce(canonical_location(F.col("location")), F.lit("-"))), F.lower(F.coalesce("commodity_name", F.lit("-"))), tie).limit(limit)


def cycle_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))


def latest_runs(runs: DataFrame, source: str, at: str, tie: str, scanned: int | None = 2000) -> DataFrame:
    """Latest run of each source among the last `scanned` runs (the window that the listing shows); None: among all."""
    head = runs if scanned is None else runs.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(scanned)
    last = head.groupBy(F.col(source).alias("__s")).agg(F.max_by(F.struct(*runs.columns), F.struct(at, tie)).alias("__r"))
    return last.select("__r.*")


def snapshot_counts(rows: DataFrame, history: DataFrame, key: list[str], canonical: Column, company: Column) -> DataFrame:
    """One row about a snapshot: its rows, canonical and other ones, market keys, how many of these have several rows in
    the whole history (which holds the snapshot too), and companies."""
    own = rows.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(canonical).alias("canonical_row_count"), F.count_if(~canonical).alias("non_canonical_row_count"), F.count_distinct(company).alias("company_count"))
    touched = rows.select(*key).distinct()
    markets = history.select(*key).join(touched, key, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    markets = markets.agg(F.count(F.lit(1)).alias("impacted_market_key_count"), F.count_if(F.col("n") > 1).alias("duplicate_market_key_count"))
    return own.join(markets, F.lit(True))  # two single rows


def active_counts(rows: DataFrame, at: str, place: str) -> DataFrame:
    """Rows of each place at the latest capture."""
    latest = rows.agg(F.max(at).alias(at))
    return rows.join(F.broadcast(latest), at, "left_semi").groupBy(place).agg(F.count(F.lit(1)).alias("row_count"))
