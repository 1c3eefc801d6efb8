"""Canonical selection: of all rows that describe one market, one is shown, and the reason is kept.

Everything is one shuffle by market key: group-wide flags, the ranking and the reason are windows over that partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RankPolicy:
    """Least quality that passes, and how much better another source must be for an aggregator to step back."""

    min_quality: float = 0.8
    aggregator_gap: float = 0.15


UNRANKED = 100_000


def quality_of(*present: Column) -> Column:
    """Share of the checks that hold, as a double."""
    return sum((F.when(c, 1).otherwise(0) for c in present), F.lit(0)).cast("double") / len(present)


def ranked(df: DataFrame, key: list[str], *, quality: str, valid: str, aggregator: str, priority: str, captured_at: str, source: str, tie: str, policy: RankPolicy | None = None) -> DataFrame:
    """Add canonical_rank, is_canonical and canonical_reason.

    Order: configured priority; aggregators whose rows are clearly poorer than another source's last; passing quality;
    quality; recency; source name; id. The reason of rank 1 is the first rule that set it apart; the others carry it as
    `alternate:<reason>`.
    """
    p = policy or RankPolicy()
    group, q = W.partitionBy(*key), F.col(quality)
    flags = df.withColumns(
        {
            "__pass": F.coalesce(F.col(valid), F.lit(False)) & (q >= p.min_quality),
            "__best": F.max(F.when(~F.col(aggregator), q)).over(group),
        }
    )
    # The gap is a difference of small fractions: a tolerance keeps binary rounding out of the decision.
    behind = F.col(aggregator) & F.coalesce(F.col("__best") - q >= p.aggregator_gap - 1e-9, F.lit(False))
    flags = flags.withColumns({"__behind": behind, "__any": F.max("__pass").over(group)})
    bucket = F.when(F.col("__pass"), 0).when(F.col("__any"), 1).otherwise(0)
    name = F.lower(F.coalesce(F.col(source), F.lit("")))
    order = [F.coalesce(F.col(priority), F.lit(UNRANKED)), F.col("__behind"), bucket, q.desc(), F.col(captured_at).desc_nulls_last(), name, F.col(tie)]
    at = group.orderBy(*order)
    flags = flags.withColumns({"canonical_rank": F.row_number().over(at), "__q2": F.lead(quality).over(at), "__t2": F.lead(captured_at).over(at), "__n": F.count(F.lit(1)).over(group), "__kept": F.max("__behind").over(group)})
    shown = F.coalesce(F.col(source), F.lit("-"))
    reason = (
        F.when(F.col(priority).isNotNull(), F.concat(F.lit("priority:"), F.lower(shown)))
        .when(~F.col("__behind") & F.col("__kept"), "source_preference_non_aggregator")
        .when(F.col("__n") == 1, "single_candidate")
        .when(q > F.col("__q2"), "completeness")
        .when(F.col(captured_at).isNotNull() & (F.col("__t2").isNull() | (F.col(captured_at) > F.col("__t2"))), "recency")
        .otherwise(F.concat(F.lit("tie_breaker:"), shown))
    )
    first = F.max(F.when(F.col("canonical_rank") == 1, reason)).over(group)
    flags = flags.withColumn("__reason", first)
    winner = F.col("canonical_rank") == 1
    return flags.select(*df.columns, "canonical_rank", winner.alias("is_canonical"), F.when(winner, F.col("__reason")).otherwise(F.concat(F.lit("alternate:"), F.col("__reason"))).alias("canonical_reason"))


def candidates_of(history: DataFrame, touched: DataFrame, key: list[str]) -> DataFrame:
    """All rows of the markets that a capture touched: a semi join on the whole key."""
    return history.join(touched.select(*key).distinct(), key, "left_semi")


def duplicate_markets(df: DataFrame, key: list[str], owner: str, label: Column, canonical: Column, order: list[str], samples: int = 3) -> DataFrame:
    """By owner: markets with several rows, their rows, alternates and canonical rows, and the first sample labels."""
    first = F.min(F.struct(*order, label.alias("label"), F.col(owner).alias("owner")))
    markets = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(canonical.cast("long")).alias("canonical"), first.alias("first")).where("n > 1")
    markets = markets.select(F.col("first.owner").alias(owner), F.col("first.label").alias("label"), "n", "canonical", *[F.col(f"first.{c}").alias(f"__o{i}") for i, c in enumerate(order)])
    rank_cols = [f"__o{i}" for i in range(len(order))]
    # Few labels per owner go on: the first place of each distinct label, ranked, then cut to the samples.
    labels = markets.groupBy(owner, "label").agg(F.min(F.struct(*rank_cols)).alias("at")).withColumn("r", F.row_number().over(W.partitionBy(owner).orderBy("at"))).where(F.col("r") <= samples)
    labels = labels.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("r", "label"))).alias("l")).select(F.col(owner).alias("__owner"), F.transform("l", lambda x: x.label).alias("sample_markets"))
    sums = markets.groupBy(owner).agg(
        F.count(F.lit(1)).alias("duplicate_market_keys"), F.sum("n").alias("candidate_rows"), (F.sum("n") - F.count(F.lit(1))).alias("alternate_rows"), F.sum("canonical").alias("canonical_rows")
    )
    return sums.join(labels, F.col(owner).eqNullSafe(F.col("__owner")), "left").drop("__owner")


def winner_rates(df: DataFrame, source: str, canonical: Column) -> DataFrame:
    """Rows, canonical rows and winner rate by source."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("row_count"), F.sum(canonical.cast("long")).alias("canonical_count")).withColumn("winner_rate", F.col("canonical_count") / F.col("row_count"))


def candidate_order(by_rate: bool = False, policy: str = "policy_rank", rows: str = "row_count", rate: str = "winner_rate", source: str = "source") -> list[Column]:
    """Order in which sources are proposed: policy, (with `by_rate`) how often they win, rows, name."""
    return [F.col(policy), *([F.col(rate).desc_nulls_last()] if by_rate else []), F.col(rows).desc_nulls_last(), F.col(source)]


def seeded_priority(candidates: DataFrame, company: str, source: str, own_key: Column, aggregator: Column) -> DataFrame:
    """Ordered rank of each company's sources: its own name first, aggregators last, names in between."""
    policy = F.when(F.col(source) == own_key, 0).when(aggregator, 2).otherwise(1)
    order = W.partitionBy(company).orderBy("policy_rank", source)
    return candidates.groupBy(company, source).agg(F.min(policy).alias("policy_rank")).withColumn("priority_rank", F.row_number().over(order))


def replaced_priority(existing: DataFrame, wanted: DataFrame, company: str = "company", source: str = "source") -> DataFrame:
    """Stored priorities after the lists in `wanted` (company, sources: ordered array) replace those of their companies.

    Listed sources take the order of their first mention; the company's others keep their rank but become inactive;
    companies that are not listed stay as they are.
    """
    listed = wanted.select(company, F.posexplode(F.array_distinct("sources")).alias("at", source)).select(company, source, (F.col("at") + 1).alias("new_rank"))
    named = wanted.select(F.col(company).alias("__c")).distinct()
    both = existing.join(listed, [company, source], "full_outer").join(named, F.col(company) == F.col("__c"), "left")
    return both.select(
        company, source, F.coalesce("new_rank", "priority_rank").cast("int").alias("priority_rank"), F.when(F.col("__c").isNull(), F.col("is_active")).otherwise(F.col("new_rank").isNotNull()).alias("is_active")
    )
