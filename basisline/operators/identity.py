"""Companies and places: dimension upkeep, inference of who buys where, and reports on unclear identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basisline.functions import text


def missing_members(facts: DataFrame, dimension: DataFrame, name: str, key: str = "canonical_key", label: Column | None = None) -> DataFrame:
    """(key, name) of members that facts name and the dimension lacks; the smallest spelling stands for each."""
    shown = label if label is not None else text.normalize_text(F.col(name))
    seen = facts.select(shown.alias("name")).where(F.col("name").isNotNull()).withColumn(key, F.lower("name"))
    return seen.groupBy(key).agg(F.min("name").alias("name")).join(dimension.select(key), key, "left_anti")


def with_members(facts: DataFrame, dimension: DataFrame, name: str, key: str = "canonical_key", member: str = "id") -> DataFrame:
    """Facts with the id of the dimension member of their label, null for blank labels."""
    found = dimension.select(F.col(key).alias("__key"), F.col(member).alias(f"{name}_id"))
    return facts.join(found, text.canonical_key(F.col(name)) == F.col("__key"), "left").drop("__key")


def location_backfill(locations: DataFrame, seen: DataFrame) -> DataFrame:
    """Locations (canonical_key, company, region) after an ingest: a company on file that is trusted stays; else the one of
    the first row (by `position`) that names a company takes its place; a missing region is filled the same way.

    `seen` has canonical_key, position, company (null for sources that name none) and region.
    """
    first = first_known(seen, "canonical_key", ["position"], "company", "region")
    first = first.select(F.col("canonical_key").alias("__k"), F.col("company").alias("__company"), text.normalize_text(F.col("region")).alias("__region"))
    both = locations.join(first, F.col("canonical_key") == F.col("__k"), "left")
    company = F.coalesce(F.when(text.creates_company(F.col("company")), F.col("company")), F.col("__company"))
    return both.select("canonical_key", company.alias("company"), F.coalesce("region", "__region").alias("region"))


def desired_company(source: Column, current: Column, of_location: Column) -> Column:
    """Company a stored row should have: that of its source if the source is a company, else its place's.

    A current company of the same name stays as it is spelled. `of_location` is the trusted company of the place.
    """
    own = text.canonical_key(text.canonical_source(source))
    same = text.canonical_key(text.canonical_source(current)) == own
    return F.when(text.creates_company(source), F.when(text.creates_company(current) & same, current).otherwise(text.canonical_source(source))).otherwise(of_location)


def company_backfill(rows: DataFrame, locations: DataFrame, location: str = "location", company: str = "company", source: str = "source") -> DataFrame:
    """All rows with `desired` (their company after a backfill) and `changed`. Locations have location and company.

    Places first: a trusted company on file stays; else the only company that rows of company sources name there; else none.
    """
    named = rows.where(text.creates_company(F.col(source))).select(location, text.trusted_company(F.col(company)).alias("__c"))
    known = locations.select(location, F.col("company").alias("__now"))
    found = inferred_owner(named.join(known, location, "right"), location, "__c", "__now").select(location, F.col("company").alias("__owner"))
    out = rows.join(found, location, "left").withColumn("desired", desired_company(F.col(source), F.col(company), F.col("__owner"))).drop("__owner")
    return out.withColumn("changed", ~F.col("desired").eqNullSafe(F.col(company)))


def impacted_markets(backfilled: DataFrame, key: list[str], company: str = "company") -> DataFrame:
    """Market keys that a backfill touches, before and after it: `key` holds the company column and others."""
    changed = backfilled.where("changed")
    after = changed.select(*[F.col("desired").alias(company) if c == company else F.col(c) for c in key])
    return changed.select(*key).unionByName(after).distinct()


def linked(facts: DataFrame, dimension: DataFrame, on: str, column: str) -> DataFrame:
    """Fill missing foreign keys from a dimension (on, column); keys that are set stay."""
    found = dimension.select(F.col(on), F.col(column).alias("__new"))
    return facts.join(found, on, "left").withColumn(column, F.coalesce(column, "__new")).drop("__new").select(facts.columns)


def chosen_company(explicit: Column, source: Column, of_location: Column) -> Column:
    """Company of a row: the explicit one; none if its source is a company itself; else its place's."""
    return F.when(explicit.isNotNull(), explicit).when(~text.creates_company(source), of_location)


def inferred_owner(rows: DataFrame, location: str, company: str, current: str) -> DataFrame:
    """By location: its company (a trusted current one stays; else the only trusted candidate) and whether it is unclear.

    `current` is the name now on file, `company` the name of each row.
    """
    trusted = text.trusted_company(F.col(company))
    by = rows.groupBy(location).agg(F.max(text.trusted_company(F.col(current))).alias("__now"), F.count_distinct(trusted).alias("candidates"), F.min(trusted).alias("__only"))
    return by.select(location, F.coalesce("__now", F.when(F.col("candidates") == 1, F.col("__only"))).alias("company"), (F.col("candidates") > 1).alias("ambiguous"))


def consolidated(facts: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Facts with foreign keys rewritten from alias to target (alias, target)."""
    return facts.join(aliases.select(F.col("alias").alias(column), "target"), column, "left").withColumn(column, F.coalesce("target", column)).select(facts.columns)


def merged_priorities(priorities: DataFrame, aliases: DataFrame, company: str = "company", source: str = "source") -> DataFrame:
    """Priorities after aliases are merged: the best rank, active if any was."""
    named = consolidated(priorities, aliases, company)
    return named.groupBy(company, source).agg(F.min("priority_rank").alias("priority_rank"), F.max("is_active").alias("is_active"))


def first_known(rows: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """By key, the first non-null value of each column in the order."""
    return rows.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def shared_places(rows: DataFrame, location: str, company: str, source: str, at_least: int = 2, top: int = 5) -> DataFrame:
    """Places that several companies are named for: companies, rows and the most frequent sources.

    Counts are made per (place, company) and (place, source) first, so a place with many rows is never gathered.
    """
    by_company = rows.groupBy(location, company).agg(F.count(F.lit(1)).alias("n"))
    found = by_company.groupBy(location).agg(F.count(F.lit(1)).alias("company_count"), F.sum("n").alias("row_count")).where(F.col("company_count") >= at_least)
    by_source = rows.join(found.select(location), location, "left_semi").groupBy(location, source).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(location).orderBy(F.col("n").desc(), source)
    best = by_source.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    best = best.groupBy(location).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(source).alias("s")))), lambda x: x.s).alias("top_sources"))
    return found.join(best, location)


def spelling_variants(rows: DataFrame, raw: str, canonical: Column) -> DataFrame:
    """Canonical labels that stand for several spellings, with the spellings."""
    seen = rows.select(canonical.alias("canonical"), F.col(raw).alias("raw")).where("canonical is not null").distinct()
    return seen.groupBy("canonical").agg(F.array_sort(F.collect_set("raw")).alias("variants")).where(F.size("variants") > 1)


def overlaps(left: DataFrame, right: DataFrame, key: str, owner: str) -> DataFrame:
    """By owner on the right: how many of the keys on the left it shares, of how many of its own."""
    mine = left.select(key).distinct().withColumn("__in", F.lit(1))
    own = right.select(owner, key).distinct().join(mine, key, "left")
    return own.groupBy(owner).agg(F.count("__in").alias("shared"), F.count(F.lit(1)).alias("total"))


def coverage(seen: DataFrame, mapped: DataFrame, key: str) -> DataFrame:
    """One row: keys seen, mapped, both, and seen without a mapping. One shuffle for all four."""
    both = seen.select(key).distinct().withColumn("s", F.lit(1)).join(mapped.select(key).distinct().withColumn("m", F.lit(1)), key, "full_outer")
    return both.agg(
        F.count("s").alias("seen"), F.count("m").alias("mapped"), F.count_if(F.col("s").isNotNull() & F.col("m").isNotNull()).alias("both"), F.count_if(F.col("m").isNull()).alias("unmapped")
    )


def seed_rows(mapping: DataFrame) -> DataFrame:
    """Rows of a place-to-company table that are sure: status 'yes', or 'yes?' as tentative; 'multiple' is left out."""
    status = F.lower(F.trim("status"))
    return mapping.where(status.isin("yes", "yes?")).select(
        text.canonical_location(F.col("location")).alias("location"), text.canonical_source(F.col("company")).alias("company"), (status == "yes?").alias("tentative")
    )
