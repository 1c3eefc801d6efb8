"""The read path: scoped, filtered, deduplicated and ranked views of stored bids.

Filters are plain conditions, so Catalyst pushes them through the star join into the scans. User text in `contains` is a
pattern: `%` and `_` in it match anything.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basisline.functions import keys, periods, prices, text

MAX_LIST, MAX_PREVIEW, MAX_PER_GROUP, MAX_MOVERS = 1000, 250, 20, 100


def star(facts: DataFrame, snapshots: DataFrame, sources: DataFrame, org: object | None = None) -> DataFrame:
    """Facts with their snapshot and source, within one organisation. Small dimensions are broadcast by their size."""
    scoped = sources if org is None else sources.where(F.col("org_id") == org)
    return facts.join(snapshots, "snapshot_id").join(scoped, "source_id")


def contains(column: Column, needle: str | None) -> Column:
    return F.lit(True) if not needle or not needle.strip() else F.coalesce(column.ilike(f"%{needle.strip()}%"), F.lit(False))


def source_is(column: Column, name: str) -> Column:
    """Rows of a source under its own spelling or its canonical name."""
    key = F.lower(F.trim(F.coalesce(column, F.lit(""))))
    return (key == text.canonical_key(F.lit(name))) | (key == text.canonical_key(text.canonical_source(F.lit(name))))


def in_region(column: Column, region: str) -> Column:
    """Rows of the sources that stand for a region; none for an unknown one."""
    key = text.canonical_key(text.canonical_source(column))
    return F.coalesce(F.array_contains(F.transform(text.region_sources(F.lit(region)), lambda x: F.lower(x)), key), F.lit(False))


def on_day(at: Column, day: str) -> Column:
    """Timestamps of one UTC day, as a half-open range that a scan can prune by."""
    start = F.lit(day).cast("date")
    return (at >= start) & (at < F.date_add(start, 1))


UUID = r"(?i)^\{?[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}\}?$"


def saved_search(df: DataFrame, filters: Mapping[str, str | None], months: Sequence[str] = ()) -> Column:
    """A saved search as a filter: texts by part (the region too looks into the source name), ids by equality, any month
    token within the delivery label or the futures month. Empty texts and tokens don't filter, nor do ids that are none."""
    text_of = {"commodity_name": "commodity_name", "location": "location", "source_name": "source_name", "region": "source_name"}
    out = F.lit(True)
    for name, column in text_of.items():
        out = out & contains(df[column], filters.get(name))
    for name in ("location_id", "company_id"):
        wanted = (filters.get(name) or "").strip()
        if re.match(UUID, wanted):
            bare = re.sub(r"[^0-9a-f]", "", wanted.lower())
            out = out & F.coalesce(F.regexp_replace(F.lower(df[name]), "-", "") == bare, F.lit(False))
    tokens = [m.strip().lower() for m in months if m and m.strip()]
    if tokens:
        out = out & functools.reduce(Column.__or__, [contains(df[c], t) for t in tokens for c in ("delivery_label", "futures_month")])
    return out


def filled(column: Column) -> Column:
    return F.length(F.trim(F.coalesce(column, F.lit("")))) > 0


def shown_commodity(column: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(column)).isin(*text.HIDDEN_COMMODITIES), F.lit(False))


def read_quality(df: DataFrame) -> Column:
    """Share of seven checks: commodity label, futures month and price, basis, both cash prices, any delivery period."""
    present = ["futures_month", "futures_price", "basis", "cash_price_bu", "cash_price_mt"]
    checks = [shown_commodity(df["commodity_name"]), *[df[c].isNotNull() for c in present], F.coalesce(df["delivery_end"], df["delivery_label"], df["delivery_start"]).isNotNull()]
    return sum((F.when(c, 1).otherwise(0) for c in checks), F.lit(0)) / F.lit(7.0)


def complete(df: DataFrame) -> Column:
    """Delivery and futures month filled, all four prices there."""
    there = [df[c].isNotNull() for c in ("futures_price", "basis", "cash_price_bu", "cash_price_mt")]
    out = (filled(df["delivery_end"]) | filled(df["delivery_label"])) & filled(df["futures_month"])
    for c in there:
        out = out & c
    return out


def visible(df: DataFrame, as_of: Column, include_non_canonical: bool = False, min_quality: float = 0.8) -> DataFrame:
    """What users see: valid labels, complete canonical rows of good quality whose periods have not passed."""
    delivery = F.trim(F.coalesce("delivery_label", "delivery_end", "delivery_start", F.lit("")))
    out = df.where(shown_commodity(df["commodity_name"]) & (read_quality(df) >= min_quality) & complete(df))
    out = out.where(periods.current(delivery, as_of) & periods.current(F.col("futures_month"), as_of))
    out = out.where(~periods.expired(keys.first_text(F.col("delivery_label"), F.col("delivery_end"), F.col("delivery_start")), F.col("futures_month"), as_of))
    return out if include_non_canonical else out.where(F.col("is_canonical").eqNullSafe(True))


def fresh(rows: DataFrame, runs: DataFrame, *, source: str, run_id: str, snapshot: str, at: str) -> DataFrame:
    """Rows of each source's latest completed run; rows without a run id count by the source's latest snapshot.

    `runs`: (source, run, status, started_at, completed_at). A source without a completed run shows no row that names one.
    """
    ended = F.coalesce("completed_at", "started_at")
    latest_run = runs.where("status = 'completed'").groupBy(F.col("source").alias("__s")).agg(F.max_by("run", F.struct(ended, "started_at", "run")).alias("__run"))
    latest_snap = rows.groupBy(F.col(source).alias("__s2")).agg(F.max(F.struct(at, snapshot)).alias("__snap"))
    out = rows.join(latest_run, F.col(source) == F.col("__s"), "left").join(latest_snap, F.col(source) == F.col("__s2"))
    keep = F.when(F.col(run_id).isNotNull(), F.col(run_id) == F.col("__run")).otherwise(F.col(snapshot) == F.col(f"__snap.{snapshot}"))
    return out.where(keep).select(rows.columns)


def source_rank(kind: Column) -> Column:
    return F.when(kind == "automated", 0).when(kind == "file", 1).otherwise(2)


def order_of(mode: str, *, at: str = "captured_at", kind: str = "source_type", tie: tuple[str, ...] = ("id",)) -> list[Column]:
    """Sort order of a listing. Descending columns put nulls first, ascending ones last, as users know them."""
    rest = [source_rank(F.col(kind)), F.col(at).desc_nulls_first()]
    named = {
        "basis_desc": [F.col("basis").desc_nulls_first(), *rest],
        "basis_asc": [F.col("basis").asc_nulls_last(), *rest],
        "cash_bu_desc": [F.col("cash_price_bu").desc_nulls_first(), *rest],
        "cash_bu_asc": [F.col("cash_price_bu").asc_nulls_last(), *rest],
        "basis_change_desc": [F.abs("basis_change").desc_nulls_first(), *rest],
    }
    return [*named.get(mode, [*rest, F.col("location").asc_nulls_last(), F.col("commodity_name").asc_nulls_last()]), *[F.col(c).asc_nulls_last() for c in tie]]


def crop_rank(commodity: Column) -> Column:
    """Place of a crop on a board: corn, soybeans, the wheats by class, other wheat, the rest."""
    name = F.lower(F.trim(F.coalesce(commodity, F.lit(""))))
    out = F.when(name == "corn", 1).when(name.isin("soybean", "soybeans"), 2)
    for place, word in enumerate(("srw", "hrw", "hrs", "wheat"), 3):
        out = out.when(name.contains(word), place)
    return out.otherwise(99)


def display_order(*, location: str = "location", commodity: str = "commodity_name", company: str = "company_name", delivery: str = "delivery_label", futures: str = "futures_month", tie: tuple[str, ...] = ("id",)) -> list[Column]:
    """Board order: place, crop, company, delivery and futures month; labels without a month come last."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    months = [periods.display_key(F.col(c)).asc_nulls_last() for c in (delivery, futures)]
    return [low(location), crop_rank(F.col(commodity)), low(commodity), low(company), *months, *[F.col(c).asc_nulls_last() for c in tie]]


def first_of_each(df: DataFrame, key: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order; ties must be broken by it."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def preview(df: DataFrame, key: list[Column | str], order: list[Column], limit: int, fetch: int | None = None) -> DataFrame:
    """First rows in order without repeats of a key: `fetch` rows (three times the limit) are looked at, `limit` kept.

    Both limits are top-k sorts; the window in between only sees the fetched rows. A page can come out short.
    """
    head = df.orderBy(*order).limit(fetch or limit * 3)
    return first_of_each(head, key, order).orderBy(*order).limit(limit)


def grouped_top(df: DataFrame, group: Column, order: list[Column], n: int, top: str = "cash_price_bu") -> DataFrame:
    """Groups (a label, else 'Unspecified') in period order, their sizes, top price and first n rows.

    Adds label, row_count, top_price and place; groups sort by month key, undated ones last. The ranking stands alone in
    its plan, so Spark cuts each partition to n rows a group before the shuffle; sizes come from an aggregate beside it.
    """
    out = df.withColumn("label", F.coalesce(F.nullif(group, F.lit("")), F.lit("Unspecified")))
    sizes = out.groupBy("label").agg(F.count(F.lit(1)).alias("row_count"))
    kept = out.withColumn("place", F.row_number().over(W.partitionBy("label").orderBy(*order))).where(F.col("place") <= n)
    first = F.first(top).over(W.partitionBy("label").orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return kept.withColumn("top_price", first).join(sizes, "label").withColumn("group_key", periods.month_key(F.col("label")))


def placed(df: DataFrame, group: list[str], leading: dict[str, Column], tie: list[Column]) -> DataFrame:
    """Add `place`, from 1 within each group in the order of the leading columns and then of `tie`, nulls last.

    Rows are counted by group and leading values first; places before each such value come from those counts, and only
    rows that agree in all of them are numbered together, so no task sorts a whole group.
    """
    named = df.withColumns({f"__l{i}": c for i, c in enumerate(leading.values())})
    cols = [f"__l{i}" for i in range(len(leading))]
    sizes = named.groupBy(*group, *cols).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_last() for c in cols])) - F.col("__n")
    keys = [*group, *cols]
    starts = sizes.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], before.alias("__before"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    numbered = named.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*tie)))
    return numbered.join(starts, same).withColumn("place", F.col("__before") + F.col("__r")).select(*df.columns, "place")


def movers(df: DataFrame, change: str, at: str, tie: str, limit: int) -> DataFrame:
    """Largest absolute changes, the latest first among equals."""
    return df.where(F.col(change).isNotNull()).orderBy(F.abs(change).desc(), F.col(at).desc(), tie).limit(limit)


def summary(df: DataFrame) -> DataFrame:
    """Average basis in dollars and number of bids."""
    return df.agg(F.avg(prices.basis_to_show(F.col("basis"))).alias("average_basis"), F.count(F.lit(1)).alias("bids"))


def candidate_counts(df: DataFrame, page: DataFrame, key: str = "composite_key") -> DataFrame:
    """How many stored rows compete for each key on a page."""
    return df.join(page.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("candidate_count"))


def facet(df: DataFrame, name: Column, key: str = "composite_key", at_least: int = 1, forced: list[str] = ()) -> DataFrame:
    """name and market_count (distinct keys): facets under `at_least` go, unless their name is forced and not empty."""
    found = df.withColumn("name", name).where(F.col("name").isNotNull()).groupBy("name").agg(F.countDistinct(key).alias("market_count"))
    keep = F.col("market_count") >= at_least
    if forced:
        keep = keep | (text.canonical_key(F.col("name")).isin(*[x.strip().lower() for x in forced]) & (F.col("market_count") > 0))
    return found.where(keep)


def merged_facets(ids: DataFrame, fallback: DataFrame) -> DataFrame:
    """Facets counted by id and by name together: the larger count of each name."""
    more = fallback.groupBy("name").agg(F.sum("market_count").alias("more"))
    both = ids.join(more, "name", "full_outer")
    return both.select("name", F.greatest(F.coalesce("market_count", F.lit(0)), F.coalesce("more", F.lit(0))).alias("market_count"))


def preview_columns(df: DataFrame) -> DataFrame:
    """Display projection of visible rows: names, periods, prices; missing changes are 0.0 and missing names '-'."""
    company = text.display_company(F.col("location"), F.col("company_name"), F.col("location_company_name"), F.col("source_name"))
    change = lambda c: F.coalesce(prices.finite(F.col(c).cast("double")), F.lit(0.0))
    return df.select(
        "id",
        F.coalesce(text.canonical_location(F.col("location")), F.lit("-")).alias("location"),
        F.coalesce(text.canonical_commodity(F.col("commodity_name")), F.lit("-")).alias("commodity_name"),
        F.coalesce(company, F.lit("-")).alias("company_name"),
        text.attribution(F.col("source_name")).alias("source_attribution"),
        periods.month_label(F.coalesce("delivery_label", "delivery_end", "delivery_start")).alias("delivery_label"),
        periods.month_label(F.col("futures_month")).alias("futures_month"),
        prices.finite(F.col("futures_price").cast("double")).alias("futures_price"),
        change("futures_change").alias("futures_change"),
        prices.basis_to_show(F.col("basis")).alias("basis"),
        F.coalesce(prices.basis_to_show(F.col("basis_change")), F.lit(0.0)).alias("basis_change"),
        prices.finite(F.col("cash_price_bu").cast("double")).alias("cash_price_bu"),
        change("cash_price_bu_change").alias("cash_price_bu_change"),
        prices.finite(F.col("cash_price_mt").cast("double")).alias("cash_price_mt"),
        change("cash_price_mt_change").alias("cash_price_mt_change"),
        "captured_at",
        "is_canonical",
        "canonical_rank",
        "canonical_reason",
    )


def iso_time(at: Column) -> Column:
    """ISO text of a time without zone; microseconds only where there are any."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(at, "SSSSSS") == "000000", whole).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def list_columns(df: DataFrame) -> DataFrame:
    """The row projection of a listing: ids and times as text, canonical labels, periods by month, missing changes 0.0."""
    company = text.display_company(F.col("location"), F.col("company_name"), F.col("location_company_name"), F.col("source_name"))
    number = lambda c: prices.finite(F.col(c).cast("double"))
    moved = lambda c: F.coalesce(number(c), F.lit(0.0)).alias(c)
    month = lambda c: periods.month_label(text.normalize_text(F.col(c))).alias(c)
    return df.select(
        *[F.col(c).cast("string").alias(c) for c in ("id", "snapshot_id", "company_id", "location_id")],
        iso_time(F.col("captured_at")).alias("captured_at"),
        F.coalesce(text.canonical_location(F.col("location")), F.lit("-")).alias("location"),
        company.alias("company_name"),
        F.coalesce(text.canonical_commodity(F.col("commodity_name")), F.lit("-")).alias("commodity_name"),
        text.canonical_source(F.col("source_name")).alias("source_name"),
        text.attribution(F.col("source_name")).alias("source_attribution"),
        text.normalize_text(F.col("delivery_start")).alias("delivery_start"),
        text.normalize_text(F.col("delivery_end")).alias("delivery_end"),
        month("delivery_label"),
        month("futures_month"),
        number("futures_price").alias("futures_price"),
        moved("futures_change"),
        prices.basis_to_show(F.col("basis")).alias("basis"),
        number("cash_price_bu").alias("cash_price_bu"),
        number("cash_price_mt").alias("cash_price_mt"),
        F.coalesce(prices.basis_to_show(F.col("basis_change")), F.lit(0.0)).alias("basis_change"),
        iso_time(F.col("basis_last_changed_at")).alias("basis_last_changed_at"),
        moved("cash_price_bu_change"),
        moved("cash_price_mt_change"),
        "composite_key",
        "is_canonical",
        "canonical_rank",
        "canonical_reason",
    )


def delivered(df: DataFrame, cash: str, trucking: float) -> DataFrame:
    """Quote lines: the cash price less trucking."""
    return df.withColumn("delivered_price", F.col(cash) - F.lit(trucking))
