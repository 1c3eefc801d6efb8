"""Posted bids and market statistics: trimmed means, modes, crop years, front months, rate limits, report sections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basisline.functions import periods, prices, text

# Harvest months and new-crop contract month by crop.
HARVEST_MONTHS = {"corn": (10, 11, 12), "soybeans": (9, 10, 11)}
NEW_CROP_MONTH = {"corn": 12, "soybeans": 11}
# End of fixed values.


@dataclass(frozen=True)
class BidPolicy:
    """How a posted bid follows its competitors, in dollars a tonne."""

    discount: float = 7.5
    discount_min: float = 5.0
    discount_max: float = 10.0
    trim: float = 0.2
    max_up: float = 3.0
    max_down: float = 5.0


def ranked_values(df: DataFrame, group: list[str], value: str, parts: int = 256) -> DataFrame:
    """Distinct values of each group with `n` (how often), `start` (rows with smaller values) and `total` (rows of the group).

    Equal values are counted before anything is sorted, and the distinct ones are dealt over `parts` ranges between the
    group's ends, so neither a hot group nor a hot value is ever sorted in one task. Groups with null keys count too.
    """
    v = F.col("__v")
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("n").alias("total"))
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    span = (F.col("__hi") - F.col("__lo")).cast("double")
    at = F.coalesce(finite_part((v - F.col("__lo")).cast("double") / F.nullif(span, F.lit(0.0)), parts), F.lit(0))
    rows = counts.join(ends, same).withColumn("__b", at).drop("__lo", "__hi")
    keys = [f"__g{i}" for i in range(len(group))]
    sizes = rows.groupBy(*keys, "__b").agg(F.sum("n").alias("__m"))
    before = sizes.withColumn("__before", F.sum("__m").over(W.partitionBy(*keys).orderBy("__b")) - F.col("__m")).drop("__m")
    renamed = before.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("__b").alias("__b_"), "__before")
    match = F.col("__b") == F.col("__b_")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}_"))
    within = F.sum("n").over(W.partitionBy(*keys, "__b").orderBy("__v")) - F.col("n")
    out = rows.withColumn("__w", within).join(renamed, match)
    return out.select(*group, v.alias(value), "n", (F.col("__before") + F.col("__w")).alias("start"), "total")


def finite_part(share: Column, parts: int) -> Column:
    """Range number of a share between 0 and 1; NaN sorts last."""
    return F.when(F.isnan(share), parts).otherwise(F.least(F.floor(share * parts), F.lit(parts - 1))).cast("int")


def trimmed_means(df: DataFrame, group: list[str], value: str, tie: list[str], trim: float) -> DataFrame:
    """Mean without the smallest and largest shares; groups under five count whole.

    Equal values are one entry with a count, so which of them are cut makes no difference and `tie` is not looked at.
    """
    n = F.col("total")
    cut = F.when((n < 5) | F.lit(trim <= 0), 0).otherwise(F.floor(n * trim))
    cut = F.when(2 * cut >= n, F.greatest(F.lit(0), F.floor((n - 1) / 2))).otherwise(cut)
    rows = ranked_values(df, group, value).withColumn("__cut", cut)
    kept = F.greatest(F.lit(0), F.least(F.col("start") + F.col("n"), n - F.col("__cut")) - F.greatest(F.col("start"), F.col("__cut")))
    rows = rows.withColumn("__k", kept).where("__k > 0")
    return rows.groupBy(*group).agg((F.sum(F.col(value) * F.col("__k")) / F.sum("__k")).alias("anchor"), F.max("total").alias("competitors"))


def medians(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """By group: the exact median (mean of the two middle values of an even number) and the number of values."""
    rows = ranked_values(df, group, value)
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    here = lambda r: (F.col("start") <= r) & (r < F.col("start") + F.col("n"))
    middle = rows.where(here(low) | here(high))
    both = F.max(F.when(here(low), F.col(value))) + F.max(F.when(here(high), F.col(value)))
    return middle.groupBy(*group).agg((both / 2).alias("median"), F.max("total").alias("values"))


def common_value(column: Column) -> Column:
    """Most frequent non-empty text, the smallest among equals."""
    return F.mode(F.nullif(F.trim(column), F.lit("")), deterministic=True)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(value, high))


def rate_limited(bid: Column, last: Column, policy: BidPolicy) -> Column:
    """The bid, moved from the last one by no more than the policy allows; free without a last bid."""
    return F.when(last.isNull(), bid).otherwise(clamp(bid, last - policy.max_down, last + policy.max_up))


def posted_bids(rows: DataFrame, group: list[str], price_mt: str, tie: list[str], last: DataFrame | None = None, policy: BidPolicy | None = None, commodity: str = "commodity") -> DataFrame:
    """By group: anchor (trimmed mean), posted tonne and bushel price. `last` has the group columns and last_bid."""
    p = policy or BidPolicy()
    out = trimmed_means(rows, group, price_mt, tie, p.trim)
    out = out.withColumn("posted_mt", F.col("anchor") - min(max(p.discount, p.discount_min), p.discount_max))
    if last is not None:
        out = out.join(last, group, "left").withColumn("posted_mt", rate_limited(F.col("posted_mt"), F.col("last_bid"), p)).drop("last_bid")
    factor = F.lit(None).cast("double")
    for name, f in prices.POSTED_BUSHELS_PER_TONNE.items():
        factor = F.when(F.lower(F.trim(F.col(commodity))) == name, f).otherwise(factor)
    return out.withColumn("posted_bu", F.col("posted_mt") / factor)


def posted_basis(posted_bu: Column, futures: Column) -> Column:
    """Posted bushel price less the futures price, rounded half to even; null for an unreadable quote."""
    return F.bround(posted_bu - prices.dollars_per_bushel(futures), 2)


def competitors(df: DataFrame, commodity: str, delivery: str | None = None, futures: str | None = None, exclude: list[str] = ()) -> DataFrame:
    """Rows of one crop and, if given, delivery and futures label; excluded places leave."""
    same = F.lower(F.trim("Name")) == commodity.strip().lower()
    if delivery is not None:
        same = same & (F.trim("Delivery") == delivery)
    if futures is not None:
        same = same & (F.trim("Futures Month") == futures)
    out = df.where(same)
    return out.where(~F.lower(F.trim("Location")).isin(*[x.strip().lower() for x in exclude])) if exclude else out


def crop_buckets(df: DataFrame, group: str, month_key: str, harvest: Column, delivery: str, futures: str) -> DataFrame:
    """By group and bucket: 'old' is the nearest month; 'new' the last later month, one of the harvest if there is any.

    Labels are the most frequent ones of the month. With a single month both buckets hold it.
    """
    rows = df.where(F.col(month_key).isNotNull())
    old = F.min(month_key).over(W.partitionBy(group))
    rows = rows.withColumn("__old", old).withColumn("__h", harvest)
    later = F.col(month_key) > F.col("__old")
    ends = rows.groupBy(group).agg(
        F.first("__old").alias("old"), F.coalesce(F.max(F.when(later & F.col("__h"), F.col(month_key))), F.max(F.when(later, F.col(month_key))), F.first("__old")).alias("new")
    )
    picked = ends.select(group, F.explode(F.array(F.struct(F.lit("old").alias("bucket"), F.col("old").alias("m")), F.struct(F.lit("new").alias("bucket"), F.col("new").alias("m")))).alias("b"))
    picked = picked.select(F.col(group).alias("__g"), "b.bucket", F.col("b.m").alias("bucket_month"))
    hit = (F.col(group) == F.col("__g")) & (F.col(month_key) == F.col("bucket_month"))
    return rows.join(picked, hit).groupBy(group, "bucket", "bucket_month").agg(common_value(F.col(delivery)).alias("delivery"), common_value(F.col(futures)).alias("futures_month"))


def front_months(df: DataFrame, group: str, month_key: str, price: str, now_key: int) -> DataFrame:
    """By group: first contract month from now on (else the first of all) and its upper median price."""
    front = df.groupBy(group).agg(F.coalesce(F.min(F.when(F.col(month_key) >= now_key, F.col(month_key))), F.min(month_key)).alias("front_month"))
    rows = df.join(front, group).where((F.col(month_key) == F.col("front_month")) & F.col(price).isNotNull())
    return rows.groupBy(group, "front_month").agg(upper_median(price))


def upper_median(value: str) -> Column:
    """The middle value in order, the upper one of an even number."""
    return F.expr(f"-percentile_disc(0.5) WITHIN GROUP (ORDER BY -{value})").alias(f"upper_median_{value}")


def new_crop_key(commodity: Column, year: int) -> Column:
    """Month key of a crop's harvest contract in a year, null for other crops."""
    out = F.lit(None).cast("int")
    for name, month in NEW_CROP_MONTH.items():
        out = F.when(F.lower(commodity).contains(name), year * 12 + month).otherwise(out)
    return out


def filled_contracts(df: DataFrame, targets: DataFrame, group: str, month: str, price: str) -> DataFrame:
    """Rows with a missing contract month or price filled from their crop's target (group, target_month, target_price)."""
    out = df.join(targets, group, "left")
    return out.withColumns({month: F.coalesce(month, "target_month"), price: F.coalesce(price, "target_price")}).drop("target_month", "target_price")


def report_sections(df: DataFrame, group: str, cash: str, basis: str, at: str) -> DataFrame:
    """By crop: markets, median and spread of cash prices (no spread of one), average basis, latest capture."""
    priced = df.where(F.col(cash).isNotNull())
    sums = priced.groupBy(group).agg(
        F.count(F.lit(1)).alias("market_count"),
        F.when(F.count(F.lit(1)) > 1, F.max(cash) - F.min(cash)).alias("cash_spread"),
        F.avg(basis).alias("average_basis"),
        F.max(at).alias("data_as_of"),
    )
    middle = medians(priced, [group], cash).select(F.col(group).alias("__g"), F.col("median").alias("median_cash"))
    return sums.join(middle, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def top_bids(df: DataFrame, group: str, order: list[Column], n: int = 3) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def report_text(sections: DataFrame, tops: DataFrame, crops: list[str], subject: str, url: str, as_of: str) -> DataFrame:
    """One row, `body`: the plain-text report. Crops stand in the given order; those without bids say so.

    `sections` has crop, market_count, median_cash and cash_spread; `tops` has crop, place, label, cash, basis, period:
    a few rows a crop, so the one row that joins them is small whatever the history.
    """
    line = F.concat(F.lit("* "), "label", F.lit(" - "), prices.show_cash(F.col("cash")), F.lit("; basis "), prices.show_basis(F.col("basis")), F.lit("; "), F.coalesce("period", F.lit("-")))
    listed = tops.groupBy("crop").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x.line).alias("lines"))
    wanted = sections.sparkSession.createDataFrame([(i, c) for i, c in enumerate(crops)], "at int, crop string")
    rows = wanted.join(sections, "crop", "left").join(listed, "crop", "left")
    foot = F.concat(F.lit("Markets: "), F.col("market_count").cast("string"), F.lit("; median cash "), prices.show_cash(F.col("median_cash")), F.lit("; range "), prices.show_cash(F.col("cash_spread")), F.lit(" before freight."))
    block = F.concat_ws("\n", F.col("crop"), F.when(F.col("lines").isNull(), "No current bids.").otherwise(F.concat_ws("\n", F.array_join("lines", "\n"), foot)))
    body = rows.agg(F.array_sort(F.collect_list(F.struct("at", block.alias("block")))).alias("b"))
    head, tail = f"{subject}\n\nData as of: {as_of}", f"Current bids: {url.rstrip('/')}\nPosted bids only; freight is not included."
    return body.select(F.concat_ws("\n\n", F.lit(head), F.array_join(F.transform("b", lambda x: x.block), "\n\n"), F.lit(tail)).alias("body"))


def report_html(body: Column) -> Column:
    """The text report as a page: escaped, first line as heading, blank lines between paragraphs."""
    parts = F.split(text.escape_html(body), "\n\n")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    return F.concat(F.lit("<!doctype html><html><body><h1>"), F.get(parts, F.lit(0)), F.lit("</h1>"), F.array_join(rest, ""), F.lit("</body></html>"))


def next_contract(delivery: Column) -> Column:
    return periods.next_month(delivery)
