"""From a price sheet to price observations: one projection, one keep-last by key, two window passes over history.

Rejected rows keep their reasons, so their counts and the accepted rows come from the same frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basisline.functions import keys, periods, prices, text
from basisline.operators import diagnostics, history, identity, latest, reshape
from basisline.operators.sizes import by_labels
from basisline.sources import transactions
from basisline.sources.bucketed import read_bucketed, write_bucketed
from basisline.storage import stored


@dataclass(frozen=True)
class SheetOptions:
    """Defaults for cells a sheet lacks, header overrides, and whether symbols are read letter by letter."""

    source_name: str = ""
    commodity: str = ""
    mapping: dict[str, str] | None = None
    scan_letters: bool = False


def _clean(column: Column) -> Column:
    return F.coalesce(text.normalize_text(column), F.lit(""))


def normalized(sheet: DataFrame, position: str, options: SheetOptions | None = None) -> DataFrame:
    """Every row of a sheet in the standard columns, with `reasons`: empty for rows that are accepted.

    Order matters: the tonne price is inferred first, a missing futures month comes from the delivery, a month label is
    derived only where neither delivery field has one, and the futures price at last from its text or from cash less
    basis. Labels are read once each: a sheet's distinct labels are stored as soon as the function is called.
    """
    o = options or SheetOptions()
    mapping = keys.map_headers([c for c in sheet.columns if c != position], o.mapping)
    cells = sheet.select(position, *[F.coalesce(F.col("`" + h.replace("`", "``") + "`").cast("string"), F.lit("")).alias(f"cell_{c}") for c, h in mapping.items()])
    cells = cells.select("*", *[F.lit("").alias(f"cell_{c}") for c in keys.COLUMN_ALIASES if c not in mapping])
    raw = lambda c: F.col(f"cell_{c}")
    month = lambda x: _clean(F.coalesce(periods.futures_month(F.trim(x), o.scan_letters), F.trim(x)))
    read = by_labels(
        reshape.settled(cells),
        {
            "cell_location": {"location": lambda x: F.coalesce(text.canonical_location(x), F.lit(""))},
            "cell_commodity": {"commodity_name": lambda x: F.coalesce(text.canonical_commodity(x), F.lit(o.commodity))},
            "cell_source_name": {"source_name": lambda x: F.coalesce(text.canonical_source(x), F.lit(o.source_name))},
            "cell_delivery_start": {"delivery_start": _clean},
            "cell_delivery_end": {"delivery_end": _clean, "end_is_month": lambda x: periods.looks_like_month(_clean(x)), "before_end": lambda x: periods.delivery_of_futures(_clean(x))},
            "cell_delivery_label": {"delivery_label": _clean, "label_is_month": lambda x: periods.looks_like_month(_clean(x)), "before_label": lambda x: periods.delivery_of_futures(_clean(x))},
            "cell_futures_month": {"futures_text": lambda x: F.trim(x), "month": month, "before_month": lambda x: periods.delivery_of_futures(month(x)), "text_price": lambda x: prices.price_in_text(F.trim(x))},
        },
    )
    df = reshape.settled(read).select(
        F.col(position).alias("position"), "location", "commodity_name", "source_name", "delivery_start", "delivery_end", "delivery_label", "futures_text", "text_price", "month", "before_month", "before_label", "before_end", "label_is_month", "end_is_month",
        prices.tick_price(raw("futures_price")).alias("futures_price"),
        prices.tick_price(raw("futures_change")).alias("futures_change"),
        prices.basis_to_store(prices.tick_price(raw("basis"))).alias("basis"),
        prices.tick_price(raw("cash_price_bu")).alias("cash_price_bu"),
        prices.tick_price(raw("cash_price_mt")).alias("cash_price_mt"),
    )
    df = reshape.settled(df)
    df = df.withColumn("cash_price_mt", F.coalesce("cash_price_mt", prices.per_tonne(F.col("commodity_name"), F.col("cash_price_bu"))))
    named, labelled = F.col("month") != "", F.col("delivery_label") != ""
    derived = F.when(named, F.col("before_month")).when(labelled, F.col("before_label")).otherwise(F.col("before_end"))
    derive = derived.isNotNull() & ~F.col("label_is_month") & ~F.col("end_is_month")
    df = df.withColumn("futures_month", F.when(named, F.col("month")).when(labelled, F.col("delivery_label")).otherwise(F.col("delivery_end")))
    df = df.withColumns({c: F.when(derive, derived).otherwise(F.col(c)) for c in ("delivery_end", "delivery_label")})
    df = reshape.settled(df)
    df = df.withColumn("futures_price", F.coalesce("futures_price", "text_price", (F.col("cash_price_bu") - F.col("basis")).cast(prices.PRICE)))
    df = df.drop("text_price", "month", "before_month", "before_label", "before_end", "label_is_month", "end_is_month")
    early = F.when(diagnostics.blank(F.col("location")), "missing_location").when(diagnostics.blank(F.col("commodity_name")), "missing_commodity_name")
    early = early.when(text.invalid_commodity(F.col("commodity_name"), F.col("source_name")), "invalid_commodity_name")
    df = df.withColumn("reasons", F.when(early.isNotNull(), F.array(early)).otherwise(diagnostics.reject_reasons()))
    key = keys.composite_key(*[F.col(c) for c in ("location", "commodity_name", "delivery_start", "delivery_end", "futures_month")])
    return reshape.settled(df.withColumn("composite_key", key))


def accepted(rows: DataFrame) -> DataFrame:
    """Rows without a reason, the last one of each key, with how many rows it replaced."""
    return reshape.keep_last(rows.where(F.size("reasons") == 0), ["composite_key"], "position").drop("reasons", "futures_text")


def run_counters(rows: DataFrame) -> DataFrame:
    """One row: raw, accepted and rejected rows, repeated keys, missing fields, parse success rate."""
    ok = F.size("reasons") == 0
    keyed = F.when(ok, F.col("composite_key"))
    raw, good = F.count(F.lit(1)), F.count_if(ok)
    return rows.agg(
        raw.alias("raw_row_count"),
        F.count_distinct(keyed).alias("normalized_row_count"),
        (raw - good).alias("rejected_row_count"),
        (F.count(keyed) - F.count_distinct(keyed)).alias("duplicate_key_count"),
        F.coalesce(F.sum(F.size("reasons")), F.lit(0)).alias("missing_required_count"),
        F.when(raw > 0, good / raw).otherwise(0.0).alias("parse_success_rate"),
    )


def observed(rows: DataFrame, snapshot: object, captured_at: Column) -> DataFrame:
    """Price observations of a sheet's accepted rows, marked with their snapshot and capture time."""
    return accepted(rows).withColumns({"snapshot_id": F.lit(snapshot), "captured_at": captured_at})


def located(observations: DataFrame, places: DataFrame, source: str = "source_name") -> DataFrame:
    """Observations with location_id and company: that of their source if it is a company, else of their place.

    `places` has canonical_key, id and company (trusted or null). Places it lacks have no id; `new_places` lists them.
    """
    found = places.select("canonical_key", F.col("id").alias("location_id"), F.col("company").alias("__place_company"))
    out = observations.join(found, text.canonical_key(F.col("location")) == F.col("canonical_key"), "left")
    own = text.trusted_company(F.col(source))
    return out.withColumn("company", identity.chosen_company(own, F.col(source), text.trusted_company(F.col("__place_company")))).drop("canonical_key", "__place_company")


def new_places(observations: DataFrame, places: DataFrame) -> DataFrame:
    """(canonical_key, name) of places that observations name and the dimension lacks."""
    return identity.missing_members(observations, places, "location")


def with_changes(observations: DataFrame) -> DataFrame:
    """Observations of a whole history with the change against the run before and the carried change, by composite key."""
    out = history.prior_run(observations, "composite_key", "captured_at", "position", "basis", "cash_price_bu", "cash_price_mt")
    return history.carried_change(out, "composite_key", "captured_at", "position", "basis")


def run_record(rows: DataFrame, snapshot: object, source: str, started_at: Column, completed_at: Column) -> DataFrame:
    """The run's record: counters of the sheet, status and times. A sheet without an accepted row has failed."""
    counted = run_counters(rows)
    status = F.when(F.col("normalized_row_count") > 0, "completed").otherwise("failed")
    return counted.withColumns({"snapshot_id": F.lit(snapshot), "source_name": F.lit(source), "status": status, "started_at": started_at, "completed_at": completed_at})


PRICES = ("basis", "cash_price_bu", "cash_price_mt")


def ingest_batch(rows: DataFrame, root: str, batch: int, source: str, captured_at: Column, buckets: int = 64) -> bool:
    """One batch from normalized sheet rows to stored tables, all of them visible at once: `observations` (with their changes
    and the carried change), `runs` and `state` (the latest row of each key, in buckets).

    The changes come from the state of the batch before, never from the history. A batch that is committed already, or that
    another attempt commits first, changes nothing (False); one that stops half-way leaves nothing to be seen.
    """
    spark = rows.sparkSession
    if transactions.is_committed(spark, root, batch):
        return False
    write = transactions.Transaction(spark, root, batch)
    rows = stored(rows, "sheet-rows")  # read for the observations and for the run's record, normalized once
    before = transactions.latest(spark, root, "state")
    state = read_bucketed(spark, before[1], "composite_key", buckets) if before else None
    seen = observed(rows, batch, captured_at)
    changes = latest.changed(seen, state, "composite_key", "captured_at", "position", PRICES, "basis", buckets)
    path = write.stage("observations", changes)
    changes = spark.read.schema(changes.schema).parquet(path).repartition(buckets, "composite_key")
    write_bucketed(latest.next_state(changes, state, "composite_key", "captured_at", "position", PRICES), write.path("state"), "composite_key", buckets)
    write.tables.append("state")
    write.stage("runs", run_record(rows, batch, source, captured_at, captured_at))
    return write.commit()
