"""Queries that write the given tables by a sink, read them back by a reader, and equal the tables; and the label, board and
contract functions that no other query reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.functions import keys, periods, prices
from basisline.operators import canonical, market, pricing
from basisline.plans.label_queries import dealt, dealt_sql
from basisline.plans.queries import _BOARD, _MONTH_NAMES, query, table
from basisline.plans.store_queries import _folder
from basisline.sources import readers, sinks

_NOTES = ["=SUM(A1)", "plain", "-5", "two\nlines", 'a "quoted", cell', "@x", "Öl"]


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", dealt(_NOTES, "c_custkey").alias("note"), F.when(F.col("c_custkey") % 9 > 0, F.round("c_acctbal", 2)).alias("balance"), F.col("c_mktsegment").alias("Source"))


_SAFE = f"CASE WHEN regexp_matches({dealt_sql(_NOTES, 'c_custkey')}, '^[=+\\-@]') THEN '''' || {dealt_sql(_NOTES, 'c_custkey')} ELSE {dealt_sql(_NOTES, 'c_custkey')} END"


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 > 0 THEN round(c_acctbal, 2) END AS balance, c_custkey % 2 = 0 AS flag FROM customer")
def typed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through a CSV file and back with the types that its cells show; NaN is missing."""
    path = _folder(spark, "typed")
    k = F.col("c_custkey")
    rows = _noted(spark, sf_dir).select("c_custkey", F.coalesce("balance", F.lit(float("nan"))).alias("balance"), (k % 2 == 0).alias("flag"))
    sinks.export_csv(rows, path)
    return readers.read_typed_csv(spark, path)


@query(f"SELECT c_custkey, {_SAFE} AS note FROM customer")
def uploaded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported sheets read as uploads, file by file: quotes, line breaks and letters survive, formulas are defused."""
    path = _folder(spark, "uploads")
    sinks.export_csv(_noted(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("c_custkey"), F.regexp_replace("note", '"', "'").alias("note"), F.length("note").alias("n")), path)
    back = readers.read_uploads(spark, f"{path}/*.csv").select(F.col("cells")["c_custkey"].cast("long").alias("c_custkey"), F.col("cells")["note"].alias("note"))
    return back.withColumn("note", F.when(F.col("note").startswith("a '"), F.regexp_replace("note", "'", '"')).otherwise(F.col("note")))


@query("SELECT c_mktsegment AS source, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS key_sum FROM customer GROUP BY ALL")
def consolidated_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's rows by source, dated and as the latest; read back from the latest."""
    folder = _folder(spark, "consolidated")
    sinks.export_by_source(_noted(spark, sf_dir).select("c_custkey", "balance", "Source"), folder, "2026-06-10")
    latest, dated = (readers.read_text_csv(spark, f"{folder}/{x}") for x in ("latest", "dated/2026-06-10"))
    rows = latest.select("c_custkey", "Source").intersect(dated.select("c_custkey", "Source"))
    return rows.groupBy(F.col("Source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c_custkey").cast("long")).alias("key_sum"))


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders UNION ALL SELECT -1 - o_orderkey, 'N', 0.0 FROM orders WHERE o_orderkey % 50 = 0")
def replaced_and_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table that is replaced, then appended to, and exported as JSON."""
    path, out = _folder(spark, "table"), _folder(spark, "json") + ".json"
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    sinks.replace_table(o.limit(1), path)
    sinks.replace_table(o, path)
    sinks.append_rows(o.where("o_orderkey % 50 = 0").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice")), path)
    sinks.export_json(spark.read.parquet(path), out)
    return readers.read_any(spark, out).select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def captured_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day of a history that lies in days: other days' files are not read."""
    path = _folder(spark, "history")
    sinks.append_history(table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("captured_at")), path)
    history = spark.read.parquet(path)
    return history.where(F.col("capture_date") == F.lit(history.agg(F.max("capture_date")).first()[0])).select("event_id", "user_id")


@query(
    f"""WITH b AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) * 12 + month(o_orderdate) WHEN 1 THEN (2000 + year(o_orderdate) % 100) * 12 + 10 END AS k, CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 6 ELSE 99 END AS r FROM ({_BOARD}))
 SELECT o_orderkey FROM b ORDER BY lower(location), r, lower(coalesce(crop, '')), lower(coalesce(company, '')), k NULLS LAST, o_orderkey LIMIT 500"""
)
def board_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the whole board in display order."""
    o, kind, year = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3, F.year("o_orderdate")
    delivery = F.when(kind == 0, F.concat_ws(" ", periods.month_name(F.month("o_orderdate")), year.cast("string"))).when(kind == 1, F.concat_ws(" ", F.lit("Harvest"), F.lpad((year % 100).cast("string"), 2, "0")))
    crop = dealt(["Corn", "soybeans", "SRW Wheat", "HRW", "Wheat", "Oats", None], "o_orderkey")
    rows = o.select("o_orderkey", F.col("o_orderpriority").alias("location"), crop.alias("commodity_name"), F.col("o_orderstatus").alias("company_name"), delivery.alias("delivery_label"), F.lit(None).cast("string").alias("futures_month"))
    return rows.orderBy(*market.display_order(tie=("o_orderkey",))).limit(500).select("o_orderkey")


_CROPS = ["Corn", "Old soybeans", "Wheat", None]
_QUOTES = ["424-0", "4.56", "n/a", "456", "$5.10", None]


@query(
    f"""WITH o AS (SELECT *, {dealt_sql(_CROPS, 'o_orderkey')} AS crop, {dealt_sql(_QUOTES, 'o_custkey')} AS quote, {_MONTH_NAMES}[month(o_orderdate)] || ' ' || year(o_orderdate) AS delivery, CASE {dealt_sql(_QUOTES, 'o_custkey')} WHEN '424-0' THEN 4.24 WHEN '4.56' THEN 4.56 WHEN '456' THEN 4.56 WHEN '$5.10' THEN 5.1 END AS futures FROM orders)
 SELECT o_orderkey, round_even((o_totalprice % 10) - futures, 2) + 0.0 AS posted_basis, CASE WHEN crop = 'Corn' THEN 2026 * 12 + 12 WHEN crop = 'Old soybeans' THEN 2026 * 12 + 11 END AS new_crop, {_MONTH_NAMES}[month(o_orderdate) % 12 + 1] || ' ' || (year(o_orderdate) + month(o_orderdate) // 12) AS next_contract,
 round(((o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT + (o_orderkey % 5 = 0)::INT) / 3, 9) AS quality, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_custkey - o_orderkey AS BIGINT) END AS delta FROM o"""
)
def posted_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posted prices against their quotes, harvest contracts, the contract after a delivery, completeness, changes."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    delivery = F.concat_ws(" ", periods.month_name(F.month("o_orderdate")), F.year("o_orderdate").cast("string"))
    return o.select(
        "o_orderkey",
        (pricing.posted_basis(F.col("o_totalprice") % 10, dealt(_QUOTES, "o_custkey")) + 0.0).alias("posted_basis"),
        pricing.new_crop_key(dealt(_CROPS, "o_orderkey"), 2026).alias("new_crop"),
        pricing.next_contract(delivery).alias("next_contract"),
        F.round(canonical.quality_of(k % 2 == 0, k % 3 == 0, k % 5 == 0), 9).alias("quality"),
        prices.delta(F.col("o_custkey"), F.when(k % 4 > 0, k)).cast("long").alias("delta"),
    )


@query("SELECT 'Place ' || o_orderstatus AS location, 'Corn' AS commodity, '' AS futures_change, CAST(o_orderkey AS VARCHAR) AS basis, 'May 2026' AS delivery_end, '' AS futures_price FROM orders")
def standard_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets under feed headers in any case and punctuation, as the standard columns."""
    o = table(spark, sf_dir, "orders")
    sheet = o.select(F.concat(F.lit("Place "), "o_orderstatus").alias("LOCATION name"), F.lit("Corn").alias("commodity"), F.col("o_orderkey").alias("Basis"), F.lit("May 2026").alias("Delivery-Label"), F.lit(None).cast("string").alias("CBOT Futures"))
    return keys.standard_sheet(sheet).select("location", "commodity", "futures_change", "basis", "delivery_end", "futures_price")
