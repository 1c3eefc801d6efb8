"""The ingest path as queries: two sheets cut from the orders become observations, runs and changes.

The sheets carry feed headers and text cells: blanks, null-like words, ticks, symbols, dollar signs, a file's name for a crop.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.functions import periods, text
from basisline.operators import market
from basisline.plans import ingest
from basisline.plans.label_queries import dealt, dealt_sql, in_sql, values_sql
from basisline.plans.queries import query, table
from basisline.sources import transactions
from basisline.storage import shared_dir

CROPS = ["Corn", "soybeans", "WHEAT", "Mixed Daily File", "Canola", "corn", "Milo", "", "Corn", "Soybean", "winter wheat"]
BUYERS = ["GLG", "Hensall HDC", "Agricharts", "", "Some Co"]
OPTIONS = ingest.SheetOptions(source_name="Default Buyer")
DAYS = ("1999-01-04 08:00:00", "1999-01-04 15:00:00")


def sheet(spark: SparkSession, sf_dir: str, batch: int, of: int = 2) -> DataFrame:
    """The sheet of a batch: every second (or n-th) order as a line of text cells."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    empty = lambda on, x: F.when(on, "").otherwise(x)
    month, year = F.month("o_orderdate"), F.year("o_orderdate")
    symbol = F.concat(F.lit("ZC"), F.substr(F.lit(periods.MONTH_CODES), month, F.lit(1)), F.lpad(s(year % 100), 2, "0"))
    return table(spark, sf_dir, "orders").where(k % of == batch).select(
        k.alias("position"),
        empty(c % 41 == 0, F.concat(F.lit("Elevator "), s(c % 60))).alias("Location"),
        dealt(CROPS, "o_orderkey").alias("Crop"),
        dealt(BUYERS, "o_custkey").alias("Buyer"),
        empty(k % 7 == 0, F.concat_ws(" ", periods.month_name(month), s(year))).alias("Delivery Period"),
        empty(k % 6 == 0, symbol).alias("Futures Mon."),
        empty(k % 10 == 0, F.concat(s(300 + c % 200), F.lit("'"), s(k % 8))).alias("Futures"),
        F.lit("-0.25").alias("Chg"),
        F.when(k % 13 == 0, "n/a").otherwise(s(c % 30 - 15)).alias("Basis"),
        F.concat(F.lit("$"), s(4 + k % 3), F.lit("."), F.lpad(s(k % 100), 2, "0")).alias("Cash Price"),
        empty(k % 4 < 2, F.concat(s(150 + k % 90), F.lit(".5"))).alias("MT Cash Price"),
    )


_NAMES = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"
_SHEET = f"""SELECT o_orderkey AS position, o_orderkey % 2 AS batch, CASE WHEN o_custkey % 41 = 0 THEN '' ELSE 'Elevator ' || (o_custkey % 60) END AS place, {dealt_sql(CROPS, 'o_orderkey')} AS crop, {dealt_sql(BUYERS, 'o_custkey')} AS buyer,
 CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE {_NAMES}[month(o_orderdate)] || ' ' || year(o_orderdate) END AS period, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'ZC' || substr('FGHJKMNQUVXZ', month(o_orderdate), 1) || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') END AS symbol,
 CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE (300 + o_custkey % 200) || '''' || (o_orderkey % 8) END AS futures, CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE CAST(o_custkey % 30 - 15 AS VARCHAR) END AS basis_cell,
 '$' || (4 + o_orderkey % 3) || '.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS cash_cell, CASE WHEN o_orderkey % 4 < 2 THEN '' ELSE (150 + o_orderkey % 90) || '.5' END AS mt_cell FROM orders"""
#: Every cell read from its text: symbols by position of the month code, ticks by their parts, units by crop.
_READ = rf"""sheet AS ({_SHEET}), al(k, v) AS {values_sql(text.SOURCE_ALIASES)}, ca(k, v) AS {values_sql(text.COMMODITY_ALIASES)},
 c1 AS (SELECT s.position, batch, nullif(place, '') AS location, coalesce(ca.v, nullif(crop, '')) AS commodity_name, coalesce(al.v, nullif(buyer, ''), 'Default Buyer') AS source_name, nullif(period, '') AS period,
 {_NAMES}[position(regexp_extract(symbol, '^Z[CSW]([A-Z])(\d\d)$', 1) IN 'FGHJKMNQUVXZ')] || ' ' || (2000 + TRY_CAST(regexp_extract(symbol, '^Z[CSW]([A-Z])(\d\d)$', 2) AS INT)) AS of_symbol,
 CAST(regexp_extract(futures, '^(\d+)''(\d)$', 1) AS VARCHAR) AS whole, regexp_extract(futures, '^(\d+)''(\d)$', 2) AS eighth, TRY_CAST(basis_cell AS DECIMAL(18, 6)) AS raw_basis, TRY_CAST(replace(cash_cell, '$', '') AS DECIMAL(18, 6)) AS cash_price_bu, TRY_CAST(mt_cell AS DECIMAL(18, 6)) AS mt
 FROM sheet s LEFT JOIN al ON al.k = lower(trim(buyer)) LEFT JOIN ca ON ca.k = lower(trim(crop))),
 c2 AS (SELECT *, CAST(CASE WHEN abs(raw_basis) >= 10 THEN round_even(raw_basis / 100, 2) ELSE raw_basis END AS DECIMAL(18, 6)) AS basis,
 CAST(coalesce(mt, round_even(cash_price_bu * CASE lower(commodity_name) WHEN 'soybeans' THEN 36.744 WHEN 'soybean' THEN 36.744 WHEN 'wheat' THEN 36.744 WHEN 'canola' THEN 44.092 ELSE 39.368 END, 2)) AS DECIMAL(18, 6)) AS cash_price_mt, coalesce(of_symbol, period) AS futures_month FROM c1),
 c3 AS (SELECT *, CASE WHEN period IS NULL AND of_symbol IS NOT NULL THEN {_NAMES}[(list_position({_NAMES}, split_part(of_symbol, ' ', 1)) + 10) % 12 + 1] || ' ' || (CAST(split_part(of_symbol, ' ', 2) AS INT) - CASE WHEN of_symbol LIKE 'January%' THEN 1 ELSE 0 END) END AS derived FROM c2),
 c4 AS (SELECT *, coalesce(derived, period) AS delivery_label, coalesce(TRY_CAST(whole AS DOUBLE) + TRY_CAST(eighth AS DOUBLE) / 8, CAST(cash_price_bu - basis AS DOUBLE)) AS futures_price FROM c3),
 c5 AS (SELECT *, CASE WHEN location IS NULL THEN 'missing_location' WHEN commodity_name IS NULL THEN 'missing_commodity_name' WHEN lower(commodity_name) IN {in_sql(text.INVALID_COMMODITIES)} THEN 'invalid_commodity_name' END AS early,
 list_filter([CASE WHEN delivery_label IS NULL THEN 'missing_delivery_window' END, CASE WHEN futures_month IS NULL THEN 'missing_futures_month' END, CASE WHEN basis IS NULL THEN 'missing_basis' END], lambda x: x IS NOT NULL) AS late FROM c4),
 read AS (SELECT *, CASE WHEN early IS NOT NULL THEN [early] ELSE late END AS reasons, lower(coalesce(location, '')) || '|' || lower(coalesce(commodity_name, '')) || '||' || lower(coalesce(derived, '')) || '|' || lower(coalesce(futures_month, '')) AS composite_key FROM c5),
 kept AS (SELECT *, count(*) OVER (PARTITION BY batch, composite_key) - 1 AS repeats FROM read WHERE len(reasons) = 0 QUALIFY row_number() OVER (PARTITION BY batch, composite_key ORDER BY position DESC) = 1)"""


def _captured(batch: int) -> Column:
    return F.lit(DAYS[batch]).cast("timestamp_ntz")


def _rows(spark: SparkSession, sf_dir: str, batch: int) -> DataFrame:
    return ingest.normalized(sheet(spark, sf_dir, batch), "position", OPTIONS)


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (ingest.observed(_rows(spark, sf_dir, b), b, _captured(b)) for b in (0, 1))
    return first.unionByName(second)


@query(
    f"""WITH {_READ} SELECT position, batch AS snapshot_id, location, commodity_name, source_name, delivery_label, futures_month, futures_price, CAST(basis AS DOUBLE) AS basis, CAST(cash_price_bu AS DOUBLE) AS cash_price_bu, CAST(cash_price_mt AS DOUBLE) AS cash_price_mt, composite_key, repeats FROM kept"""
)
def ingested_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sheets read cell by cell, rows without a reason kept, the last of each key."""
    money = [F.col(c).cast("double").alias(c) for c in ("futures_price", "basis", "cash_price_bu", "cash_price_mt")]
    return _observations(spark, sf_dir).select("position", F.col("snapshot_id").cast("long").alias("snapshot_id"), "location", "commodity_name", "source_name", "delivery_label", "futures_month", *money, "composite_key", "repeats")


@query(
    f"""WITH {_READ} SELECT batch AS snapshot_id, count(*) AS raw_row_count, count(DISTINCT CASE WHEN len(reasons) = 0 THEN composite_key END) AS normalized_row_count, count(*) FILTER (len(reasons) > 0) AS rejected_row_count,
 count(*) FILTER (len(reasons) = 0) - count(DISTINCT CASE WHEN len(reasons) = 0 THEN composite_key END) AS duplicate_key_count, CAST(sum(len(reasons)) AS BIGINT) AS missing_required_count, count(*) FILTER (len(reasons) = 0) / count(*) AS parse_success_rate, 'completed' AS status FROM read GROUP BY batch"""
)
def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each run: rows read, kept, rejected and repeated, and its status."""
    a, b = (ingest.run_record(_rows(spark, sf_dir, n), n, "feed", _captured(n), _captured(n)) for n in (0, 1))
    out = a.unionByName(b).withColumn("snapshot_id", F.col("snapshot_id").cast("long"))
    return out.select("snapshot_id", "raw_row_count", "normalized_row_count", "rejected_row_count", "duplicate_key_count", F.col("missing_required_count").cast("long").alias("missing_required_count"), "parse_success_rate", "status")


@query(
    f"""WITH {_READ}, h AS (SELECT position, batch, composite_key, basis, lag(basis) OVER (PARTITION BY composite_key ORDER BY batch, position) AS prior FROM kept)
 SELECT position, CAST(prior AS DOUBLE) AS prior_basis, CAST(basis - prior AS DOUBLE) AS basis_delta, CAST(coalesce(basis - prior, 0) AS DOUBLE) AS change FROM h WHERE batch = 1"""
)
def ingest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From sheets to changes: the second sheet's observations against the history of the first."""
    out = ingest.with_changes(_observations(spark, sf_dir)).where("snapshot_id = 1")
    return out.select("position", *[F.col(c).cast("double").alias(c) for c in ("prior_basis", "basis_delta", "change")])





@query(
    f"""WITH {_READ}, p AS (SELECT DISTINCT location, CAST(split_part(location, ' ', 2) AS INT) AS id FROM kept WHERE CAST(split_part(location, ' ', 2) AS INT) % 3 > 0)
 SELECT k.position, p.id AS location_id, CASE WHEN source_name <> 'Agricharts' THEN source_name WHEN p.id % 2 = 0 THEN 'Wanstead' END AS company FROM kept k LEFT JOIN p ON p.location = k.location"""
)
def ingested_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and companies of the observations: aggregators' rows take the company of their place, if it is trusted."""
    return ingest.located(_observations(spark, sf_dir), _places(spark, sf_dir)).select("position", "location_id", "company")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("o_custkey") % 60).cast("int")
    known = table(spark, sf_dir, "orders").select(number.alias("id")).distinct().where("id % 3 > 0")
    return known.select(F.concat(F.lit("elevator "), F.col("id").cast("string")).alias("canonical_key"), "id", F.when(F.col("id") % 2 == 0, "Wanstead").otherwise("Agricharts").alias("company"))


@query(f"WITH {_READ} SELECT lower(location) AS canonical_key, min(location) AS name FROM kept WHERE CAST(split_part(location, ' ', 2) AS INT) % 3 = 0 GROUP BY ALL")
def ingested_new_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that the observations name and the dimension lacks."""
    return ingest.new_places(_observations(spark, sf_dir), _places(spark, sf_dir))


@query(
    f"""WITH {_READ}, s AS (SELECT position, location, commodity_name, source_name, CASE WHEN position % 4 > 0 THEN delivery_label END AS period, CAST(basis AS DOUBLE) AS basis, CAST(cash_price_bu AS DOUBLE) AS cash, position % 5 AS k FROM kept)
 SELECT position AS id, location, commodity_name, CASE WHEN source_name = 'Agricharts' THEN '-' ELSE source_name END AS company_name, CASE WHEN source_name = 'Agricharts' THEN source_name END AS source_attribution, period AS delivery_label, CASE WHEN abs(basis) >= 10 THEN basis / 100 ELSE basis END AS basis,
 CASE WHEN k = 0 THEN 0.0 ELSE basis / 2 END AS basis_change, cash AS cash_price_bu FROM s"""
)
def preview_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The display projection of the observations."""


    o, k = _observations(spark, sf_dir), F.col("position")
    none = F.lit(None).cast("string")
    rows = o.select(
        k.alias("id"), "location", "commodity_name", "source_name", none.alias("company_name"), none.alias("location_company_name"), F.when(k % 4 > 0, F.col("delivery_label")).alias("delivery_label"), none.alias("delivery_end"), none.alias("delivery_start"),
        "futures_month", "futures_price", F.lit(float("nan")).alias("futures_change"), F.col("basis").cast("double").alias("basis"), F.when(k % 5 > 0, F.col("basis").cast("double") / 2).alias("basis_change"), F.col("cash_price_bu").cast("double").alias("cash_price_bu"),
        F.lit(None).cast("double").alias("cash_price_bu_change"), "cash_price_mt", F.lit(None).cast("double").alias("cash_price_mt_change"), "captured_at", F.lit(True).alias("is_canonical"), F.lit(1).alias("canonical_rank"), none.alias("canonical_reason"),
    )
    return market.preview_columns(rows).select("id", "location", "commodity_name", "company_name", "source_attribution", "delivery_label", "basis", "basis_change", "cash_price_bu")


@query(
    f"""WITH {_READ}, s AS (SELECT *, position % 3 = 0 AS canonical, CASE WHEN position % 5 = 0 THEN NULL ELSE futures_price END AS fp FROM kept), t AS (SELECT *, (CAST(fp IS NOT NULL AS INT) + 6) / 7.0 AS quality FROM s),
 m AS (SELECT *, list_position({_NAMES}, split_part(delivery_label, ' ', 1)) + 12 * CAST(split_part(delivery_label, ' ', 2) AS INT) AS dm, list_position({_NAMES}, split_part(futures_month, ' ', 1)) + 12 * CAST(split_part(futures_month, ' ', 2) AS INT) AS fm FROM t)
 SELECT position FROM m WHERE fp IS NOT NULL AND quality >= 0.8 AND canonical AND dm >= 1996 * 12 + 6 AND fm >= 1996 * 12 + 6"""
)
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users see: complete canonical rows of good quality whose periods have not passed."""


    o, k = _observations(spark, sf_dir), F.col("position")
    none = F.lit(None).cast("string")
    rows = o.withColumns({"futures_price": F.when(k % 5 > 0, F.col("futures_price")), "is_canonical": k % 3 == 0, "delivery_start": none, "delivery_end": none})
    return market.visible(rows, F.lit("1996-06-15").cast("date")).select("position")


BATCH_TIMES = ("1999-01-04 08:00:00", "1999-01-04 15:00:00", "1999-01-05 12:00:00")


def ingested(spark: SparkSession, sf_dir: str, root: str, buckets: int = 16) -> None:
    """Three sheets, batch by batch, into the stored tables under `root`."""
    for n, at in enumerate(BATCH_TIMES):
        rows = ingest.normalized(sheet(spark, sf_dir, n, len(BATCH_TIMES)), "position", OPTIONS)
        ingest.ingest_batch(rows, root, n, "feed", F.lit(at).cast("timestamp_ntz"), buckets)


_BATCHES = _READ.replace("o_orderkey % 2 AS batch", "o_orderkey % 3 AS batch")


@query(
    f"""WITH {_BATCHES}, t AS (SELECT position, batch, composite_key, CAST(basis AS DOUBLE) AS basis, CAST(cash_price_bu AS DOUBLE) AS cash, ['{"', '".join(BATCH_TIMES)}'][batch + 1]::TIMESTAMP AS ts FROM kept),
 h AS (SELECT *, lag(basis) OVER k AS prior_basis, lag(cash) OVER k AS prior_cash FROM t WINDOW k AS (PARTITION BY composite_key ORDER BY batch)),
 m AS (SELECT *, last_value(CASE WHEN prior_basis IS NULL OR basis IS NULL OR basis <> prior_basis THEN {{'ts': ts, 'by': basis - prior_basis}} END IGNORE NULLS) OVER (PARTITION BY composite_key ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mark FROM h)
 SELECT position, batch, prior_basis, round(basis - prior_basis, 6) AS basis_delta, round(cash - prior_cash, 6) AS cash_delta, CASE WHEN mark.by IS NOT NULL AND ts - mark.ts <= INTERVAL 24 HOUR THEN round(mark.by, 6) ELSE 0 END AS change,
 CASE WHEN mark.by IS NOT NULL AND ts - mark.ts <= INTERVAL 24 HOUR THEN mark.ts END AS changed_at FROM m"""
)
def ingest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches through the latest state of each key: changes and carried changes as windows over all history give them."""
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    ingested(spark, sf_dir, root)
    money = [F.round(F.col(c).cast("double"), 6).alias(n) for c, n in (("prior_basis", "prior_basis"), ("basis_delta", "basis_delta"), ("cash_price_bu_delta", "cash_delta"), ("change", "change"))]
    return transactions.committed(spark, root, "observations").select("position", "batch", *money, "changed_at")


@query(
    f"""WITH {_BATCHES} SELECT batch, count(*) AS raw_row_count, count(DISTINCT CASE WHEN len(reasons) = 0 THEN composite_key END) AS normalized_row_count, (SELECT count(DISTINCT composite_key) FROM kept) AS keys_in_state FROM read GROUP BY batch"""
)
def committed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of three committed batches beside the number of keys in the latest state; a batch that broke off shows nothing."""
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    ingested(spark, sf_dir, root)
    broken = transactions.Transaction(spark, root, len(BATCH_TIMES))
    broken.stage("runs", transactions.committed(spark, root, "runs").drop("batch"))
    state = spark.read.parquet(transactions.latest(spark, root, "state")[1]).agg(F.count(F.lit(1)).alias("keys_in_state"))
    return transactions.committed(spark, root, "runs").select("batch", "raw_row_count", "normalized_row_count").join(F.broadcast(state), F.lit(True))  # one row


@query(
    f"""WITH {_READ} SELECT CAST(position AS VARCHAR) AS id, CAST(batch AS VARCHAR) AS snapshot_id, strftime(['{DAYS[0]}', '{DAYS[1]}'][batch + 1]::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') AS captured_at, location, commodity_name, source_name, CASE WHEN source_name <> 'Agricharts' THEN source_name END AS company_name,
 CASE WHEN source_name = 'Agricharts' THEN source_name END AS source_attribution, delivery_label, futures_month, CASE WHEN abs(basis) >= 10 THEN CAST(basis AS DOUBLE) / 100 ELSE CAST(basis AS DOUBLE) END AS basis, 0.0 AS basis_change, CASE WHEN position % 2 = 0 THEN strftime(TIMESTAMP '1999-01-03 00:00:00' + to_microseconds(position), '%Y-%m-%dT%H:%M:%S') || CASE WHEN position % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(position % 1000000 AS VARCHAR), 6, '0') END END AS basis_last_changed_at FROM kept"""
)
def listed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row projection of a listing over the observations."""
    o, k = _observations(spark, sf_dir), F.col("position")
    none = F.lit(None).cast("string")
    moved = F.timestamp_micros(F.unix_micros(F.lit("1999-01-03 00:00:00").cast("timestamp")) + k.cast("long"))
    more = {"id": k, "company_id": none, "location_id": none, "company_name": none, "location_company_name": none, "basis_change": F.lit(None).cast("double"), "cash_price_bu_change": F.lit(float("nan")), "cash_price_mt_change": F.lit(None).cast("double"), "basis_last_changed_at": F.when(k % 2 == 0, moved), "is_canonical": F.lit(True), "canonical_rank": F.lit(1), "canonical_reason": none}
    return market.list_columns(o.withColumns(more)).select("id", "snapshot_id", "captured_at", "location", "commodity_name", "source_name", "company_name", "source_attribution", "delivery_label", "futures_month", "basis", "basis_change", "basis_last_changed_at")
