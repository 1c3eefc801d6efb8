"""Queries that run every operator family on the shared tables, each with DuckDB SQL for the same rows.

Stand-ins: `events` are observations (key user_id|event_type, basis floor(value / 10)), `lineitem` with its dimensions are
bids. Every computed column has one name on both sides; floating sums are rounded; every order ends in something unique.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basisline.functions import keys, periods, prices, text
from basisline.operators import alerts, canonical, diagnostics, health, history, identity, market, pricing, reshape
from basisline.operators.sizes import by_distinct
from basisline.sources import pages as web
from basisline.sources.readers import payload_field

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", "user_id", "event_type", F.floor(F.col("value") / 10).cast("double").alias("basis"), "value", "props")


OBS = "SELECT event_id AS id, CAST(user_id AS VARCHAR) || '|' || event_type AS key, ts, user_id, event_type, CAST(floor(value / 10) AS DOUBLE) AS basis, value, props FROM events"


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bids: one line per lineitem row, with place, region, company, crop, delivery month and prices."""
    li, o, s = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "supplier"))
    n, r, p = (table(spark, sf_dir, x) for x in ("nation", "region", "part"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    j = j.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(
        F.col("n_name").alias("location"), F.col("r_name").alias("region"), F.col("s_name").alias("company"), F.col("p_type").alias("commodity"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("delivery"),
        F.col("o_orderdate").alias("captured_at"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("cash"), F.col("l_discount").alias("basis"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
    )


BIDS = """SELECT n_name AS location, r_name AS region, s_name AS company, p_type AS commodity, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS delivery,
 o_orderdate AS captured_at, l_extendedprice / l_quantity AS cash, l_discount AS basis, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

BID_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "basis", "delivery")
_ORDER_SQL = ", ".join(BID_ORDER)


# ---------------------------------------------------------------- reading: scopes, filters, views


@query(
    f"""WITH o AS ({OBS}), d AS (SELECT *, basis - lag(basis) OVER w AS moved FROM o WINDOW w AS (PARTITION BY key ORDER BY ts, id)),
 m AS (SELECT *, last_value(CASE WHEN moved IS NULL OR moved <> 0 THEN ts END IGNORE NULLS) OVER w AS mark_at, last_value(CASE WHEN moved IS NULL OR moved <> 0 THEN coalesce(moved, -1e18) END IGNORE NULLS) OVER w AS by_
 FROM d WINDOW w AS (PARTITION BY key ORDER BY ts, id ROWS UNBOUNDED PRECEDING)),
 c AS (SELECT id, key, ts, basis, moved AS basis_delta, CASE WHEN by_ > -1e17 AND ts - mark_at <= INTERVAL 24 HOURS THEN by_ ELSE 0.0 END AS change FROM m)
 SELECT id, key, ts, basis, basis_delta, change FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS n FROM c) WHERE n = 1
 ORDER BY abs(change) DESC, ts DESC, id LIMIT 100"""
)
def latest_market_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest observation of each key with its change against the run before and the carried change: the largest movers."""
    df = history.prior_run(observations(spark, sf_dir), "key", "ts", "id", "basis")
    df = history.carried_change(df, "key", "ts", "id", "basis")
    df = reshape.keep_first(df, ["key"], [F.col("ts").desc(), F.col("id").desc()])
    return market.movers(df, "change", "ts", "id", 100).select("id", "key", "ts", "basis", "basis_delta", "change")


@query(
    """SELECT c_mktsegment, l_returnflag, count(*) AS bids, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 WHERE c_mktsegment = 'BUILDING' GROUP BY ALL"""
)
def star_join_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "snapshot_id")
    snaps = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "snapshot_id", "o_custkey": "source_id"})
    sources = table(spark, sf_dir, "customer").withColumnsRenamed({"c_custkey": "source_id", "c_mktsegment": "org_id"})
    df = market.star(facts, snaps, sources, "BUILDING")
    return df.groupBy(F.col("org_id").alias("c_mktsegment"), "l_returnflag").agg(F.count(F.lit(1)).alias("bids"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%' AND p_type ILIKE '%o_%'")
def ilike_contains_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(market.contains(F.col("p_name"), " A ") & market.contains(F.col("p_type"), "o_")).select("p_partkey", "p_name")


_LABELS = "['GLG', ' agris ', 'LAC', 'Hensall HDC', 'thompsons ltd', 'Agricharts', 'Ontario Daily File', 'N/A', 'Some  Elevator', 'snobelen']"
_LABEL_LIST = ["GLG", " agris ", "LAC", "Hensall HDC", "thompsons ltd", "Agricharts", "Ontario Daily File", "N/A", "Some  Elevator", "snobelen"]


@query(
    f"""WITH l AS (SELECT s_suppkey, {_LABELS}[CAST(s_suppkey % 10 AS INT) + 1] AS raw FROM supplier)
 SELECT s_suppkey, CASE s_suppkey % 10 WHEN 0 THEN 'Great Lakes Grain' WHEN 1 THEN 'Great Lakes Grain' WHEN 2 THEN 'London Agricultural Commodities' WHEN 3 THEN 'Hensall Co-operative' WHEN 4 THEN 'The Andersons'
 WHEN 5 THEN 'Agricharts' WHEN 6 THEN 'Ontario Cash Bids' WHEN 8 THEN 'Some Elevator' WHEN 9 THEN 'Snobelen Farms' END AS source, s_suppkey % 10 = 6 AS regional, s_suppkey % 10 IN (0, 1) AND lower(trim(raw)) IN ('glg', 'great lakes grain') AS wanted,
 CASE WHEN s_suppkey % 10 NOT IN (5, 6, 7) THEN 'company' WHEN s_suppkey % 10 = 7 THEN 'none' ELSE 'other' END AS identity FROM l"""
)
def alias_membership_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.get(F.array(*[F.lit(x) for x in _LABEL_LIST]), (F.col("s_suppkey") % 10).cast("int"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw"))
    name = text.canonical_source(F.col("raw"))
    identity_ = F.when(text.creates_company(F.col("raw")), "company").when(name.isNull(), "none").otherwise("other")
    return s.select("s_suppkey", name.alias("source"), (text.source_scope(F.col("raw")).scope == "region").alias("regional"), market.source_is(F.col("raw"), "GLG").alias("wanted"), identity_.alias("identity"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1995-03-10' AND o_orderdate < DATE '1995-03-11'")
def captured_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(market.on_day(F.col("o_orderdate"), "1995-03-10")).select("o_orderkey", "o_orderdate")


_QUALITY_SQL = """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'Mixed Daily File' ELSE 'Corn' END AS commodity_name, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'May 1996' END AS futures_month,
 nullif(o_orderstatus, 'F') IS NOT NULL AS has_futures, o_orderkey % 3 <> 0 AS has_basis, o_orderkey % 11 <> 0 AS has_bu, o_orderkey % 13 <> 0 AS has_mt, o_orderpriority <> '1-URGENT' AS has_delivery FROM orders"""


@query(
    f"""WITH q AS ({_QUALITY_SQL}), s AS (SELECT *, (CAST(lower(trim(commodity_name)) <> 'mixed daily file' AS INT) + CAST(futures_month IS NOT NULL AS INT) + CAST(has_futures AS INT) + CAST(has_basis AS INT) + CAST(has_bu AS INT)
 + CAST(has_mt AS INT) + CAST(has_delivery AS INT)) / 7.0 AS quality FROM q)
 SELECT o_orderkey, round(quality, 6) AS quality, futures_month IS NOT NULL AND has_futures AND has_basis AND has_bu AND has_mt AND has_delivery AS is_complete FROM s WHERE quality >= 0.8"""
)
def quality_score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = lambda ok: F.when(ok, F.col("o_totalprice"))
    df = o.select(
        k, F.when(k % 7 == 0, "Mixed Daily File").otherwise("Corn").alias("commodity_name"), F.when(k % 5 != 0, "May 1996").alias("futures_month"), price(F.nullif("o_orderstatus", F.lit("F")).isNotNull()).alias("futures_price"), price(k % 3 != 0).alias("basis"),
        price(k % 11 != 0).alias("cash_price_bu"), price(k % 13 != 0).alias("cash_price_mt"), F.when(F.col("o_orderpriority") != "1-URGENT", "April 1996").alias("delivery_label"), F.lit(None).cast("string").alias("delivery_end"), F.lit(None).cast("string").alias("delivery_start"),
    )
    return df.select(k, F.round(market.read_quality(df), 6).alias("quality"), market.complete(df).alias("is_complete")).where("quality >= 0.8")


_MONTH_NAMES = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"


@query(
    f"""WITH l AS (SELECT o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) AS m, {_MONTH_NAMES}[month(o_orderdate)] || ' ' || year(o_orderdate) AS label, o_orderkey % 4 AS kind FROM orders)
 SELECT o_orderkey, CASE kind WHEN 0 THEN label WHEN 1 THEN 'Harvest crop' WHEN 2 THEN lower(label) ELSE split_part(label, ' ', 1) END AS label FROM l WHERE kind IN (1, 3) OR m >= 1996 * 12 + 6"""
)
def period_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    full = F.concat_ws(" ", periods.month_name(F.month(d)), F.year(d).cast("string"))
    label = F.when(k == 0, full).when(k == 1, "Harvest crop").when(k == 2, F.lower(full)).otherwise(F.split_part(full, F.lit(" "), F.lit(1)))
    as_of = F.lit("1996-06-15").cast("date")
    df = table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"))
    shown = periods.current(F.col("label"), as_of) & ~periods.expired(F.col("label"), F.lit(None).cast("string"), as_of)
    return by_distinct(df, ["label"], shown=shown).where("shown").drop("shown")


@query(
    """WITH r AS (SELECT event_id, ts, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS run, event_id // 50 AS snapshot FROM events),
 runs AS (SELECT event_type AS source, user_id AS run, CASE WHEN user_id % 2 = 0 THEN 'completed' ELSE 'failed' END AS status, min(ts) AS started_at, max(ts) AS completed_at FROM events GROUP BY ALL),
 lr AS (SELECT source, run FROM runs WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY source ORDER BY completed_at DESC, started_at DESC, run DESC) = 1),
 ls AS (SELECT event_type, snapshot FROM r QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, snapshot DESC) = 1)
 SELECT r.event_id, r.event_type, r.run, r.snapshot FROM r LEFT JOIN lr ON lr.source = r.event_type JOIN ls ON ls.event_type = r.event_type WHERE (r.run IS NOT NULL AND r.run = lr.run) OR (r.run IS NULL AND r.snapshot = ls.snapshot)"""
)
def freshness_latest_run_or_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    runs = e.groupBy(F.col("event_type").alias("source"), F.col("user_id").alias("run")).agg(F.when(F.first("user_id") % 2 == 0, "completed").otherwise("failed").alias("status"), F.min("ts").alias("started_at"), F.max("ts").alias("completed_at"))
    rows = e.select("event_id", "ts", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("run"), F.floor(F.col("event_id") / 50).alias("snapshot"))
    return market.fresh(rows, runs, source="event_type", run_id="run", snapshot="snapshot", at="ts").select("event_id", "event_type", "run", "snapshot")


@query(
    f"""WITH h AS (SELECT * FROM ({BIDS}) ORDER BY cash DESC, {_ORDER_SQL} LIMIT 600), d AS (SELECT *, row_number() OVER (PARTITION BY location, commodity, delivery ORDER BY cash DESC, {_ORDER_SQL}) AS n FROM h)
 SELECT location, commodity, delivery, cash, l_orderkey FROM d WHERE n = 1 ORDER BY cash DESC, {_ORDER_SQL} LIMIT 200"""
)
def preview_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("cash").desc(), *map(F.col, BID_ORDER)]
    return market.preview(bids(spark, sf_dir), ["location", "commodity", "delivery"], order, 200).select("location", "commodity", "delivery", "cash", "l_orderkey")


@query(
    f"""SELECT delivery, location, cash, basis, CAST(place AS BIGINT) AS place, row_count FROM (SELECT *, row_number() OVER (PARTITION BY delivery ORDER BY cash DESC, basis DESC, location, {_ORDER_SQL}) AS place,
 count(*) OVER (PARTITION BY delivery) AS row_count FROM ({BIDS})) WHERE place <= 8"""
)
def grouped_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("cash").desc(), F.col("basis").desc(), F.col("location"), *map(F.col, BID_ORDER)]
    top = market.grouped_top(bids(spark, sf_dir), F.col("delivery").cast("string"), order, 8, "cash")
    return top.select("delivery", "location", "cash", "basis", F.col("place").cast("long").alias("place"), "row_count")


@query(
    f"""SELECT id, key, ts, moved AS basis_delta FROM (SELECT *, basis - lag(basis) OVER (PARTITION BY key ORDER BY ts, id) AS moved FROM ({OBS})) WHERE moved IS NOT NULL ORDER BY abs(moved) DESC, ts DESC, id LIMIT 100"""
)
def top_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = history.prior_run(observations(spark, sf_dir), "key", "ts", "id", "basis")
    return market.movers(df, "basis_delta", "ts", "id", 100).select("id", "key", "ts", "basis_delta")


@query("SELECT round(avg(CASE WHEN abs(l_quantity) >= 10 THEN l_quantity / 100.0 ELSE l_quantity END), 6) AS average_basis, count(*) AS bids FROM lineitem")
def market_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = market.summary(table(spark, sf_dir, "lineitem").withColumn("basis", F.col("l_quantity").cast("double")))
    return found.select(F.round("average_basis", 6).alias("average_basis"), "bids")


@query(
    f"""SELECT company AS name, count(DISTINCT location || '|' || commodity || '|' || CAST(delivery AS VARCHAR)) AS market_count FROM ({BIDS}) GROUP BY company HAVING count(DISTINCT location || '|' || commodity || '|' || CAST(delivery AS VARCHAR)) >= 2"""
)
def facets_distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir).withColumn("composite_key", F.concat_ws("|", "location", "commodity", F.col("delivery").cast("string")))
    return market.facet(df, F.col("company"), at_least=2)


@query("SELECT l_partkey AS composite_key, count(*) AS candidate_count FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) GROUP BY l_partkey")
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("composite_key"))
    return market.candidate_counts(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("composite_key")), page)


@query("SELECT o_orderpriority, count(*) AS row_count, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS canonical_count, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*) AS winner_rate FROM orders GROUP BY ALL")
def source_winner_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.winner_rates(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F")


@query(
    """SELECT o_orderkey AS id, nullif(o_orderstatus, 'P') AS kind, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS basis FROM orders
 ORDER BY basis DESC NULLS FIRST, CASE kind WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey LIMIT 2500"""
)
def sort_mode_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "automated").when(F.col("o_orderstatus") == "O", "file")
    df = o.select(F.col("o_orderkey").alias("id"), F.nullif("o_orderstatus", F.lit("P")).alias("kind"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("basis"), kind.alias("source_type"), F.col("o_orderdate").alias("captured_at"))
    return df.orderBy(*market.order_of("basis_desc")).limit(2500).select("id", "kind", "basis")


@query("SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_nationkey, NULL, s_acctbal FROM supplier")
def union_by_name_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return reshape.union_aligned([c, s])


@query("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def distinct_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query(
    """WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT (SELECT count(*) FROM c) AS seen, (SELECT count(*) FROM s) AS mapped,
 (SELECT count(*) FROM c WHERE k IN (SELECT k FROM s)) AS "both", (SELECT count(*) FROM c WHERE k NOT IN (SELECT k FROM s)) AS unmapped"""
)
def set_intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return identity.coverage(c, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), "k")


# ---------------------------------------------------------------- reshaping


@query("SELECT l_orderkey, l_linenumber, l_partkey, metric, value FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR metric IN (l_quantity, l_discount, l_tax))")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.to_long(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"])


@query("SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY ALL")
def rows_to_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.to_wide(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.round(F.sum("o_totalprice"), 2))


# ---------------------------------------------------------------- labels, periods, prices, keys


@query("SELECT p_partkey, lower(trim(p_name)) || '|' || lower(p_brand) || '||' || lower(trim(regexp_replace('  ' || p_type || '   X ', '\\s+', ' ', 'g'))) || '|' || p_size AS composite_key FROM part")
def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    spaced = F.concat(F.lit("  "), "p_type", F.lit("   X "))
    return p.select("p_partkey", keys.composite_key(F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string"), spaced, F.col("p_size")).alias("composite_key"))


@query(
    f"""WITH l AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderkey % 6 AS kind, {_MONTH_NAMES}[month(o_orderdate)] AS name FROM orders)
 SELECT o_orderkey, CAST(CASE kind WHEN 0 THEN y * 12 + m WHEN 1 THEN (2000 + y % 100) * 12 + m WHEN 2 THEN (2000 + y % 100) * 12 + 10 WHEN 3 THEN 9999 * 12 + m WHEN 4 THEN y * 12 + m ELSE (2000 + y % 100) * 12 + m END AS INT) AS month_key FROM l"""
)
def month_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 6
    name, yy = periods.month_name(F.month(d)), F.lpad((F.year(d) % 100).cast("string"), 2, "0")
    code = F.substr(F.lit(periods.MONTH_CODES), F.month(d), F.lit(1))
    label = (
        F.when(kind == 0, F.concat_ws(" ", name, F.concat(F.dayofmonth(d).cast("string"), F.lit(",")), F.year(d).cast("string")))
        .when(kind == 1, F.concat_ws("-", F.substr(name, F.lit(1), F.lit(3)), yy))
        .when(kind == 2, F.concat_ws(" ", F.lit("Harvest"), yy))
        .when(kind == 3, F.concat_ws(" ", name, F.least(F.dayofmonth(d), F.lit(28)).cast("string")))
        .when(kind == 4, F.concat_ws(" ", name, F.year(d).cast("string")))
        .otherwise(F.concat(code, yy))
    )
    labels = table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"))
    return by_distinct(labels, ["label"], month_key=periods.month_key(F.col("label"))).drop("label")


@query(
    """WITH t AS (SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS w, p_partkey % 8 AS e, p_partkey % 5 AS kind FROM part)
 SELECT p_partkey, CAST(CASE kind WHEN 0 THEN w + e / 8.0 WHEN 1 THEN w + e / 8.0 WHEN 2 THEN w + (e + 10) / 100.0 WHEN 3 THEN w + 0.5 ELSE NULL END AS DOUBLE) AS price FROM t"""
)
def tick_price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, w, e = F.col("p_partkey") % 5, F.floor("p_retailprice").cast("string"), (F.col("p_partkey") % 8).cast("string")
    label = (
        F.when(k == 0, F.concat(w, F.lit("'"), e, F.lit("s")))
        .when(k == 1, F.concat(w, F.lit("-"), e))
        .when(k == 2, F.concat(w, F.lit("'"), (F.col("p_partkey") % 8 + 10).cast("string")))
        .when(k == 3, F.concat(F.lit("$"), F.format_number(F.floor("p_retailprice"), 0), F.lit(".5")))
        .otherwise("NaN")
    )
    return table(spark, sf_dir, "part").select("p_partkey", prices.tick_price(label).cast("double").alias("price"))


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name || ' Branch' WHEN 3 THEN p_name || ' / West' WHEN 4 THEN p_name || ' Wet Corn' ELSE 'Straffordville' END AS location FROM part"""
)
def location_label_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    label = (
        F.when(k == 0, F.concat(n, F.lit("  Soybeans")))
        .when(k == 1, F.concat(n, F.lit(", GLG")))
        .when(k == 2, F.concat(F.lit("Any "), n, F.lit(" Branch")))
        .when(k == 3, F.concat(n, F.lit("/West")))
        .when(k == 4, F.concat(n, F.lit(" Wet Corn")))
        .otherwise("staffordville Corn")
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.canonical_location(label).alias("location"))


@query(
    """SELECT p_partkey, CAST(round_even(CAST(p_retailprice AS DECIMAL(18, 6)) * CASE WHEN p_size % 3 = 0 THEN 36.744 WHEN p_size % 3 = 1 THEN 44.092 ELSE 39.368 END, 2) AS DOUBLE) AS tonne,
 CAST(CASE WHEN p_size >= 10 THEN round_even(CAST(p_size AS DECIMAL(18, 6)) / 100, 2) ELSE p_size END AS DOUBLE) AS basis FROM part"""
)
def unit_conversion_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop = F.get(F.array(F.lit("Soybeans"), F.lit("canola"), F.lit("Milo")), F.col("p_size") % 3)
    size = F.col("p_size").cast(prices.PRICE)
    return table(spark, sf_dir, "part").select("p_partkey", prices.per_tonne(crop, F.col("p_retailprice").cast(prices.PRICE)).cast("double").alias("tonne"), prices.basis_to_store(size).cast("double").alias("basis"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", payload_field(F.col("props"), "k").try_cast("long").alias("k"))


# ---------------------------------------------------------------- history


@query(f"SELECT id, basis, lag(basis) OVER w AS prior_basis, basis - lag(basis) OVER w AS basis_delta FROM ({OBS}) WINDOW w AS (PARTITION BY key ORDER BY ts, id)")
def prior_run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.prior_run(observations(spark, sf_dir), "key", "ts", "id", "basis").select("id", "basis", "prior_basis", "basis_delta")


@query(
    f"""WITH o AS (SELECT *, CAST(ts AS DATE) AS d FROM ({OBS})), w AS (SELECT event_type, d, arg_max(basis, (ts, id)) AS v FROM o WHERE isodow(d) <= 5 GROUP BY ALL),
 k AS (SELECT DISTINCT o.d AS batch, o.event_type FROM o), pd AS (SELECT batch, max(w.d) AS prior_day FROM k JOIN w ON w.event_type = k.event_type AND w.d < k.batch GROUP BY batch)
 SELECT o.id, pd.prior_day, w.v AS prior_day_value, o.basis - w.v AS strict_change FROM o LEFT JOIN pd ON pd.batch = o.d LEFT JOIN w ON w.event_type = o.event_type AND w.d = pd.prior_day"""
)
def strict_prior_weekday_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = observations(spark, sf_dir).withColumn("batch", F.to_date("ts"))
    return history.strict_change(df, "batch", "event_type", "ts", "id", "basis").select("id", "prior_day", "prior_day_value", "strict_change")


_CARRY = f"""WITH o AS ({OBS}), d AS (SELECT *, basis - lag(basis) OVER (PARTITION BY key ORDER BY ts, id) AS moved FROM o),
 m AS (SELECT *, last_value(CASE WHEN moved IS NULL OR moved <> 0 THEN ts END IGNORE NULLS) OVER w AS mark_at, last_value(CASE WHEN moved IS NULL OR moved <> 0 THEN coalesce(moved, -1e18) END IGNORE NULLS) OVER w AS by_
 FROM d WINDOW w AS (PARTITION BY key ORDER BY ts, id ROWS UNBOUNDED PRECEDING))
 SELECT id, CASE WHEN by_ > -1e17 AND ts - mark_at <= INTERVAL 24 HOURS THEN by_ ELSE 0.0 END AS change, CASE WHEN by_ > -1e17 AND ts - mark_at <= INTERVAL 24 HOURS THEN mark_at END AS changed_at FROM m"""


@query(_CARRY)
def basis_carry_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.carried_change(observations(spark, sf_dir), "key", "ts", "id", "basis").select("id", "change", "changed_at")


# ---------------------------------------------------------------- canonical selection


def _markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bids(spark, sf_dir)
    df = b.groupBy("location", "commodity", "company").agg(F.count(F.lit(1)).alias("n"), F.max("captured_at").alias("captured_at"))
    return df.withColumns({"quality": F.least(F.col("n"), F.lit(6)) / F.lit(6.0), "valid": F.lit(True), "aggregator": F.col("company").endswith("7"), "priority": F.when(F.col("company").endswith("3"), 1)})


_MARKETS = f"""SELECT location, commodity, company, count(*) AS n, max(captured_at) AS captured_at, least(count(*), 6) / 6.0 AS quality, company LIKE '%7' AS aggregator, CASE WHEN company LIKE '%3' THEN 1 END AS priority FROM ({BIDS}) GROUP BY location, commodity, company"""
_RANKED = f"""m AS ({_MARKETS}), f AS (SELECT *, quality >= 0.8 AS pass, max(CASE WHEN NOT aggregator THEN quality END) OVER g AS best FROM m WINDOW g AS (PARTITION BY location, commodity)),
 h AS (SELECT *, aggregator AND coalesce(best - quality >= 0.15 - 1e-9, false) AS behind, max(CAST(pass AS INT)) OVER (PARTITION BY location, commodity) = 1 AS any_ FROM f),
 r AS (SELECT *, row_number() OVER w AS k, lead(quality) OVER w AS q2, lead(captured_at) OVER w AS t2, count(*) OVER (PARTITION BY location, commodity) AS c, max(CAST(behind AS INT)) OVER (PARTITION BY location, commodity) = 1 AS kept
 FROM h WINDOW w AS (PARTITION BY location, commodity ORDER BY coalesce(priority, 100000), behind, CASE WHEN pass THEN 0 WHEN any_ THEN 1 ELSE 0 END, quality DESC, captured_at DESC, lower(company)))"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.ranked(_markets(spark, sf_dir), ["location", "commodity"], quality="quality", valid="valid", aggregator="aggregator", priority="priority", captured_at="captured_at", source="company", tie="company")


@query(f"WITH {_RANKED} SELECT location, commodity, company, CAST(k AS INT) AS canonical_rank, k = 1 AS is_canonical FROM r")
def canonical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("location", "commodity", "company", "canonical_rank", "is_canonical")


@query(
    f"""WITH {_RANKED} SELECT location, commodity, company, CASE WHEN priority IS NOT NULL THEN 'priority:' || lower(company) WHEN NOT behind AND kept THEN 'source_preference_non_aggregator' WHEN c = 1 THEN 'single_candidate'
 WHEN quality > q2 THEN 'completeness' WHEN captured_at > t2 THEN 'recency' ELSE 'tie_breaker:' || company END AS canonical_reason FROM r WHERE k = 1"""
)
def canonical_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).where("is_canonical").select("location", "commodity", "company", "canonical_reason")


@query(
    """WITH m AS (SELECT l_partkey, l_suppkey, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS c FROM lineitem GROUP BY ALL HAVING count(*) > 1),
 s AS (SELECT l_suppkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_partkey)[1:3] AS samples FROM m GROUP BY ALL)
 SELECT m.l_suppkey, count(*) AS duplicate_market_keys, CAST(sum(n) AS BIGINT) AS candidate_rows, CAST(sum(n) - count(*) AS BIGINT) AS alternate_rows, CAST(sum(c) AS BIGINT) AS canonical_rows, any_value(array_to_string(samples, ',')) AS samples
 FROM m JOIN s ON s.l_suppkey = m.l_suppkey GROUP BY m.l_suppkey"""
)
def duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("owner", F.col("l_suppkey")).withColumn("at", F.col("l_partkey"))
    out = canonical.duplicate_markets(df, ["l_partkey", "l_suppkey"], "owner", F.col("l_partkey").cast("string"), F.col("l_returnflag") == "N", ["at"])
    return out.select(F.col("owner").alias("l_suppkey"), "duplicate_market_keys", "candidate_rows", "alternate_rows", "canonical_rows", F.array_join("sample_markets", ",").alias("samples"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09)")
def semi_join_tuple_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return canonical.candidates_of(li, li.where("l_quantity = 50 and l_discount > 0.09"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT DISTINCT c_nationkey, c_mktsegment, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_mktsegment = 'MACHINERY' THEN 2 ELSE 1 END AS INT) AS policy_rank, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_mktsegment = 'MACHINERY' THEN 2 ELSE 1 END, c_mktsegment) AS INT) AS priority_rank FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)")
def seeded_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.seeded_priority(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", F.lit("BUILDING"), F.col("c_mktsegment") == "MACHINERY")


# ---------------------------------------------------------------- alerts

_RULES = [(1, "basis", ">", 9.0, None), (2, "basis", "<=", 1.0, "click"), (3, "cash_price_bu", ">=", 99.0, None), (4, "basis", "=", 5.0, "purch"), (5, "basis", "!=", 5.0, None), (6, "unknown", ">", 0.0, None)]
_RULES_SQL = "(VALUES (1, 'basis', '>', 9.0, NULL), (2, 'basis', '<=', 1.0, 'click'), (3, 'cash_price_bu', '>=', 99.0, NULL), (4, 'basis', '=', 5.0, 'purch')) r(rule_id, kind, op, threshold, place)"
_HITS = f"""SELECT r.rule_id, o.id, CASE r.kind WHEN 'basis' THEN o.basis ELSE o.value END AS value FROM ({OBS}) o, {_RULES_SQL} WHERE (r.place IS NULL OR contains(lower(o.event_type), r.place))
 AND CASE r.op WHEN '>' THEN CASE r.kind WHEN 'basis' THEN o.basis ELSE o.value END > r.threshold WHEN '<=' THEN o.basis <= r.threshold WHEN '>=' THEN o.value >= r.threshold ELSE o.basis = r.threshold END"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "rule_id int, rule_type string, comparison_operator string, threshold double, place string")
    rows = observations(spark, sf_dir).select("id", "event_type", "basis", F.col("value").alias("cash_price_bu"))
    return alerts.triggered(rows, rules, alerts.holds(F.col("event_type"), F.col("place")))


@query(_HITS)
def alert_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("rule_id", "id", "value")


@query(f"WITH h AS (SELECT DISTINCT rule_id, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS message FROM ({_HITS})) SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h a WHERE a.rule_id = h.rule_id AND a.message = h.message AND length(a.message) = 1 AND a.rule_id = 2)")
def alert_anti_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _hits(spark, sf_dir).select("rule_id", F.floor("value").cast("string").alias("message")).distinct()
    stored = found.where((F.length("message") == 1) & (F.col("rule_id") == 2)).withColumn("status", F.lit("open"))
    return alerts.without_open(found, stored)


# ---------------------------------------------------------------- diagnostics

_REASONS = """SELECT event_id, event_type, list_filter([CASE WHEN user_id % 5 = 0 THEN 'missing_source_name' END, CASE WHEN event_id % 4 = 0 THEN 'missing_basis' END, CASE WHEN event_id % 6 = 0 THEN 'missing_cash_price_bu' END], lambda x: x IS NOT NULL) AS reasons FROM events"""


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"source_name": F.col("user_id") % 5 == 0, "basis": F.col("event_id") % 4 == 0, "cash_price_bu": F.col("event_id") % 6 == 0}
    return table(spark, sf_dir, "events").withColumn("reasons", diagnostics.missing(checks))


@query(f"SELECT event_type AS source, reason, CAST(GROUPING(event_type) AS INT) AS overall, count(*) AS n FROM (SELECT event_type, unnest(reasons) AS reason FROM ({_REASONS})) GROUP BY GROUPING SETS ((reason), (event_type, reason))")
def reject_reason_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.reason_counts(_reasons(spark, sf_dir), "reasons", "event_type")


@query(
    """WITH r AS (SELECT event_type, user_id, NOT (user_id % 5 = 0 OR event_id % 4 = 0 OR event_id % 6 = 0) AS ok FROM events)
 SELECT event_type, count(*) AS raw_rows, count(*) - count(*) FILTER (ok) AS rejected_rows, count(*) FILTER (ok) - count(DISTINCT CASE WHEN ok THEN user_id END) AS duplicate_keys, round(count(*) FILTER (ok) / count(*), 9) AS success_rate FROM r GROUP BY ALL"""
)
def logical_source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.file_quality(_reasons(spark, sf_dir), "event_type", "user_id", "reasons").withColumn("success_rate", F.round("success_rate", 9))


@query("SELECT o_custkey, max(o_orderdate) AS at, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY (count(*) >= 12) DESC, max(o_orderdate) DESC, o_custkey DESC LIMIT 1")
def having_latest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.latest_group(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", 12)


@query(
    f"""WITH c AS ({_CARRY}), r AS (SELECT c.*, o.ts, CASE WHEN o.id % 3 = 0 THEN NULL ELSE o.basis - 5 END AS strict FROM c JOIN ({OBS}) o ON o.id = c.id), f AS (SELECT *, coalesce(strict <> 0, false) AS s, coalesce(change <> 0, false) AS k FROM r)
 SELECT count(*) AS row_count, count(*) FILTER (s) AS strict_non_zero_count, count(*) FILTER (k) AS carried_non_zero_count, count(*) FILTER (k AND NOT s) AS carried_without_strict_count, count(*) FILTER (s AND NOT k) AS strict_without_carried_count,
 count(*) FILTER (s AND k AND strict <> change) AS strict_vs_carried_value_mismatch_count, count(*) FILTER (k AND epoch(TIMESTAMP '2024-06-01') - floor(epoch(changed_at)) > 86400) AS stale_non_zero_carried_count, count(changed_at) AS rows_with_basis_last_changed_at FROM f"""
)
def basis_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = history.carried_change(observations(spark, sf_dir), "key", "ts", "id", "basis")
    df = df.select("id", F.col("change").alias("basis_change"), F.col("changed_at").cast("timestamp").alias("basis_last_changed_at"), F.when(F.col("id") % 3 != 0, F.col("basis") - 5).alias("basis_change_strict"))
    return diagnostics.change_summary(diagnostics.change_flags(df, F.lit("2024-06-01 00:00:00").cast("timestamp")))


@query(
    """WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), f AS (SELECT l_partkey, count(*) AS company_count, CAST(sum(n) AS BIGINT) AS row_count FROM c GROUP BY ALL HAVING count(*) >= 20),
 s AS (SELECT l_partkey, l_shipmode, n, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_shipmode) AS r FROM (SELECT l_partkey, l_returnflag || l_linestatus AS l_shipmode, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM f) GROUP BY ALL))
 SELECT f.l_partkey, company_count, row_count, string_agg(l_shipmode, ',' ORDER BY r) AS top_sources FROM f JOIN s ON s.l_partkey = f.l_partkey WHERE r <= 2 GROUP BY ALL"""
)
def ambiguous_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("kind", F.concat("l_returnflag", "l_linestatus"))
    return identity.shared_places(df, "l_partkey", "l_suppkey", "kind", 20, 2).withColumn("top_sources", F.array_join("top_sources", ","))


@query("SELECT lower(split_part(p_name, ' ', 1)) AS canonical, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS variants FROM part GROUP BY 1 HAVING count(DISTINCT p_name) > 1")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.lower(F.split_part("p_name", F.lit(" "), F.lit(1)))
    return identity.spelling_variants(table(spark, sf_dir, "part"), "p_name", first).withColumn("variants", F.array_join("variants", ","))


# ---------------------------------------------------------------- pricing and reports


@query(
    f"""SELECT commodity, count(*) AS market_count, round(median(cash), 6) AS median_cash, round(CASE WHEN count(*) > 1 THEN max(cash) - min(cash) END, 6) AS cash_spread, round(avg(basis), 6) AS average_basis, max(captured_at) AS data_as_of FROM ({BIDS}) GROUP BY commodity"""
)
def report_section_median_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pricing.report_sections(bids(spark, sf_dir), "commodity", "cash", "basis", "captured_at")
    return out.withColumns({"median_cash": F.round("median_cash", 6), "cash_spread": F.round("cash_spread", 6), "average_basis": F.round("average_basis", 6)})


@query(
    f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY commodity) AS n, row_number() OVER (PARTITION BY commodity ORDER BY l_extendedprice, {_ORDER_SQL}) AS k FROM ({BIDS}) WHERE l_extendedprice IS NOT NULL),
 c AS (SELECT *, CASE WHEN n < 5 THEN 0 ELSE floor(n * 0.2) END AS cut FROM r), a AS (SELECT commodity, avg(l_extendedprice) AS anchor, max(n) AS competitors FROM c WHERE k > cut AND k <= n - cut GROUP BY commodity)
 SELECT commodity, round(anchor, 4) AS anchor, competitors, round(greatest(30000 - 5.0, least(anchor - 7.5, 30000 + 3.0)), 4) AS posted_mt FROM a"""
)
def trimmed_mean_posted_bid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir)
    last = df.select("commodity").distinct().withColumn("last_bid", F.lit(30000.0))
    out = pricing.posted_bids(df, ["commodity"], "l_extendedprice", list(BID_ORDER), last)
    return out.select("commodity", F.round("anchor", 4).alias("anchor"), "competitors", F.round("posted_mt", 4).alias("posted_mt"))


@query(
    """WITH r AS (SELECT o_orderpriority AS crop, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS m, month(o_orderdate) IN (10, 11, 12) AS h, o_orderstatus FROM orders),
 e AS (SELECT crop, min(m) AS old FROM r GROUP BY crop), n AS (SELECT r.crop, coalesce(max(CASE WHEN h THEN m END), max(m)) AS new FROM r JOIN e ON e.crop = r.crop WHERE m > old GROUP BY r.crop),
 b AS (SELECT crop, 'old' AS bucket, old AS m FROM e UNION ALL SELECT crop, 'new', new FROM n), c AS (SELECT b.crop, b.bucket, b.m, o_orderstatus, count(*) AS k FROM b JOIN r ON r.crop = b.crop AND r.m = b.m GROUP BY ALL)
 SELECT crop, bucket, m AS bucket_month, o_orderstatus AS delivery FROM c QUALIFY row_number() OVER (PARTITION BY crop, bucket ORDER BY k DESC, o_orderstatus) = 1"""
)
def crop_bucket_old_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    df = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("crop"), (F.year(d) * 12 + F.month(d)).alias("m"), d, "o_orderstatus")
    return pricing.crop_buckets(df, "crop", "m", F.month("o_orderdate").isin(10, 11, 12), "o_orderstatus", "o_orderstatus").select("crop", "bucket", "bucket_month", "delivery")


@query(
    """WITH r AS (SELECT o_orderpriority AS crop, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS m, o_totalprice FROM orders), f AS (SELECT crop, coalesce(min(CASE WHEN m >= 1996 * 12 + 3 THEN m END), min(m)) AS front_month FROM r GROUP BY crop)
 SELECT r.crop, front_month, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS upper_median_o_totalprice FROM r JOIN f ON f.crop = r.crop AND r.m = f.front_month GROUP BY ALL"""
)
def front_month_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    df = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("crop"), (F.year(d) * 12 + F.month(d)).alias("m"), "o_totalprice")
    return pricing.front_months(df, "crop", "m", "o_totalprice", 1996 * 12 + 3)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, location, cash, cash - 12.5 AS delivered_price FROM ({BIDS}) WHERE location ILIKE '%n_1%'")
def quote_delivered_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir).where(market.contains(F.col("location"), "n_1"))
    return market.delivered(df, "cash", 12.5).select("l_orderkey", "l_linenumber", "l_partkey", "location", "cash", "delivered_price")


# ---------------------------------------------------------------- health, schedules, identity


@query(
    """WITH r AS (SELECT user_id, event_id, ts, event_type <> 'error' AS ok FROM events), l AS (SELECT user_id, max(CASE WHEN ok THEN ts END) AS s FROM r GROUP BY ALL),
 f AS (SELECT r.user_id, count(*) FILTER (NOT ok AND (s IS NULL OR ts > s)) AS consecutive_failures, any_value(s) AS last_success_at FROM r JOIN l ON l.user_id = r.user_id GROUP BY ALL)
 SELECT user_id, consecutive_failures, last_success_at, round(greatest(0, 1 - least(0.6, consecutive_failures * 0.15)), 3) AS confidence FROM f"""
)
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = health.failures_now(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") != "error")
    return out.select("user_id", "consecutive_failures", "last_success_at", health.confidence(F.col("consecutive_failures"), F.lit(None).cast("long")).alias("confidence"))


@query(
    """WITH f AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS s, arg_max(event_type, (ts, event_id)) = 'error' AS failing FROM events GROUP BY user_id), m AS (SELECT max(ts) AS now FROM events)
 SELECT count(*) AS sources, count(*) FILTER (NOT (s IS NULL OR floor((floor(epoch(now)) - floor(epoch(s))) / 60) > 240)) AS fresh, count(*) FILTER (s IS NULL OR floor((floor(epoch(now)) - floor(epoch(s))) / 60) > 240) AS stale, count(*) FILTER (failing) AS failing FROM f, m"""
)
def service_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    s = health.failures_now(e, "user_id", "ts", "event_id", F.col("event_type") != "error").withColumn("polling_interval_minutes", F.lit(120))
    return health.service_levels(s, now)


@query(
    """WITH e AS (SELECT DISTINCT event_type AS source, date_trunc('day', ts) + INTERVAL 8 HOUR AS expected_at FROM events),
 r AS (SELECT event_type AS source, ts FROM events WHERE user_id % 3 = 0)
 SELECT e.source, e.expected_at, count(r.ts) AS runs_in_window, count(r.ts) = 0 AS missed FROM e LEFT JOIN r ON r.source = e.source AND r.ts >= e.expected_at AND r.ts <= e.expected_at + INTERVAL 45 MINUTE GROUP BY ALL"""
)
def schedule_window_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    expected = e.select(F.col("event_type").alias("source"), (F.to_date("ts").cast("timestamp_ntz") + F.expr("INTERVAL '8' HOUR")).alias("expected_at")).distinct()
    runs = e.select(F.col("event_type").alias("source"), F.when(F.col("user_id") % 3 == 0, "completed").otherwise("failed").alias("status"), F.col("ts").alias("started_at"))
    return health.missed_windows(runs, expected, 45)


@query("SELECT lower(n_name) AS canonical_key, n_name AS name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000) AND n_regionkey <> 1")
def dimension_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    facts = table(spark, sf_dir, "customer").where("c_acctbal > 5000").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    known = n.where("n_regionkey = 1").select(text.canonical_key(F.col("n_name")).alias("canonical_key"))
    return identity.missing_members(facts, known, "n_name")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN -1 END, n_regionkey) AS region_id FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def foreign_key_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.when(F.col("c_custkey") % 2 == 0, -1).alias("region_id"))
    dim = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region_id"))
    return identity.linked(facts, dim, "nation", "region_id").select("c_custkey", "region_id")


@query("WITH b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.095) SELECT l_suppkey, count(a.l_partkey) AS shared, count(*) AS total FROM b LEFT JOIN a ON a.l_partkey = b.l_partkey GROUP BY ALL")
def location_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return identity.overlaps(li.where("l_discount > 0.095"), li, "l_partkey", "l_suppkey")


# ---------------------------------------------------------------- pages


@query("""SELECT page_id, href, CAST(min(i) - 1 AS INT) AS position FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)href="([^"]*)"', 1) AS h FROM pages)) GROUP BY page_id, href""")
def html_link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.links(table(spark, sf_dir, "pages"))


@query(
    """WITH e AS (SELECT page_id, unnest(h) AS tag, generate_subscripts(h, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(<h[1-4][^>]*>[^<]*|<p[ >][^<]*)', 1) AS h FROM pages))
 SELECT page_id, CAST(i - 1 AS INT) AS position, last_value(CASE WHEN tag LIKE '<h%' THEN regexp_extract(tag, '>([^<]*)$', 1) END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS heading FROM e"""
)
def html_fill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.regexp_extract_all("html", F.lit(r"(<h[1-4][^>]*>[^<]*|<p[ >][^<]*)"), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("position", "tag"))
    rows = rows.withColumn("heading", F.when(F.col("tag").startswith("<h"), F.regexp_extract("tag", ">([^<]*)$", 1)))
    return reshape.filled_down(rows, ["page_id"], "position", "heading").select("page_id", "position", "heading")


@query("SELECT event_type, round(avg(value), 6) AS mean_value, count(*) AS n, max(ts) AS latest_at FROM events GROUP BY ALL")
def observation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest_at"))


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice, CAST(n AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3"""
)
def report_top_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = pricing.top_bids(table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return top.select("o_custkey", "o_orderkey", "o_totalprice", "place")


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN -1.0 ELSE c_acctbal END AS balance FROM customer UNION ALL SELECT c_custkey + 10000000, NULL, 0.5 FROM customer WHERE c_custkey % 10 = 0")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    stored = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    updates = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit(-1.0).alias("balance")).unionByName(c.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 10_000_000).alias("id"), F.lit(0.5).alias("balance")))
    return reshape.merged(stored, updates, "id").select("id", "name", "balance")


@query("SELECT c_custkey AS id, c_acctbal FROM customer WHERE c_acctbal < 0 OR c_custkey % 100 = 0")
def changed_rows_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    stored = c.where("id % 100 <> 0").withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0)))
    return history.changed_only(stored, c, "id", ["c_acctbal"])


# ---------------------------------------------------------------- boards and listings


@query(
    r"""WITH l AS (SELECT c_custkey, ['LAC - Brinston Corn', 'Ingredion  Cardinal (plant)', 'Prescott Transfer', 'Toronto Wheat', 'north gower  elevator'][CAST(c_custkey % 5 AS INT) + 1] AS place FROM customer),
 k AS (SELECT c_custkey, lower(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(place, '\s+', ' ', 'g')), '(?i)^LAC\s*-\s*', '')), '(?i)^Ingredion\s+', '')), '\s+\([^)]*\)\s*$', '')), '(?i)\s+(corn|soybeans?|wheat|hrw new crop wheat|hrw old crop wheat)$', '')), '(?i)\s+(transfer|ethanol|elevator)$', ''))) AS key FROM l)
 SELECT c_custkey, key FROM k WHERE key IN ('brinston', 'cardinal', 'chesterville', 'dalkeith', 'embrun', 'johnstown', 'kars', 'lansdowne', 'north gower', 'prescott', 'vankleek hill', 'winchester')"""
)
def eastern_place_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.array(*map(F.lit, ("LAC - Brinston Corn", "Ingredion  Cardinal (plant)", "Prescott Transfer", "Toronto Wheat", "north gower  elevator")))
    c = table(spark, sf_dir, "customer").withColumn("place", F.get(places, (F.col("c_custkey") % 5).cast("int")))
    return c.where(text.in_eastern_ontario(F.col("place"))).select("c_custkey", text.eastern_key(F.col("place")).alias("key"))


_BOARD = f"""SELECT o_orderkey, o_orderpriority AS location, ['Corn', 'soybeans', 'SRW Wheat', 'HRW', 'Wheat', 'Oats', NULL][CAST(o_orderkey % 7 AS INT) + 1] AS crop, o_orderstatus AS company,
 CASE o_orderkey % 3 WHEN 0 THEN {_MONTH_NAMES}[month(o_orderdate)] || ' ' || year(o_orderdate) WHEN 1 THEN 'Harvest ' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') END AS delivery, o_orderdate FROM orders"""


@query(
    f"""WITH b AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) * 12 + month(o_orderdate) WHEN 1 THEN (2000 + year(o_orderdate) % 100) * 12 + 10 END AS k, CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 6 ELSE 99 END AS r FROM ({_BOARD}))
 SELECT o_orderkey, row_number() OVER (PARTITION BY location ORDER BY r, lower(coalesce(crop, '')), lower(coalesce(company, '')), k NULLS LAST, o_orderkey) AS place FROM b"""
)
def board_display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, kind = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    crops = F.array(*map(F.lit, ("Corn", "soybeans", "SRW Wheat", "HRW", "Wheat", "Oats", None)))
    year = F.year("o_orderdate")
    delivery = F.when(kind == 0, F.concat_ws(" ", periods.month_name(F.month("o_orderdate")), year.cast("string"))).when(kind == 1, F.concat_ws(" ", F.lit("Harvest"), F.lpad((year % 100).cast("string"), 2, "0")))
    o = o.select("o_orderkey", F.col("o_orderpriority").alias("location"), F.get(crops, (F.col("o_orderkey") % 7).cast("int")).alias("crop"), F.col("o_orderstatus").alias("company"), delivery.alias("delivery"))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    leading = {"rank": market.crop_rank(F.col("crop")), "crop": low("crop"), "company": low("company"), "delivery": F.col("delivery_key")}
    o = by_distinct(o, ["delivery"], delivery_key=periods.display_key(F.col("delivery")))
    return market.placed(o, ["location"], leading, [F.col("o_orderkey")]).select("o_orderkey", "place")


@query(
    """WITH c AS (SELECT o_custkey AS company, o_orderpriority AS source, count(*) AS row_count, count(*) FILTER (o_orderstatus = 'F') / count(*) AS winner_rate FROM orders GROUP BY ALL)
 SELECT company, source, row_number() OVER (PARTITION BY company ORDER BY CASE WHEN source LIKE '5%' THEN 2 ELSE 1 END, winner_rate DESC, row_count DESC, source) AS place FROM c"""
)
def candidate_proposal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("source"))
    c = o.agg(F.count(F.lit(1)).alias("row_count"), (F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("winner_rate"))
    c = c.withColumn("policy_rank", F.when(F.col("source").startswith("5"), 2).otherwise(1))
    return c.select("company", "source", F.row_number().over(W.partitionBy("company").orderBy(*canonical.candidate_order(by_rate=True))).cast("long").alias("place"))


@query(
    """WITH r AS (SELECT event_id AS id, event_type AS name, user_id % 40 AS shard, ts, CASE WHEN user_id % 3 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events), s AS (SELECT name || '-' || shard AS name, max(ts) FILTER (status = 'completed') AS ok, count(*) FILTER (status = 'completed') AS done FROM r GROUP BY ALL),
 t AS (SELECT name || '-' || shard AS name, status FROM (SELECT * FROM r ORDER BY ts DESC, id DESC LIMIT 2000) QUALIFY row_number() OVER (PARTITION BY name || '-' || shard ORDER BY ts DESC, id DESC) = 1), m AS (SELECT max(ts) AS now FROM events)
 SELECT s.name, t.status AS latest_run_status, done AS successful_run_count, CAST(floor((floor(epoch(now)) - floor(epoch(ok))) / 60) AS BIGINT) AS stale_age_minutes, ok IS NULL OR floor((floor(epoch(now)) - floor(epoch(ok))) / 60) > 240 AS is_stale,
 CASE WHEN done >= 3 THEN 'promoted' ELSE 'pilot' END AS promotion_status FROM s LEFT JOIN t ON t.name = s.name CROSS JOIN m"""
)
def sources_with_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    name = F.concat_ws("-", "event_type", (F.col("user_id") % 40).cast("string"))
    nothing = F.lit(None).cast("double")
    runs = e.select(F.col("event_id").alias("id"), name.alias("source_name"), F.col("ts").alias("started_at"), F.when(F.col("user_id") % 3 == 0, "failed").otherwise("completed").alias("status"), nothing.alias("parse_success_rate"), nothing.alias("rejected_row_count"))
    ok = F.max(F.when(F.col("status") == "completed", F.col("started_at")))
    s = runs.groupBy(F.col("source_name").alias("name")).agg(ok.alias("last_success_at"))
    s = s.select("name", "last_success_at", F.lit(120).alias("polling_interval_minutes"), F.lit("automated").alias("source_type"), F.lit("k").alias("adapter_key"), F.lit(True).alias("is_active"))
    return health.with_health(s, runs, now, ["k"]).select("name", "latest_run_status", "successful_run_count", "stale_age_minutes", "is_stale", "promotion_status")
