"""Queries over stored tables (updated file by file, searched by label, kept as day states, exported) and over bid pages that
Spark writes from the orders. Their oracles read the given tables alone."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.functions import periods
from basisline.operators import facet_states
from basisline.operators.label_index import LabelIndex
from basisline.operators.sizes import dealt_by
from basisline.plans.queries import query, table
from basisline.sources import filetable, office
from basisline.sources import pages as web
from basisline.sources.workbooks import write_workbooks
from basisline.storage import shared_dir, stored
from basisline.streaming.ledger import Ledger


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """WITH m AS (SELECT max(o_orderkey) // 4 AS k FROM orders), changed AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders, m WHERE o_orderkey <= k AND o_orderkey % 97 = 0)
 SELECT o.o_orderkey, o_custkey, coalesce(c.o_orderstatus, o.o_orderstatus) AS o_orderstatus, round(coalesce(c.o_totalprice, o.o_totalprice), 2) AS o_totalprice FROM orders o LEFT JOIN changed c ON c.o_orderkey = o.o_orderkey
 UNION ALL SELECT -o_orderkey - 1, NULL, 'X', round(o_totalprice, 2) FROM orders WHERE o_orderkey % 211 = 0"""
)
def rewritten_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored orders after an update of some keys and new ones: only files with changed keys are rewritten."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    t = filetable.FileTable(spark, _folder(spark, "orders"), "o_orderkey")
    t.create(o, 8)
    quarter = o.agg(F.max("o_orderkey")).first()[0] // 4
    changed = o.where((F.col("o_orderkey") <= quarter) & (F.col("o_orderkey") % 97 == 0)).select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.round(F.col("o_totalprice") + 1, 2).alias("o_totalprice"))
    new = o.where("o_orderkey % 211 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), "o_totalprice")
    t.update(changed.unionByName(new))
    return t.read()


@query("SELECT p_partkey, p_type, 'eel' AS wanted FROM part WHERE p_type ILIKE '%eel%' UNION ALL SELECT p_partkey, p_type, 'd' FROM part WHERE p_type ILIKE '%d%'")
def label_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose type holds a text, found by way of the distinct types."""
    path = _folder(spark, "parts")
    filetable.write_skippable(table(spark, sf_dir, "part").select("p_partkey", "p_type"), path, "p_type")
    history = spark.read.parquet(path)
    index = LabelIndex.of(history, "p_type")
    return index.search(history, "EEL").withColumn("wanted", F.lit("eel")).unionByName(index.search(history, "d").withColumn("wanted", F.lit("d")))


@query("SELECT event_id, user_id || '|' || event_type AS composite_key, value FROM events WHERE user_id % 50 = 0 OR user_id = (SELECT min(user_id) FROM events)")
def keyed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of some keys out of a table that lies sorted by key, with Bloom filters."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("composite_key"), "value", "user_id")
    path = _folder(spark, "history")
    filetable.write_skippable(e.drop("user_id"), path, "composite_key")
    least = e.agg(F.min("user_id")).first()[0]
    keys = e.where((F.col("user_id") % 50 == 0) | (F.col("user_id") == least)).select("composite_key")
    return filetable.with_keys(spark.read.parquet(path), keys, "composite_key")


_FACETS = "FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) * 12 + month(l_shipdate) BETWEEN 1995 * 12 + 3 AND 1996 * 12 + 9"


@query(
    f"""SELECT 'type' AS facet, p_type AS name, count(DISTINCT l_suppkey) AS market_count {_FACETS} GROUP BY p_type UNION ALL SELECT 'kind', upper(p_type[1]) || lower(split_part(p_type, ' ', 1)[2:]), count(DISTINCT l_suppkey) {_FACETS} GROUP BY ALL"""
)
def facets_from_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct suppliers by type over a range of months, read from month states; and types collapsed to one spelling."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = j.select((F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("day"), F.col("p_type").alias("label"), F.col("l_suppkey").alias("key"))
    states = stored(facet_states.day_states(rows, facet_states.numbered(rows)), "month-states")
    between = (1995 * 12 + 3, 1996 * 12 + 9)
    kind = F.initcap(F.substring_index("label", " ", 1))
    return facet_states.facet(states, *between).withColumn("facet", F.lit("type")).unionByName(facet_states.facet(states, *between, kind).withColumn("facet", F.lit("kind")))


@query("SELECT regexp_replace(initcap_, ' .*', '') AS name, count(DISTINCT p_type) AS variants FROM (SELECT p_type, upper(p_type[1]) || lower(p_type[2:]) AS initcap_ FROM part) GROUP BY ALL")
def collapsed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw labels collapsed to their canonical spelling, with how many there are."""
    return facet_states.canonical_facet(table(spark, sf_dir, "part"), F.initcap(F.substring_index("p_type", " ", 1)), "p_type")


@query(
    """WITH a AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0) SELECT id AS subscriber_id, CAST(CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS INT) AS attempt, CASE WHEN id % 7 = 0 THEN CASE WHEN id % 2 = 0 THEN 'sent' ELSE 'reserved' END WHEN id % 3 = 0 THEN 'reserved' ELSE 'sent' END AS phase FROM a"""
)
def delivery_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issue's ledger after a run that confirmed a part, and a second one that sent failed deliveries again."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subscriber_id"), (F.col("c_custkey") % 5 != 0).alias("is_active"))
    ledger, k = Ledger(spark, _folder(spark, "ledger"), "2024-05-01"), F.col("subscriber_id")
    first = ledger.reserve(people)
    ledger.confirm(first.where((k % 7 == 0) | (k % 3 != 0)).select("subscriber_id", "attempt", (k % 7 != 0).alias("sent")))  # the others' outcome got lost
    again = ledger.reserve(people, retry_failed=True)
    ledger.confirm(again.where("attempt = 1 and subscriber_id % 2 = 0").select("subscriber_id", "attempt", F.lit(True).alias("sent")))
    return ledger.state()


@query("SELECT o_orderpriority AS sheet, CAST(o_orderkey AS VARCHAR) AS o_orderkey, round(o_totalprice, 2) AS price FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 10 = 0")
def exported_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks of one sheet a priority, written by file and read back."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' or o_orderkey % 10 = 0")
    folder = _folder(spark, "exports")
    rows = o.select("o_orderstatus", "o_orderpriority", "o_orderkey", F.col("o_orderkey").alias("key"), F.round("o_totalprice", 2).alias("price"))
    write_workbooks(rows, folder, "o_orderstatus", "o_orderpriority", "o_orderkey").write.format("noop").mode("overwrite").save()
    back = office.read_workbooks(spark, f"{folder}/*.xlsx")
    return back.select("sheet", F.get("cells", F.lit(0)).alias("o_orderkey"), F.get("cells", F.lit(1)).cast("double").alias("price"))


# ---------------------------------------------------------------- bid pages

def _line(*cells: Column | str) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c if isinstance(c, Column) else F.lit(c), F.lit("</td>")) for c in cells], F.lit("</tr>"))


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as offers of a page: about 32 a page, each with a section, crop, periods and prices in text."""
    k = F.col("o_orderkey")
    o = dealt_by(table(spark, sf_dir, "orders").select(k, "o_orderdate", F.floor(k / 128).cast("long").alias("page_id")), "page_id")
    s = lambda x: x.cast("string")
    month, year = F.month("o_orderdate"), F.year("o_orderdate")
    code = F.substr(F.lit(periods.MONTH_CODES), month, F.lit(1))
    return o.select(
        "page_id", k.alias("k"), (k % 3).cast("int").alias("section"), F.when(k % 2 == 0, "Corn").otherwise("Soybeans").alias("crop"), F.concat(periods.month_name(month, True), F.lit("-"), F.lpad(s(year % 100), 2, "0")).alias("short"),
        F.concat(F.lit("Z"), F.when(k % 2 == 0, "C").otherwise("S"), code, F.lpad(s(year % 100), 2, "0")).alias("symbol"), F.concat(s(400 + k % 100), F.lit("-"), s(k % 8)).alias("futures"), F.concat(F.lit("-0."), F.lpad(s(k % 90 + 10), 2, "0")).alias("basis"),
        F.concat(s(4 + k % 5), F.lit("."), F.lpad(s(k % 100), 2, "0")).alias("cash"), code.alias("code"), month.alias("month"), year.alias("year"),
    )


def _joined(line: Column, on: Column | None = None) -> Column:
    """The lines of a page (a bounded number) in order."""
    item = F.struct(F.col("k"), line.alias("line"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(item if on is None else F.when(on, item))), lambda x: x.line), "")


_HEADER = "<tr>" + "".join(f"<td>{x}</td>" for x in ("Name", "Delivery", "Delivery End", "Futures Month", "Futures Price", "Change", "Basis", "Cash Price")) + "</tr>"
_MON = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']"
_LONG = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"
_OFFERS = f"""SELECT o_orderkey // 128 AS page_id, o_orderkey AS k, o_orderkey % 3 AS section, CASE WHEN o_orderkey % 2 = 0 THEN 'Corn' ELSE 'Soybeans' END AS crop, month(o_orderdate) AS m, year(o_orderdate) AS y, {_MON}[month(o_orderdate)] AS mon,
 'Z' || CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'S' END || substr('FGHJKMNQUVXZ', month(o_orderdate), 1) || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') AS symbol, (400 + o_orderkey % 100) || '-' || (o_orderkey % 8) AS futures, '-0.' || lpad(CAST(o_orderkey % 90 + 10 AS VARCHAR), 2, '0') AS basis,
 (4 + o_orderkey % 5) || '.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS cash FROM orders"""
_TONNE = "round_even(CAST(cash AS DOUBLE) * CASE crop WHEN 'Corn' THEN 39.3683 ELSE 36.7437 END, 2)"


def _wire(df: DataFrame) -> DataFrame:
    """Wire columns under plain names; tonne prices as numbers."""
    names = {"Location": "location", "Name": "crop", "Delivery": "delivery", "Delivery End": "delivery_end", "Futures Month": "futures_month", "Futures Price": "futures", "Basis": "basis", "Bushel Cash Price": "cash"}
    return df.select("page_id", *[F.col(f"`{a}`").alias(b) for a, b in names.items()], F.round(F.col("MT Cash Price").cast("double"), 2).alias("tonne"))


@query(
    f"""WITH o AS ({_OFFERS}), p AS (SELECT *, page_id % 4 <> 0 AS titled, mon || ' ' || (2000 + y % 100) AS delivery, {_LONG}[m] || ' ' || (2000 + y % 100) AS futures_month FROM o),
 r AS (SELECT *, CASE WHEN section = 2 THEN 'Terminal ' || page_id WHEN titled THEN 'Elevator ' || page_id WHEN section = 0 THEN 'Location_1' ELSE 'Location_2' END AS location FROM p)
 SELECT page_id, location, crop, delivery, NULL AS delivery_end, futures_month, futures, arg_min(basis, (section, k)) AS basis, arg_min(cash, (section, k)) AS cash, arg_min({_TONNE}, (section, k)) AS tonne FROM r GROUP BY page_id, location, crop, delivery, futures_month, futures"""
)
def titled_page_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of titled sections: a title table lasts over the tables behind it, a combined one names its own; a frame of the
    page repeats everything, and rows alike stay once."""
    line = _line(F.col("crop"), F.col("short"), "", F.col("short"), F.col("futures"), "1-0", F.col("basis"), F.col("cash"))
    page = _offers(spark, sf_dir).groupBy("page_id").agg(*[_joined(line, F.col("section") == i).alias(f"s{i}") for i in range(3)])
    board = lambda inner: F.concat(F.lit('<table class="x homepage_quoteboard">'), inner, F.lit("</table>"))
    title = lambda name: F.concat(F.lit('<tr><td colspan="8">'), F.lit(name), F.col("page_id").cast("string"), F.lit("</td></tr>"))
    noise = F.lit("<table><tr><td colspan=2>Cash basis of nobody</td></tr></table>")
    html = F.concat(noise, F.when(F.col("page_id") % 4 != 0, board(title("Elevator "))).otherwise(""), *[board(F.concat(F.lit(_HEADER), F.col(c))) for c in ("s0", "s1")], board(F.concat(title("Terminal "), F.lit(_HEADER), F.col("s2"))))
    framed = page.select("page_id", html.alias("html")).withColumn("frame", F.explode(F.array(F.lit(0), F.lit(1))))
    return _wire(web.titled_bids(framed, part="frame"))


_ROWS_OF = """SELECT page_id, {location} AS location, {crop} AS crop, {delivery} AS delivery, NULL AS delivery_end, {futures_month} AS futures_month, arg_min(futures, k) AS futures, arg_min(basis, k) AS basis, arg_min(cash, k) AS cash, arg_min(tonne, k) AS tonne
 FROM (SELECT *, {_tonne} AS tonne FROM ({_offers})) WHERE {where} GROUP BY ALL"""


def _rows_of(where: str = "true", **columns: str) -> str:
    return _ROWS_OF.format(_tonne=_TONNE, _offers=_OFFERS, where=where, **({"location": "NULL", "crop": "crop", "delivery": "mon || '-' || lpad(CAST(y % 100 AS VARCHAR), 2, '0')", "futures_month": "symbol"} | columns))


@query(_rows_of(location="'Place ' || section"))
def header_page_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one table under a full header, with a location column, among other tables."""
    head = _line("Location", "Name", "Delivery", "Delivery End", "Futures Month", "Futures Price", "Change", "Basis*", "Cash Price")
    line = _line(F.concat(F.lit("Place "), F.col("section").cast("string")), F.col("crop"), F.col("short"), "", F.col("symbol"), F.col("futures"), "1-0", F.col("basis"), F.col("cash"))
    page = _offers(spark, sf_dir).groupBy("page_id").agg(_joined(line).alias("rows"))
    html = F.concat(F.lit("<table><tr><th>Name</th><th>Phone</th></tr><tr><td>x</td><td>y</td></tr></table><table>"), head, F.col("rows"), F.lit("</table>"))
    return _wire(web.page_bids(page.select("page_id", html.alias("html")), "hensall"))


@query(_rows_of(location="'Yard ' || page_id", crop="'Corn'", where="crop = 'Corn'"))
def heading_page_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose heading names the crop and whose address names the place."""
    head = _line("Delivery", "Futures Month", "Futures Price", "Basis", "Cash Price")
    line = _line(F.col("short"), F.col("symbol"), F.col("futures"), F.col("basis"), F.col("cash"))
    page = _offers(spark, sf_dir).where("crop = 'Corn'").groupBy("page_id").agg(_joined(line).alias("rows"))
    html = F.concat(F.lit("<h3>Ontario corn today</h3><table>"), head, F.col("rows"), F.lit("</table>"))
    return _wire(web.page_bids(page.select("page_id", html.alias("html"), F.concat(F.lit("Yard "), F.col("page_id").cast("string")).alias("yard")), "wanstead", place="yard"))


@query(_rows_of())
def symbol_page_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a header of two rows, whose futures symbol names the crop."""
    head = F.lit("<tr><td>Delivery</td><td>Futures</td><td>Futures</td><td></td><td>Cash</td></tr><tr><td></td><td>Month</td><td>Price</td><td>Basis</td><td>Price</td></tr>")
    line = _line(F.col("short"), F.col("symbol"), F.col("futures"), F.col("basis"), F.col("cash"))
    page = _offers(spark, sf_dir).groupBy("page_id").agg(_joined(line).alias("rows"))
    return _wire(web.page_bids(page.select("page_id", F.concat(F.lit("<table>"), head, F.col("rows"), F.lit("</table>")).alias("html")), "glg"))


@query(
    f"""WITH o AS ({_OFFERS}), f AS (SELECT page_id, crop, mon, arg_min(symbol, k) AS symbol, arg_min(futures, k) AS futures, arg_min(basis, k) AS basis, arg_min(cash, k) AS cash FROM o GROUP BY ALL)
 SELECT page_id, NULL AS location, crop, mon AS delivery, NULL AS delivery_end, symbol AS futures_month, futures, basis, cash, {_TONNE} AS tonne FROM f"""
)
def transposed_page_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a table a crop, one row a metric and one column a month."""
    least = lambda c: F.min_by(c, "k").alias(c)
    months = _offers(spark, sf_dir).groupBy("page_id", "crop", "month").agg(F.min(F.substr("short", F.lit(1), F.lit(3))).alias("mon"), *[least(c) for c in ("symbol", "futures", "basis", "cash")])
    cells = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("month", c))), lambda x: F.concat(F.lit("<td>"), x[c], F.lit("</td>"))), "")
    row = lambda name, c: F.concat(F.lit(f"<tr><td>{name}</td>"), cells(c), F.lit("</tr>"))
    one = months.groupBy("page_id", "crop").agg(F.concat(row("", "mon"), row("Futures Month", "symbol"), row("Futures", "futures"), row("Basis", "basis"), row("Cash Price", "cash")).alias("rows"))
    page = one.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("crop", "rows"))), lambda x: F.concat(F.lit("<table><caption>"), x.crop, F.lit("</caption>"), x.rows, F.lit("</table>"))), "").alias("html"))
    return _wire(web.page_bids(page, "snobelen"))


@query(
    f"""WITH o AS ({_OFFERS}) SELECT page_id, 'Site ' || section AS location, crop AS name, CAST(basis AS DOUBLE) AS basis, make_date(2000 + CAST(y % 100 AS INT), CAST(m AS INT), 1) AS delivery_start, symbol, round_even((400 + k % 100 + (k % 8) / 8.0) / 100, 6) AS futures_price FROM o"""
)
def script_call_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that write their bids by script calls under headings, joined with their quotes."""
    o = _offers(spark, sf_dir).withColumn("sym", F.concat(F.lit("S"), F.col("k").cast("string")))
    day = F.concat(F.lpad(F.col("month").cast("string"), 2, "0"), F.lit("/01/"), (2000 + F.col("year") % 100).cast("string"))
    cents = F.format_string("%.0f", F.col("basis").cast("double") * 100)
    call = F.concat(F.lit("writeBidRow('"), F.col("crop"), F.lit("',"), cents, F.lit(",true,false,true,0,'"), day, F.lit("','"), day, F.lit("','a','b','c',1,'d','e',quotes['"), F.col("sym"), F.lit("']);"))
    section = o.groupBy("page_id", "section").agg(_joined(call).alias("calls"))
    page = section.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "calls"))), lambda x: F.concat(F.lit("<h4 class=x>Site "), x.section.cast("string"), F.lit("</h4><script>"), x.calls, F.lit("</script>"))), "").alias("html"))
    script = o.groupBy("page_id").agg(_joined(F.concat(F.lit("'"), F.col("sym"), F.lit("': {name: '"), F.col("symbol"), F.lit("', month: 'May 26', last: '"), F.col("futures"), F.lit("'},"))).alias("script"))
    quotes = script.select(F.explode(web.quotes(F.col("script"))).alias("q")).select("q.*")
    found = web.call_bids(page, quotes.select("symbol", "month", "last")).join(quotes.select("symbol", F.col("name").alias("code")), "symbol")
    return found.select("page_id", "location", "name", "basis", "delivery_start", F.col("code").alias("symbol"), F.bround("futures_price", 6).alias("futures_price"))


@query(f"WITH o AS ({_OFFERS}) SELECT page_id, CAST(k AS VARCHAR) AS value, 'Place ' || k AS label FROM o")
def page_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places that pages' selects offer; crop choices leave."""
    tag = F.concat(F.lit("<option value='"), F.col("k").cast("string"), F.lit("'>Place "), F.col("k").cast("string"), F.lit("</option><option>"), F.col("crop"), F.lit("</option>"))
    page = _offers(spark, sf_dir).groupBy("page_id").agg(F.concat(F.lit("<select>"), _joined(tag), F.lit("</select>")).alias("html"))
    return web.options(page).select("page_id", "value", "label")
