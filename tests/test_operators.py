"""Operators, ingestion, pages and streaming on small tables with known results."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from basisline.operators import alerts, canonical, diagnostics, health, history, identity, market, pricing, reshape
from basisline.plans import ingest
from basisline.sources import pages, readers, sinks
from basisline.streaming import incremental

NOW = dt.datetime(2026, 6, 10, 15)


def ago(hours):
    return NOW - dt.timedelta(hours=hours)


def rank(spark, rows):
    df = spark.createDataFrame([("m", *r) for r in rows], "m string, id int, source string, quality double, aggregator boolean, priority int, at timestamp").withColumn("valid", F.lit(True))
    out = canonical.ranked(df, ["m"], quality="quality", valid="valid", aggregator="aggregator", priority="priority", captured_at="at", source="source", tie="id")
    return {r.source: (r.canonical_rank, r.canonical_reason) for r in out.collect()}


def test_canonical_ranking(spark):
    assert rank(spark, [(1, "Great Lakes Grain", 1.0, False, 1, NOW), (2, "Agricharts", 1.0, True, 2, NOW)])["Great Lakes Grain"] == (1, "priority:great lakes grain")
    assert rank(spark, [(1, "Great Lakes Grain", 4 / 6, False, None, NOW), (2, "Agricharts", 1.0, True, None, NOW)])["Agricharts"] == (1, "completeness")
    assert rank(spark, [(1, "Great Lakes Grain", 1.0, False, None, ago(2)), (2, "Agricharts", 1.0, True, None, NOW)])["Agricharts"] == (1, "recency")
    assert rank(spark, [(1, "Snobelen Farms", 1.0, False, None, NOW), (2, "Agricharts", 1.0, True, None, NOW)]) == {"Agricharts": (1, "tie_breaker:Agricharts"), "Snobelen Farms": (2, "alternate:tie_breaker:Agricharts")}
    assert rank(spark, [(1, "Agricharts", 0.5, True, None, NOW), (2, "GLG", 1.0, False, None, NOW)])["GLG"] == (1, "source_preference_non_aggregator")
    assert rank(spark, [(1, "GLG", 1.0, False, None, NOW)])["GLG"] == (1, "single_candidate")


def test_carry_policy(spark):
    rows = [(1, ago(40), 2.07), (2, ago(20), 2.30), (3, ago(10), 2.30), (4, ago(0), 2.30), (5, ago(-10), 2.30), (6, ago(-11), None), (7, ago(-12), 2.3)]
    out = history.carried_change(spark.createDataFrame([("k", *r) for r in rows], "k string, id int, at timestamp, b double"), "k", "at", "id", "b").orderBy("id").collect()
    assert [round(r.change, 2) for r in out] == [0.0, 0.23, 0.23, 0.23, 0.0, 0.0, 0.0] and out[3].changed_at == ago(20) and out[4].changed_at is None


def test_previous_file(spark):
    today = spark.createDataFrame([("a", 140.0), ("b", 1.0)], "key string, basis double")
    before = spark.createDataFrame([("a", 100.0, 1), ("a", 120.0, 2)], "key string, basis double, pos int")
    assert {r.key: r.basis_change for r in history.previous_file(today, before, "key", "basis", "pos").collect()} == {"a": 20.0, "b": None}


def test_alert_rules(spark):
    ops = [(">", 1.0, True), (">=", 1.5, True), ("=", 1.5, True), ("<", 2.0, True), ("<=", 1.5, True), ("!=", 1.5, False)]
    df = spark.createDataFrame([(o, t) for o, t, _ in ops], "o string, t double")
    assert [r[0] for r in df.select(alerts.compare(F.lit(1.5), F.col("o"), F.col("t"))).collect()] == [x for _, _, x in ops]
    text = spark.createDataFrame([("Cardinal Corn", None), ("Cardinal Corn", ""), ("Cardinal Corn", "cardinal"), (None, "brinston")], "v string, n string")
    assert [r[0] for r in text.select(alerts.holds(F.col("v"), F.col("n"))).collect()] == [True, True, True, False]
    months = spark.createDataFrame([(["jul 2026"],), (["may 26"],), (["dec 2027"],), ([],), (None,)], "m array<string>")
    assert [r[0] for r in months.select(alerts.in_months(F.col("m"), F.lit("May 26 Elev"), F.lit("Jul 2026"))).collect()] == [True, True, False, True, True]
    rows = spark.createDataFrame([(1, 1.5, float("nan")), (2, 0.5, None)], "id int, basis double, basis_change double")
    rules = spark.createDataFrame([(1, "basis", ">", 1.0), (2, "basis_change", ">", 0.0), (3, "delivered_value", ">", 0.0)], "rule_id int, rule_type string, comparison_operator string, threshold double")
    for few in (100, 0):
        assert [(r.rule_id, r.id) for r in alerts.triggered(rows, rules, few=few).collect()] == [(1, 1)]


def test_alert_activity_and_status(spark):
    rules = spark.createDataFrame([(1,), (2,)], "rule_id int")
    stored = spark.createDataFrame([(1, 1, "m", "open", NOW), (2, 1, "n", "resolved", ago(-1))], "alert_id int, rule_id int, message string, status string, triggered_at timestamp")
    assert {r.rule_id: (r.open_alerts, r.last_triggered_at) for r in alerts.rule_activity(rules, stored).collect()} == {1: (1, ago(-1)), 2: (0, None)}
    changes = spark.createDataFrame([(1, "acknowledged", NOW), (1, "nonsense", ago(-5))], "alert_id int, status string, at timestamp")
    assert {r.alert_id: r.status for r in alerts.with_status(stored, changes).collect()} == {1: "acknowledged", 2: "resolved"}


def test_saved_filter(spark):
    rows = spark.createDataFrame([("Brinston Corn", "Corn", "Agricharts", "c1", None), ("Hensall", "Corn", "Agricharts", "c1", None)], "location string, commodity_name string, source_name string, company_id string, location_id string")
    rows = rows.withColumn("f", F.create_map(*[F.lit(x) for x in ("location", "brinston", "commodity_name", "corn", "company_id", "c1")]))
    assert [r[0] for r in rows.select(alerts.saved_filter(F.col("f"), rows)).collect()] == [True, False]


def test_basis_diagnostics(spark):
    rows = [(1, 0.0, 0.10, ago(4)), (2, -0.05, 0.0, None), (3, 0.04, 0.02, None), (4, 0.0, 0.03, ago(30))]
    df = spark.createDataFrame(rows, "id int, basis_change_strict double, basis_change double, basis_last_changed_at timestamp").withColumns({"location": F.lit("A"), "commodity_name": F.lit("Corn")})
    flagged = diagnostics.change_flags(df, F.lit(NOW))
    assert list(diagnostics.change_summary(flagged).first())[1:] == [2, 3, 2, 1, 1, 1, 2]
    assert diagnostics.change_samples(flagged, 10).first().id == 4


def test_duplicate_markets(spark):
    rows = [("A", "m1", 1, True), ("A", "m1", 2, False), ("A", "m2", 3, False), ("A", "m2", 4, False), ("B", "m3", 5, True)]
    df = spark.createDataFrame(rows, "owner string, m string, id int, c boolean")
    out = canonical.duplicate_markets(df, ["m"], "owner", F.col("m"), F.col("c"), ["id"]).collect()
    assert [tuple(r) for r in out] == [("A", 2, 4, 2, 1, ["m1", "m2"])]


def test_priorities(spark):
    stored = spark.createDataFrame([("c", "a", 1, True), ("c", "b", 2, True), ("d", "a", 1, True)], "company string, source string, priority_rank int, is_active boolean")
    wanted = spark.createDataFrame([("c", ["b", "x", "b"])], "company string, sources array<string>")
    out = {(r.company, r.source): (r.priority_rank, r.is_active) for r in canonical.replaced_priority(stored, wanted).collect()}
    assert out == {("c", "b"): (1, True), ("c", "x"): (2, True), ("c", "a"): (1, False), ("d", "a"): (1, True)}


def test_identity(spark):
    rows = spark.createDataFrame([("x", "Agricharts", "Agricharts"), ("x", "GLG", "Agricharts"), ("y", "GLG", "GLG"), ("y", "Hensall", "GLG")], "l string, c string, now string")
    out = {r.l: (r.company, r.ambiguous) for r in identity.inferred_owner(rows, "l", "c", "now").collect()}
    assert out == {"x": ("Great Lakes Grain", False), "y": ("Great Lakes Grain", True)}
    known = spark.createDataFrame([(1, 3, None), (1, 2, "b"), (1, 1, None)], "k int, o int, v string")
    assert identity.first_known(known, "k", ["o"], "v").first().v == "b"
    seeds = spark.createDataFrame([("Toledo", "glg", "Yes"), ("A", "lac", "yes?"), ("B", "x", "multiple")], "location string, company string, status string")
    assert {(r.location, r.company, r.tentative) for r in identity.seed_rows(seeds).collect()} == {("Toledo Elevator", "Great Lakes Grain", False), ("A", "London Agricultural Commodities", True)}


def test_health(spark):
    one = spark.range(1)
    assert list(one.select(health.confidence(F.lit(2), F.lit(70_000)), health.confidence(F.lit(9), F.lit(1)), health.confidence(F.lit(None).cast("int"), F.lit(None).cast("int"))).first()) == [0.6, 0.4, 1.0]
    assert list(one.select(health.stale(F.lit(ago(1)), F.lit(20), F.lit(NOW)), health.stale(F.lit(ago(0.5)), F.lit(20), F.lit(NOW)), health.stale(F.lit(None).cast("timestamp"), F.lit(20), F.lit(NOW))).first()) == [True, False, True]
    sources = spark.createDataFrame([(1, True, "automated", "lac", None), (2, True, "file", "lac", None), (3, True, "automated", "lac", ago(-1)), (4, True, "automated", "zz", None)], "id int, is_active boolean, source_type string, adapter_key string, next_poll_at timestamp")
    assert [r.id for r in health.due(sources, F.lit(NOW), ["lac"]).collect()] == [1]


def test_pricing(spark):
    df = spark.createDataFrame([("corn", float(v), i) for i, v in enumerate([1, 10, 11, 12, 100])] + [("few", 1.0, 9), ("few", 3.0, 10)], "commodity string, p double, id int")
    assert {r.commodity: r.anchor for r in pricing.trimmed_means(df, ["commodity"], "p", ["id"], 0.2).collect()} == {"corn": 11.0, "few": 2.0}
    last = spark.createDataFrame([("corn", 20.0)], "commodity string, last_bid double")
    assert {r.commodity: r.posted_mt for r in pricing.posted_bids(df, ["commodity"], "p", ["id"], last).collect()} == {"corn": 15.0, "few": -5.5}
    assert df.groupBy("commodity").agg(pricing.upper_median("p")).where("commodity = 'few'").first()[1] == 3.0
    bids = spark.createDataFrame([("Corn", c, b, NOW) for c, b in ((5.15, 1.0), (5.45, None), (5.25, 1.2), (5.05, 1.1), (None, 9.0))], "crop string, cash double, basis double, at timestamp")
    r = pricing.report_sections(bids, "crop", "cash", "basis", "at").first()
    assert (r.market_count, round(r.median_cash, 2), round(r.cash_spread, 2), round(r.average_basis, 2)) == (4, 5.2, 0.4, 1.1)


def test_market_views(spark):
    rows = spark.createDataFrame([(3, "Jul 2026", 5.5, 0.8, "C"), (1, "May 2026", 6.2, 1.0, "A"), (2, "May 2026", 6.0, 0.9, "B")], "id int, delivery string, cash_price_bu double, basis double, location string")
    top = market.grouped_top(rows, F.col("delivery"), [F.col("cash_price_bu").desc(), F.col("basis").desc(), "location"], 1).orderBy("group_key").collect()
    assert [(r.label, r.row_count, r.id) for r in top] == [("May 2026", 2, 1), ("Jul 2026", 1, 3)]
    keyed = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("b", "1")], "n string, composite_key string")
    assert [tuple(r) for r in market.facet(keyed, F.col("n"), at_least=2).collect()] == [("a", 3)]
    assert {r.name for r in market.facet(keyed, F.col("n"), at_least=2, forced=["B"]).collect()} == {"a", "b"}


def test_visible_rows(spark):
    schema = "id int, commodity_name string, futures_month string, futures_price double, basis double, cash_price_bu double, cash_price_mt double, delivery_start string, delivery_end string, delivery_label string, is_canonical boolean"
    good = ("Corn", "July 2026", 1.0, 1.0, 1.0, 1.0, None, None, "June 2026", True)
    rows = [(1, *good), (2, *good[:-1], None), (3, "Mixed Daily File", *good[1:]), (4, "Corn", "May 2026", *good[2:]), (5, *good[:3], None, *good[4:]), (6, *good[:8], "May-26", True)]
    df = spark.createDataFrame(rows, schema)
    as_of = F.lit("2026-06-10").cast("date")
    assert [r.id for r in market.visible(df, as_of).collect()] == [1]
    assert [r.id for r in market.visible(df, as_of, include_non_canonical=True).collect()] == [1, 2]


def test_reshape(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, n string, v int")
    updates = spark.createDataFrame([(2, 5), (3, 6)], "id int, v int")
    assert sorted(tuple(r) for r in reshape.merged(stored, updates, "id").collect()) == [(1, "a", 1), (2, "b", 5), (3, None, 6)]
    subs = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "subscriber_id int, is_active boolean")
    ledger = spark.createDataFrame([(1, "w1", "sent"), (2, "w1", "failed"), (3, "w0", "sent")], "subscriber_id int, issue_key string, status string")
    assert {r[0] for r in reshape.undelivered(subs, ledger, "w1").collect()} == {3} and {r[0] for r in reshape.undelivered(subs, ledger, "w1", True).collect()} == {2, 3}


SHEET = [
    ("Blenheim Corn", "Corn", "July, 26", "ZCN26 @ 6.34", "140", "5.45", "1"),
    ("Blenheim", "corn", "July, 26", "ZCN26 @ 6.34", "150", "5.50", "2"),
    ("Thamesford", "Mixed Daily File", "July, 26", "ZCN26", "150", "5.50", "3"),
    ("Alliston", "Soybeans", "", "", "x", "12.00", "4"),
]


def test_ingestion(spark):
    sheet = spark.createDataFrame(SHEET, "`Location Name` string, Crop string, Month string, `Fut_Price` string, Basis string, `Cash Price` string, pos string").withColumn("pos", F.col("pos").cast("int")).withColumn("Source", F.lit("GLG"))
    rows = ingest.normalized(sheet, "pos").cache()
    by = {r.position: r for r in rows.collect()}
    assert by[1].location == "Blenheim" and float(by[1].basis) == 1.4 and float(by[1].cash_price_mt) == 214.56 and by[1].delivery_label == "June 2026" and by[1].source_name == "Great Lakes Grain"
    assert by[3].reasons == ["invalid_commodity_name"] and by[4].reasons == ["missing_delivery_window", "missing_futures_month", "missing_basis"]
    kept = ingest.accepted(rows).collect()
    assert [(r.position, r.repeats) for r in kept] == [(2, 1)]
    assert list(ingest.run_counters(rows).first()) == [4, 1, 2, 1, 4, 0.5]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes("Location,Basis\nCaf\xe9,1\n".encode("latin-1"))
    (tmp_path / "in" / "b.csv").write_bytes(b"\xef\xbb\xbfLocation,Basis\nX,2\n")
    cells = [r.cells for r in readers.read_uploads(spark, f"{tmp_path}/in").orderBy("path").collect()]
    assert cells == [{"Location": "Caf\xe9", "Basis": "1"}, {"Location": "X", "Basis": "2"}]
    assert {r.source_name for r in readers.read_sheets(spark, f"{tmp_path}/in").collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="cannot read"):
        readers.read_any(spark, "x.docx")
    df = spark.createDataFrame([("=1", NOW), ("b", ago(48))], "v string, captured_at timestamp")
    sinks.append_history(df, f"{tmp_path}/h")
    sinks.append_history(df, f"{tmp_path}/h")
    back = spark.read.parquet(f"{tmp_path}/h")
    assert back.count() == 4 and back.where("capture_date = '2026-06-10'").count() == 2
    sinks.export_csv(df, f"{tmp_path}/c")
    assert {r.v for r in spark.read.option("header", True).csv(f"{tmp_path}/c").collect()} == {"'=1", "b"}
    (tmp_path / "d").mkdir()
    for day in ("2026-06-08", "2026-06-09", "2026-06-10"):
        (tmp_path / "d" / f"bids_{day}.csv").write_text("a\n")
    assert readers.previous_file(spark, f"{tmp_path}/d", "2026-06-10").endswith("bids_2026-06-09.csv")
    os.utime(tmp_path / "d" / "bids_2026-06-08.csv", (4e9, 4e9))
    assert readers.newest_file(spark, f"{tmp_path}/d").endswith("bids_2026-06-08.csv")


TABLE = """<select><option value="1">Alliston</option><option>Corn</option></select><h3>Corn</h3><table><tr><td>x</td></tr></table>
<table><tr><th>Location</th><th>Delivery</th><th>Futures Month</th><th>Basis *</th><th>Cash Price</th></tr>
<tr><td>Alliston</td><td>May 2026</td><td>@C6N</td><td>1.40</td><td>6.19</td></tr><tr><td>Alliston</td><td>May 2026</td><td>@C6N</td><td>9</td><td>9</td></tr><tr><td></td><td></td><td></td><td></td><td></td></tr></table>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, TABLE), (2, None), (3, "<p>no table")], "page_id int, html string")
    (row,) = pages.page_bids(df, "wanstead").collect()
    assert (row.Location, row.Name, row.Delivery, row.Basis, row["Bushel Cash Price"], row["MT Cash Price"]) == ("Alliston", "Corn", "May 2026", "1.40", "6.19", "243.69")
    with pytest.raises(KeyError, match="known"):
        pages.adapter("nope")
    assert [r.label for r in pages.options(df).collect()] == ["Alliston"]
    assert {r[0] for r in df.select(pages.page_kind(F.col("html"))).collect()} == {"table", "unknown"}
    script = "q = {'ZCK26': {name: 'Corn', month: 'May 26', last: '439-4'}}; quote = quotevarAB['ZCK26']; cashchart.php?c=1&l=2&d=J26 var rounded = price + 195;"
    src = spark.createDataFrame([(1, script)], "page_id int, html string")
    quote = src.select(F.explode(pages.quotes(F.col("html"))).alias("q")).select("q.*")
    (r,) = pages.script_bids(src, quote).collect()
    assert (r.symbol, r.delivery, r.basis, r.futures_price, r.futures_month, r.cash_price_bu) == ("ZCK26", "Apr 2026", 1.95, 4.395, "May 2026", 6.345)
    call = "<h4>Here</h4> writeBidRow('Corn',-25,false,false,false,0.5,'05/01/2026','05/31/2026','L','g','n',1,'c','s',quotes['ZCK26'])"
    (r,) = pages.call_bids(spark.createDataFrame([(1, call)], "page_id int, html string"), quote).collect()
    assert (r.location, r.name, r.basis, str(r.delivery_end), r.cash_price_bu) == ("Here", "Corn", -0.25, "2026-05-31", 4.145)


def test_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", F.floor(F.col("value") / 10).cast("double").alias("basis"))
    want = {r.id: r.change for r in history.carried_change(e, "key", "ts", "id", "basis").collect()}
    timed = e.select("id", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "basis").cache()
    ordered = timed.approxQuantile("at_us", [0.5], 0)[0]
    timed.where(F.col("at_us") <= ordered).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = {}
    for _ in range(2):
        stream = spark.readStream.schema(timed.schema).parquet(f"{tmp_path}/in")
        q = incremental.carried_stream(stream, "key", "at_us", "id", "basis").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        timed.where(F.col("at_us") > ordered).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in") if not got else None
        got = {r.id: r.change for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want


def test_alert_stream(spark, tmp_path):
    rules = spark.createDataFrame([(1, "basis", ">", 1.0)], "rule_id int, rule_type string, comparison_operator string, threshold double")
    make = lambda hits: hits.select("rule_id", F.concat(F.lit("v="), F.col("value").cast("string")).alias("message"), F.lit("new").alias("status"), F.current_timestamp().alias("triggered_at"))
    write = incremental.alert_sink(rules, f"{tmp_path}/alerts", make)
    batch = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 0.5)], "id int, basis double")
    for n in range(2):
        write(batch, n)
    assert spark.read.parquet(f"{tmp_path}/alerts").count() == 1
