"""Header mapping, ranked values, distinct labels, page tables, streaming sinks: against plain Python on small inputs."""

import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basisline.functions import keys
from basisline.operators import market, pricing, sizes
from basisline.plans import ingest
from basisline.sources import pages
from basisline.streaming import incremental
from basisline.sources import transactions


def test_headers_are_ranked():
    found = keys.map_headers(["Site", "LOCATION", "Crop", "crop", "Start-Date", "Futures  Mon.", "cash_bu", "Bushel Cash Price", "_basis"], {"basis": "Site", "nonsense": "Crop", "source_name": "absent"})
    # Aliases in order; a header spelled like its alias before one that reads like it; of equal readings the last.
    assert found["location"] == "LOCATION" and found["commodity"] == "crop" and found["delivery_start"] == "Start-Date" and found["futures_month"] == "Futures  Mon."
    assert found["cash_price_bu"] == "cash_bu" and found["basis"] == "Site" and "source_name" not in found
    assert keys.map_headers(["location", "Grain", "grain "])["commodity"] == "grain "
    with pytest.raises(ValueError, match="commodity"):
        keys.map_headers(["location"])


def test_ranked_values_medians_and_trimmed_means(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([1.0, 1.0, 2.5, rng.random() * 10, None])) for g in ["a", "b", None] for _ in range(400)] + [("one", 3.0), ("hot", 7.0), ("hot", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    by = {g: sorted(v for k, v in rows if k == g and v is not None) for g in {g for g, _ in rows}}
    got = {(r.g, r.v): (r.n, r.start, r.total) for r in pricing.ranked_values(df, ["g"], "v", 16).collect()}
    assert got == {(g, v): (n, sum(x < v for x in vs), len(vs)) for g, vs in by.items() for v, n in Counter(vs).items()}
    assert {r.g: r.median for r in pricing.medians(df, ["g"], "v").collect()} == {g: statistics.median(vs) for g, vs in by.items()}
    means = {r.g: r.anchor for r in pricing.trimmed_means(df, ["g"], "v", [], 0.2).collect()}
    for g, vs in by.items():
        cut = int(len(vs) * 0.2) if len(vs) >= 5 else 0
        assert means[g] == pytest.approx(statistics.mean(vs[cut : len(vs) - cut]))
    assert pricing.medians(df.limit(0), ["g"], "v").count() == 0


def test_distinct_labels_once(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), ("a", 4)], "label string, id int")
    got = {(r.label, r.id, r.up) for r in sizes.by_distinct(df, ["label"], up=F.coalesce(F.upper("label"), F.lit("none"))).collect()}
    assert got == {("a", 1, "A"), (None, 2, "none"), ("b", 3, "B"), ("a", 4, "A")}
    assert sizes.is_small(df) and not sizes.is_small(df, rows=3) and not sizes.is_small(df, size=10)


def test_places_equal_one_sort(spark):
    rng = random.Random(9)
    rows = [(rng.choice("xy"), rng.choice([None, 1, 2]), rng.choice("ab"), i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, a int, b string, id int")
    got = {r.id: r.place for r in market.placed(df, ["g"], {"a": F.col("a"), "b": F.col("b")}, [F.col("id")]).collect()}
    for g in "xy":
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
        assert [got[r[3]] for r in order] == list(range(1, len(order) + 1))


TWO_ROWS = "<table><tr><td>Delivery</td><td>Futures</td><td>Futures</td><td></td><td>Cash</td></tr><tr><td></td><td>Mon.</td><td>Price</td><td>Basis</td><td>Price</td></tr><tr><td>May 26</td><td>CN26</td><td>4.56</td><td>-20</td><td>5.10</td></tr></table>"
NO_HEADER = "<table><tr><td>Prices in bushel</td><td>cash</td><td>x</td></tr><tr><td>May</td><td>5.10</td><td>y</td></tr></table><table><tr><td>basis</td></tr></table>"
BY_PLACE = "<h3>Corn</h3><table><tr>" + "<td>h</td>" * 8 + "</tr><tr>" + "".join(f"<td>{x}</td>" for x in ("May", "N26", "456'6", "1", "-20", "5.10", "200", "3")) + "</tr><tr>" + "<td></td>" * 8 + "</tr><tr><td>short</td></tr></table>"


def test_page_tables_of_other_shapes(spark):
    df = spark.createDataFrame([(1, TWO_ROWS), (2, NO_HEADER), (3, BY_PLACE), (4, None)], "page_id int, html string")
    rows = pages.tables(df)
    merged = [(r.page_id, r.headers, r.cells) for r in pages.merged_header_tables(rows).collect()]
    assert merged == [(1, ["Delivery", "Futures Mon.", "Futures Price", "Basis", "Cash Price"], ["May 26", "CN26", "4.56", "-20", "5.10"])]
    words = [(r.page_id, r.headers, r.cells) for r in pages.keyword_tables(rows.where("page_id = 2")).collect()]
    assert words == [(2, ["Prices in bushel", "cash", "x"], ["May", "5.10", "y"])]
    assert {r.page_id for r in pages.bid_or_keyword_tables(rows).collect()} >= {1, 2}
    placed = pages.cells_by_place(rows.where("page_id = 3")).collect()
    assert [(r.Name, r["Delivery"], r["Futures Price"], r["Bushel Cash Price"]) for r in placed] == [("Corn", "May", "456'6", "5.10")]
    glg = pages.page_bids(df.where("page_id = 1"), "glg").collect()
    assert [(r.Name, r.Delivery, r["Futures Month"], r.Basis) for r in glg] == [("Corn", "May 26", "CN26", "-20")]


def test_last_literal_and_spacer_rows(spark):
    html = "<table><tr><th>Name</th><th>Delivery</th><th>Futures Month</th><th>Futures Price</th><th>Cash Price</th></tr><tr><td>Corn</td><td>May</td><td>CN26</td><td>4.50 (4.56)</td><td>was 5.00 now 5.10</td></tr></table>"
    bid = pages.page_bids(spark.createDataFrame([(1, html)], "page_id int, html string"), "lac").first()
    assert (bid["Futures Price"], bid["Bushel Cash Price"]) == ("4.56", "5.10")
    cells = [("Corn", "$ 5.10", ""), ("Name", "5.10", ""), ("", "5.10", ""), ("Soy", "", "-456-6"), ("Soy", "n/a", "456"), ("Oats", None, "456-7")]
    kept = pages.without_spacers(spark.createDataFrame(cells, "Name string, `Cash Price` string, `Futures Price` string")).collect()
    assert [r.Name for r in kept] == ["Corn", "Soy", "Oats"]


def test_quotes_without_bids(spark):
    page = spark.createDataFrame([(1, "x"), (2, "y")], "page_id int, html string")
    bids = spark.createDataFrame([(1, "a")], "page_id int, symbol string")
    quotes = spark.createDataFrame([(1, "CN26", "corn", "Jul 26", "425-4"), (2, "CN26", "corn", "Jul 26", "425-4")], "page_id int, symbol string, name string, month string, last string")
    got = pages.quotes_alone(page, bids, quotes).collect()
    assert [(r.page_id, r.name, r.delivery, r.futures_month, r.futures_price) for r in got] == [(2, "Corn", "Jul 2026", "Jul 2026", 4.255)]


def test_stream_marks_late_rows(spark, tmp_path):
    hour = 3600 * 1_000_000
    batches = [[("k", 1, 0, 5.0), ("k", 2, hour, 6.0)], [("k", 3, hour // 2, 9.0), ("k", 4, 2 * hour, 6.0), ("m", 5, 0, None)], [("k", 6, 30 * hour, 6.0), ("k", 7, 31 * hour, 4.0), ("m", 8, hour, 1.0)]]
    source = f"{tmp_path}/in"
    got = {}

    def keep(batch, _):
        got.update({r.tie: (None if r.change is None or math.isnan(r.change) else r.change, r.changed_us, r.late) for r in batch.collect()})

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "key string, tie long, at_us long, value double").coalesce(1).write.parquet(f"{source}/b{n}")
        stream = spark.readStream.schema("key string, tie long, at_us long, value double").option("recursiveFileLookup", True).parquet(source)
        out = incremental.carried_stream(stream, "key", "at_us", "tie", "value")
        incremental.latest_first(out, "", f"{tmp_path}/check", keep)
    assert got == {1: (0.0, None, False), 2: (1.0, hour, False), 3: (None, None, True), 4: (1.0, hour, False), 5: (0.0, None, False), 6: (0.0, None, False), 7: (-2.0, 31 * hour, False), 8: (0.0, None, False)}


def test_alert_batches_run_again_add_nothing(spark, tmp_path):
    rules = spark.createDataFrame([(1, "basis", ">", 1.0)], "rule_id int, rule_type string, comparison_operator string, threshold double")
    make = lambda hits: hits.select("rule_id", F.concat(F.lit("basis "), F.col("value").cast("string")).alias("message"), F.lit("open").alias("status"), F.lit("2024-01-01").alias("triggered_at"))
    sink = incremental.alert_sink(rules, f"{tmp_path}/alerts", make)
    first, second = (spark.createDataFrame(rows, "id int, basis double") for rows in ([(1, 2.0), (2, 0.5)], [(3, 2.0), (4, 3.0)]))
    for _ in range(2):
        sink(first, 0)
        sink(second, 1)
        assert sorted((r.batch, r.message) for r in spark.read.parquet(f"{tmp_path}/alerts").collect()) == [(0, "basis 2.0"), (1, "basis 3.0")]


def test_ingest_sink_writes_observations_and_runs(spark, tmp_path):
    cells = [(1, "Dover", "Corn", "May 2026", "Jul 2026", "456'6", "-0.2", "5.10", "200", "GLG"), (2, "", "Corn", "May 2026", "Jul 2026", "456'6", "-0.2", "5.10", "200", "GLG")]
    batch = spark.createDataFrame(cells, "position int, Location string, Crop string, Delivery string, `Futures Month` string, Futures string, Basis string, `Cash Price` string, `MT Cash Price` string, Buyer string")
    batch = batch.withColumn("at", F.lit("2024-01-01 08:00:00").cast("timestamp_ntz"))
    sink = incremental.ingest_sink(str(tmp_path), "feed", "position", "at", ingest.SheetOptions(), 4)
    for _ in range(2):
        sink(batch, 4)
    sink(batch.limit(0), 5)
    row = transactions.committed(spark, str(tmp_path), "observations").collect()
    assert [(r.batch, r.location, r.source_name, float(r.futures_price), r.captured_at.hour) for r in row] == [(4, "Dover", "Great Lakes Grain", 456.75, 8)]
    run = transactions.committed(spark, str(tmp_path), "runs").collect()
    assert [(r.batch, r.raw_row_count, r.rejected_row_count, r.status) for r in run] == [(4, 2, 1, "completed")]

