"""Board orders, logical sources and report texts with known results."""

import datetime as dt

from pyspark.sql import functions as F

from basisline.functions import periods, text
from basisline.operators import health, pricing

NOW = dt.datetime(2026, 6, 10, 15)


def test_display_keys(spark):
    want = {"January 5, 2026": 1, "January 15, 2026": 2015 * 12 + 1, "Jan-26": 2026 * 12 + 1, "Harvest 26 Farm": 2026 * 12 + 10, "N26": 2026 * 12 + 7, "May": 5, "crop": None, " ": None, None: None}
    got = spark.createDataFrame([(k,) for k in want], "label string").select("label", periods.display_key(F.col("label"))).collect()
    assert dict(map(tuple, got)) == want


def test_eastern_places(spark):
    places = ["LAC - Kars", "Ingredion Cardinal", "Prescott (Transfer)", "Embrun Corn elevator", "Johnstown ethanol", "Kars Falls", "", None]
    got = spark.createDataFrame([(p,) for p in places], "p string").where(text.in_eastern_ontario(F.col("p"))).collect()
    assert [r.p for r in got] == ["LAC - Kars", "Ingredion Cardinal", "Prescott (Transfer)", "Johnstown ethanol"]


def test_sources_with_logical_ones(spark):
    sources = spark.createDataFrame([(1, "Daily", "file", None, True, 15, NOW), (2, "GLG", "automated", "glg", True, None, None)], "id int, name string, source_type string, adapter_key string, is_active boolean, polling_interval_minutes int, last_success_at timestamp")
    runs = spark.createDataFrame([(1, "GLG", NOW, "failed", None, None), (2, "GLG", NOW - dt.timedelta(hours=1), "completed", 0.5, 1)], "id int, source_name string, started_at timestamp, status string, parse_success_rate double, rejected_row_count long")
    listed = {r.name: r for r in health.with_health(sources, runs, F.lit(NOW), ["glg"]).collect()}
    assert (listed["GLG"].latest_run_status, listed["GLG"].successful_run_count, listed["GLG"].promotion_status, listed["GLG"].is_stale) == ("failed", 1, "pilot", True)
    assert (listed["Daily"].stale_age_minutes, listed["Daily"].promotion_status, listed["Daily"].can_refresh) == (0, "n/a", False)
    snapshots = spark.createDataFrame([(7, 1, NOW), (6, 1, NOW - dt.timedelta(days=1)), (5, 2, NOW)], "id int, source_id int, captured_at timestamp")
    rows = spark.createDataFrame([(7, "LAC", "a", []), (7, "LAC", "a", []), (7, "LAC", "b", ["missing_basis"]), (7, " ", "c", []), (6, "Old", "a", []), (5, "X", "a", [])], "snapshot_id int, source_name string, key string, reasons array<string>")
    (row,) = health.logical_sources(sources, snapshots, rows, F.lit(NOW)).collect()
    assert (row.id, row.name, row.logical_parent_source_name, row.source_type, row.logical_row_count, row.latest_rejected_row_count, row.is_stale) == ("1:LAC", "LAC", "Daily", "file_logical", 3, 1, False)


def test_report_text(spark):
    sections = spark.createDataFrame([("Corn", 4, 5.2, 0.4)], "crop string, market_count long, median_cash double, cash_spread double")
    tops = spark.createDataFrame([("Corn", 2, "B & C", 5.25, None, None), ("Corn", 1, "A", 5.45, 1.1, "July 2026")], "crop string, place int, label string, cash double, basis double, period string")
    report = pricing.report_text(sections, tops, ["Corn", "Wheat"], "Bids 2026-W24", "https://x.test/", "2026-06-10")
    body, page = report.select("body", pricing.report_html(F.col("body"))).first()
    assert body.split("\n") == [
        "Bids 2026-W24", "", "Data as of: 2026-06-10", "", "Corn", "* A - $5.45/bu; basis +1.10/bu; July 2026", "* B & C - $5.25/bu; basis n/a; -",
        "Markets: 4; median cash $5.20/bu; range $0.40/bu before freight.", "", "Wheat", "No current bids.", "", "Current bids: https://x.test", "Posted bids only; freight is not included.",
    ]
    assert page.startswith("<!doctype html><html><body><h1>Bids 2026-W24</h1><p>Data as of") and "B &amp; C" in page and page.endswith("</p></body></html>")
