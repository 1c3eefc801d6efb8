"""Column functions on tables of inputs and expected values."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from basisline.functions import keys, periods, prices, text


def run(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", function(F.col("v"))).collect())]


def check(spark, function, cases, kind="string"):
    assert run(spark, function, list(cases), kind) == list(cases.values())


def test_normalize_text(spark):
    check(spark, text.normalize_text, {"  a \t b ": "a b", "NaN": None, "n/a": None, "-": None, "": None, "x y": "x y", "none ": None, None: None})


def test_sources(spark):
    check(spark, text.canonical_source, {"glg": "Great Lakes Grain", "LAC": "London Agricultural Commodities", "Hensall HDC": "Hensall Co-operative", "Snobelen": "Snobelen Farms", "Ontario Daily File": "Ontario Cash Bids", "New One": "New One", None: None})
    check(spark, lambda c: F.concat_ws("/", text.source_scope(c).scope, text.source_scope(c).label), {"Ontario Daily File": "region/Ontario", "GLG": "company/Great Lakes Grain"})
    check(spark, text.region_sources, {"Eastern Ontario": ["Eastern Ontario Cash Bids"], "Unknown Region": []})
    check(spark, text.creates_company, {"GLG": True, "Agricharts": False, "Ontario Cash Bids": False, None: False})


def test_locations(spark):
    check(
        spark,
        text.canonical_location,
        {"Any Wanstead Branch": "Wanstead Branch", "Blenheim Corn": "Blenheim", "Prescott Transfer": "Prescott", "Ingredion Cardinal": "Cardinal", "Embrun Co-op": "Embrun", "A/B": "A / B", "Dry Wet Corn": "Dry Wet Corn", "Thamesford, GLG": "Thamesford"},
    )


def test_companies(spark):
    df = spark.createDataFrame([("Ingredion Cardinal", None, None, "Agricharts"), ("Nowhere", None, None, "Agricharts"), ("Embrun Co-op", None, None, "GLG"), ("Nowhere", "lac", "glg", "x"), ("Nowhere", "Agricharts", "glg", "x")], "l string, a string, b string, s string")
    assert [r[0] for r in df.select(text.display_company(F.col("l"), F.col("a"), F.col("b"), F.col("s"))).collect()] == ["Ingredion", None, "Embrun Co-op (GLG)", "London Agricultural Commodities", "Great Lakes Grain"]
    check(spark, text.attribution, {"Agricharts": "Agricharts", "GLG": None, "Ontario Daily File": "Ontario Cash Bids"})


def test_invalid_commodity(spark):
    df = spark.createDataFrame([("Mixed Daily File", "Ganaraska"), ("Ganaraska", "ganaraska"), ("Corn", "Ganaraska"), (None, "x"), ("Corn", None)], "c string, s string")
    assert [r[0] for r in df.select(text.invalid_commodity(F.col("c"), F.col("s"))).collect()] == [True, True, False, False, False]


def test_small_text(spark):
    check(spark, text.distinct_list, {"a, B ,a,,b, c": ["a", "B", "c"], "": []})
    check(spark, text.spreadsheet_safe, {"=1+1": "'=1+1", "@x": "'@x", "-5": "'-5", "ok": "ok"})
    check(spark, text.email, {" A@B.co ": "a@b.co", "nope": None})
    check(spark, text.strip_html, {"<b>5 &lt; 6</b>&nbsp;&amp;": "5 < 6 &"})
    check(spark, text.escape_html, {"<a & 'b'>": "&lt;a &amp; &#39;b&#39;&gt;"})
    check(spark, text.plain_punctuation, {"“a” – b’s": "\"a\" - b's"})


def test_tick_prices(spark):
    D = lambda x: Decimal(x).quantize(Decimal("0.000001"))
    check(spark, prices.tick_price, {"456'6": D("456.75"), "456-6": D("456.75"), "455'6s": D("455.75"), "NaN": None, "$1,234.5": D("1234.5"), "-5'4": D("-4.5"), "456'12": D("456.12"), "456'8": D("456.8"), "": None, "x": None, None: None})
    check(spark, prices.price_in_text, {"ZCN26 @ 6.34": D("6.34"), "July 2026": None, "November 2030": None, "455'6s": D("455.75"), "500": D("500"), "2030": None, "$ 1500": D("1500"), None: None})


def test_units(spark):
    check(spark, prices.dollars_per_bushel, {"425-6": 4.2575, "425.75": 4.2575, "4.25": 4.25, "$4.25": 4.25, "439": 4.39})
    check(spark, prices.lenient_number, {"$1'5": 1.5, "-3": 0.3, "abc": None})
    assert run(spark, lambda c: prices.basis_to_store(c), [Decimal("140"), Decimal("1.4"), Decimal("-25"), Decimal("12.345")], "decimal(18,6)") == [Decimal("1.400000"), Decimal("1.400000"), Decimal("-0.250000"), Decimal("0.120000")]
    assert run(spark, prices.basis_to_show, [140.0, 1.4, float("nan"), None], "double") == [1.4, 1.4, None, None]
    assert run(spark, prices.show_basis, [1.1, -0.25, None], "double") == ["+1.10/bu", "-0.25/bu", "n/a"]
    assert run(spark, prices.show_cash, [5.45, None], "double") == ["$5.45/bu", "n/a"]


def test_month_keys(spark):
    k = lambda y, m: y * 12 + m
    check(
        spark,
        periods.month_key,
        {"May 31, 2026": k(2026, 5), "May-26": k(2026, 5), "Jul 2026": k(2026, 7), "May 31": k(9999, 5), "May 45": k(2045, 5), "Harvest 26": k(2026, 10), "N26": k(2026, 7), "ZCN26": None, "Nearby": None, "nov": k(9999, 11), "Nov 30, 2026": k(2026, 11), None: None, "Sept/26": k(2026, 9)},
    )
    check(spark, periods.month_label, {"May-26": "May 2026", "Jul 2026": "July 2026", "Nov 30, 2026": "November 2026", "May 31": "May", "Nearby": "Nearby", "December 2025": "December 2025"})
    check(spark, periods.period_key, {"May 2026": f"month:{k(2026, 5)}", "May-26": f"month:{k(2026, 5)}", "Nearby": "nearby", None: "-"})


def test_periods(spark):
    check(spark, periods.delivery_of_futures, {"Jul 2026": "June 2026", "Jan 2027": "December 2026", "Foo 26": None, "July, 26": "June 2026"})
    check(spark, periods.next_month, {"Dec 2026": "January 2027"})
    check(spark, periods.looks_like_month, {"May 2026": True, "Nov 30, 2026": True, "2025 Crop": False, None: False, "Mayor": False})
    check(spark, periods.futures_month, {"@C6K": "May 2026", "ZCK26": "May 2026", "@C6N": "Jul 2026", "ZCN26": "July 2026", "Jan 2026": None, "Harvest 26 Farm": None})
    check(spark, lambda c: periods.futures_month(c, scan_letters=True), {"ZCK26": "May 2026", "XN26": "July 2026", "": None})
    check(spark, periods.short_month, {"May-26": "May 2026", "Sept 2026": "Sep 2026", "x": "x"})
    check(spark, periods.long_month, {"Aug-26": "August 2026"})
    check(spark, periods.iso_month, {"May-26": "2026-05", "Spot": "spot"})
    check(spark, periods.delivery_code, {"J26": "Apr 2026", "?": "?"})
    check(spark, periods.quoted_month, {"May 26": "May 2026", "may 2026": "May 2026"})
    assert run(spark, periods.iso_week, [datetime.date(2026, 7, 14), datetime.date(2027, 1, 1)], "date") == ["2026-W29", "2026-W53"]


def test_recency(spark):
    as_of = F.lit("2026-06-10").cast("date")
    check(spark, lambda c: periods.current(c, as_of), {"May 2026": False, "june 2026": True, "July 2026": True, "Nearby": True, None: True})
    check(spark, lambda c: periods.expired(c, F.lit(None).cast("string"), as_of), {"May-26": True, "May 31": False, "Harvest 25": False, "2025 crop May 25": False, "Jul 2026": False})


def test_keys(spark):
    df = spark.createDataFrame([(" A  b", "Corn", None, "May 2026", "Jul 2026")], "a string, b string, c string, d string, e string")
    assert df.select(keys.composite_key(*map(F.col, "abcde"))).first()[0] == "a b|corn||may 2026|jul 2026"
    a = spark.createDataFrame([("Blenheim Corn", "May 2026", "July 2026"), ("Blenheim", "May-26", "Jul 2026")], "l string, d string, f string")
    assert a.select(keys.preview_key(F.col("l"), F.lit("x"), F.lit("Corn"), F.col("d"), F.col("f"))).distinct().count() == 1


def test_headers():
    m = keys.map_headers(["Location Name", "Commodity", "Delivery Label", "Futures Symbol", "Basis", "Bushel Cash Price"])
    assert m == {"location": "Location Name", "commodity": "Commodity", "delivery_label": "Delivery Label", "futures_month": "Futures Symbol", "basis": "Basis", "cash_price_bu": "Bushel Cash Price"}
    assert keys.map_headers(["Site", "Crop", "x"], {"basis": "x"})["basis"] == "x"
    with pytest.raises(ValueError, match="commodity"):
        keys.map_headers(["Location"])
    assert keys.find_column(["Futures  ($/bu)"], ["Futures", "Futures ($/bu)"]) == "Futures  ($/bu)"
