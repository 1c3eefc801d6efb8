"""Tables of pages: plain markup read like any other, in batches of a bounded size, and parts that follow the number of rows."""

import random

import pyarrow as pa

from basisline.operators.sizes import dealt_by
from basisline.sources import pages

PLAIN = ["<table>", "</table>", '<TABLE class="a homepage_quoteboard">', "<table class=x id='q'>", "<tr>", "</tr>", "<td>", "</td>", "<td colspan=2>", "<TD COLSPAN='3' >", "</th >", "<h3>", "</h3>", "<caption>", "</caption>", "<br>", "text &amp; more", "a > b", " 1'2 &lt;", "\xe9 \xa0x", "&nbsp;", "&notit;", "&#39"]
ODD = ["<!-- <td>x</td> -->", "<script>var a='<td>';</script>", "a < b", "<td/>", '<td class="a>b">', "<!DOCTYPE html>", "<title>q</title>", '<td class="a&amp;b">', "</>", "<1>", "<td a=b/c>", "<style>x</style>"]


def test_plain_markup_reads_like_any_other():
    rng = random.Random(1)
    for i in range(4000):
        page = "".join(rng.choice(PLAIN if i % 2 or rng.random() < 0.97 else ODD) for _ in range(rng.randrange(1, 40)))
        slow, fast = pages._Tables(), pages._Tables()
        try:
            slow.feed(page)
            slow.close()
        except IndexError:  # a cell that ends within a table of its own
            continue
        fast.read(page)
        assert (fast.tables, fast.classes, fast.spanned) == (slow.tables, slow.classes, slow.spanned), page


def test_rows_leave_in_bounded_batches():
    page = "<table>" + "<tr><td>a</td><td>b</td></tr>" * 10_000 + "</table>"
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([page, None, page]), pa.array([None] * 3, pa.int32())], names=["k", "html", "part"])
    out = list(pages._table_rows(iter([batch]), ["k", *"abcdefgh"]))
    assert sum(b.num_rows for b in out) == 20_000 and max(b.num_rows for b in out) <= pages.OUT_ROWS


def test_parts_follow_the_number_of_rows(spark):
    df = dealt_by(spark.range(1000).selectExpr("id div 10 as k", "id"), "k", 100)
    assert df.rdd.getNumPartitions() == 10 and df.rdd.glom().map(len).max() < 250 and dealt_by(df.limit(0), "k").isEmpty()


def test_transposed_tables_are_not_blown_up_before_grouping(spark):
    lines = [["", "May", "Jul", "Sep"], ["Futures Month", "K", "N"], ["Basis", "1", " ", "3"], ["basis again", "7", "8", "9"], ["Futures Month", "x", "y", "U"]]
    html = "<table><caption>Corn bids</caption>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in lines) + "</table><table><tr><td>Futures Month</td></tr></table>"
    out = pages.transposed_bids(pages.tables(spark.createDataFrame([(1, html)], "page_id long, html string")), False)
    got = [(r.row_no, r.Name, r.Delivery, r["Futures Month"], r.Basis) for r in out.orderBy("row_no").collect()]
    assert got == [(0, "Corn", "May", "K", "1"), (1, "Corn", "Jul", "N", None), (2, "Corn", "Sep", "U", "3")]  # a short row leaves its place to the next
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("Aggregate") == 1 and "Join" not in plan


def test_columns_are_placed_once_a_table(spark):
    html = "<table><tr><td>Delivery</td><td>Basis</td><td>Cash Price</td><td>Name</td></tr>" + "<tr><td>May</td><td>1</td><td>5</td><td>Corn</td></tr>" * 2 + "</table>"
    rows = pages.tables(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    got = pages.bid_tables(rows, columns={"b": ("basis",), "none": ("futures",)})
    assert [(r.at.b, r.at.none, r.cells[r.at.b]) for r in got.collect()] == [(1, None, "1")] * 2
