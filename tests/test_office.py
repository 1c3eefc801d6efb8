"""Workbooks, mapping documents, settings and transposed page tables with known contents."""

import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from basisline.functions import text
from basisline.sources import office, pages, readers

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, sheets):
    """A workbook with shared strings, numbers and left-out cells."""
    shared, books, links = [], [], []
    with zipfile.ZipFile(path, "w") as z:
        for k, (name, rows) in enumerate(sheets.items(), 1):
            out = []
            for r, row in enumerate(rows, 1):
                cells = []
                for c, v in enumerate(row):
                    if v is None:
                        continue
                    where = f"{chr(65 + c)}{r}"
                    if isinstance(v, str):
                        shared.append(v)
                        cells.append(f'<c r="{where}" t="s"><v>{len(shared) - 1}</v></c>')
                    else:
                        cells.append(f'<c r="{where}"><v>{v}</v></c>')
                out.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {MAIN}><sheetData>{''.join(out)}</sheetData></worksheet>")
            books.append(f'<sheet name="{name}" sheetId="{k}" r:id="rId{k}"/>')
            links.append(f'<Relationship Id="rId{k}" Type="t" Target="worksheets/sheet{k}.xml"/>')
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{"".join(books)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(links)}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(f'<si><t>{escape(s)}</t></si>' for s in shared)}</sst>")


def document(path, tables, paragraphs):
    said = lambda t: f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    body = "".join("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{said(c)}</w:tc>" for c in row) + "</w:tr>" for row in t) + "</w:tbl>" for t in tables)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}{"".join(map(said, paragraphs))}</w:body></w:document>')


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"GLG": [["Location", "Name", "Delivery", "Basis", "Source"], ["Alliston", "Corn", "May 2026", 1.4], ["Prescott", None, None, -0.25, "LAC"], [None, None, "x"]], "Empty": [], "Heads": [["Location"]]})
    rows = office.read_workbooks(spark, f"{tmp_path}/*.xlsx")
    assert rows.count() == 3
    got = [(r.location, r.commodity, r.delivery_end, r.delivery_label, r.basis, r.source_name) for r in office.workbook_rows(rows).orderBy("position").collect()]
    assert got == [("Alliston", "Corn", "May 2026", "May 2026", "1.4", "GLG"), ("Prescott", None, None, None, "-0.25", "LAC")]


def test_mapping_documents(spark, tmp_path):
    head = ["Location / Town", "Single Elevator?", "Operator (if single)", "Evidence & Notes"]
    rows = [
        ["Blenheim Corn", "Yes", "Thompsons (The Andersons)", "see [2]"],
        ["Exeter", "yes?", "Huron Bay Co‑operative or others", "[9]"],
        ["Alma", "Yes?", "Cargill and ADM", ""],
        ["Ayr", "Yes?", "Parrish", ""],
        ["Kent County", "Yes", "ADM", ""],
        ["Paris", "Multiple", "ADM", ""],
        ["Cardinal", "Yes", "Local Mill", ""],
        ["short"],
    ]
    document(tmp_path / "m.docx", [[["a", "b"], ["1", "2"]], [head, *rows]], ["[2]", "note", "https://x.test/a", "[9]"])
    seeds = office.place_seeds(office.read_mapping_documents(spark, f"{tmp_path}/*.docx"), "https://default.test").orderBy("position").collect()
    assert [(s.location, s.commodity, s.company, s.source_url, s.confidence, s.verified) for s in seeds] == [
        ("Blenheim", "Corn", "The Andersons", "https://x.test/a", 0.9, True),
        ("Exeter", None, "Huron Bay Co-operative", "https://default.test", 0.75, False),
        ("Ayr", None, "Parrish & Heimbecker", "https://default.test", 0.75, False),
        ("Cardinal", None, "Local Mill", "https://default.test", 0.9, True),
    ]


def test_settings(spark, tmp_path):
    (tmp_path / "s.toml").write_text('[bid]\ntrim = 0.1\n[[us.elevators]]\nname = "A"\nenabled = true\nmore = 1\n[[us.elevators]]\nname = "B"\n')
    settings = readers.read_settings(spark, f"{tmp_path}/s.toml")
    assert settings["bid"]["trim"] == 0.1
    rows = readers.setting_rows(spark, settings, "us.elevators", "name string, enabled boolean")
    assert sorted(map(tuple, rows.collect())) == [("A", True), ("B", None)]
    assert readers.setting_rows(spark, settings, "us.none", "name string").count() == 0


GRID = """<table class="DataGrid"><caption>CORN</caption><tr><th></th><th>2025 Crop</th><th>2026 Crop</th></tr>
<tr><td>Futures Month</td><td>Dec 2025</td><td>Dec 2026</td></tr><tr><td>Futures</td><td>425-4</td><td>450-0</td></tr><tr><td>Basis</td><td>1.10</td></tr>
<tr><td>CDN Cash (Bushels)</td><td>5.35</td><td>5.60</td></tr><tr><td>Futures Change</td><td>2-0</td><td>1-0</td></tr><tr><td>Converted Price (Tonnes)</td><td>210.6</td><td></td></tr></table>"""


@pytest.mark.parametrize(("name", "crops"), [("snobelen", {"Corn"}), ("andersons", {"Corn", "Soybeans"})])
def test_transposed_tables(spark, name, crops):
    page = "<table><tr><th>x</th><th>y</th></tr><tr><td>no</td><td>bids</td></tr></table>" + GRID * (2 if name == "andersons" else 1)
    df = spark.createDataFrame([(1, page, "North"), (2, None, "South"), (3, GRID * 6, "West")], "page_id int, html string, place string")
    got = pages.page_bids(df, name, place="place").orderBy("page_id", "Name", "Delivery").collect()
    mine = [r for r in got if r.page_id == 1]
    assert {r.Name for r in mine} == crops and len(mine) == 2 * len(crops)
    assert tuple(mine[0][c] for c in pages.BID_COLUMNS) == ("North", "Corn", "2025 Crop", None, "Dec 2025", "425-4", "2-0", "1.10", "5.35", "210.6", pages.adapter(name).source)
    assert (mine[1]["Basis"], mine[1]["MT Cash Price"]) == (None, "220.46")
    assert len([r for r in got if r.page_id == 3]) == (8 if name == "andersons" else 2)


def test_punctuation_and_operators(spark):
    rows = [("Hensall District Co‑op", "x", "Hensall Co-operative"), ("Hensall mill", "x", "Hensall mill"), ("unnamed", "Oakwood / Sunderland", "Oakwood-Sunderland Co-op"), ("P&H", None, "Parrish & Heimbecker")]
    df = spark.createDataFrame(rows, "operator string, place string, want string")
    assert df.where(~text.operator_company(F.col("operator"), F.coalesce("place", F.lit(""))).eqNullSafe(F.col("want"))).count() == 0
