"""Workbooks and mapping documents: zipped XML, cut into rows one file a task step; what rows mean is column expressions.

Cells are text. Dates of a workbook stay the serial numbers that the file holds.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.functions import keys, text

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS_A_BATCH = 4096

# Headers of a mapping table, and labels that name no single place.
PLACE_HEADERS = ("location / town", "location")
SINGLE_HEADERS = ("single elevator",)
OPERATOR_HEADERS = ("operator",)
EVIDENCE_HEADERS = ("evidence",)
NOT_A_PLACE = ("f.o.b", "u.s. rep", "county", "regional price", "price index")
# End of fixed values.


def _column(reference: str) -> int:
    """Place of a cell reference such as B7, from 0."""
    at = 0
    for letter in re.match(r"[A-Z]*", reference)[0]:
        at = at * 26 + ord(letter) - 64
    return at - 1


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
    raw = cell.findtext(f"{_SHEET}v")
    return shared[int(raw)] if cell.get("t") == "s" and raw is not None else raw


def _sheets(data: bytes) -> Iterator[tuple[str, Iterator[list[str | None]]]]:
    """Name and rows of each sheet, in the workbook's order."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si"):
            shared.append("".join(t.text or "" for t in item.iter(f"{_SHEET}t")))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}

    def rows(name: str) -> Iterator[list[str | None]]:
        with book.open(name) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag == f"{_SHEET}row":
                    cells: list[str | None] = []
                    for cell in row.iter(f"{_SHEET}c"):
                        at = _column(cell.get("r") or "") if cell.get("r") else len(cells)
                        cells.extend([None] * (at - len(cells)))
                        cells.append(_value(cell, shared))
                    yield cells
                    row.clear()

    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
        target = targets[sheet.get(_LINK)].lstrip("/")
        yield sheet.get("name"), rows(target if target.startswith("xl/") else f"xl/{target}")


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Rows path, sheet, position, headers, cells of every sheet of every workbook; its first row that has a cell heads a sheet.

    A workbook is read by one task as a whole (it is one archive), so it must fit a value of Spark (2 GB) and a worker's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, names = pa.list_(pa.string()), ["path", "sheet", "position", "headers", "cells"]
        for batch in batches:
            for name, data in zip(*batch.columns, strict=True):
                for sheet, rows in _sheets(data.as_py()):
                    headers: list[str] | None = None
                    block: list[tuple[int, list]] = []

                    def made(block: list, headers: list | None, name: str = name.as_py(), sheet: str = sheet) -> pa.RecordBatch:
                        n = len(block)
                        at, cells = [b[0] for b in block], [b[1] for b in block]
                        return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([sheet] * n, pa.string()), pa.array(at, pa.int64()), pa.array([headers] * n, texts), pa.array(cells, texts)], names=names)

                    for position, cells in enumerate(rows):
                        if headers is None:
                            headers = [c or "" for c in cells] if any(cells) else None
                            continue
                        block.append((position, cells))
                        if len(block) == ROWS_A_BATCH:
                            yield made(block, headers)
                            block = []
                    if block:
                        yield made(block, headers)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, sheet string, position long, headers array<string>, cells array<string>")


def _plain(header: Column) -> Column:
    return F.regexp_replace(F.lower(header), "[^a-z0-9]", "")


def workbook_rows(rows: DataFrame) -> DataFrame:
    """Workbook rows in the standard text columns: the source is the Source cell, else the sheet; the delivery label is the delivery end."""
    plain = F.transform("headers", _plain)

    def under(names: list[str]) -> Column:
        found = [F.nullif(F.array_position(plain, re.sub("[^a-z0-9]", "", n.lower())), F.lit(0)) for n in names]
        return F.nullif(F.trim(F.get("cells", (F.coalesce(*found) - 1).cast("int"))), F.lit(""))

    out = rows.select("path", "position", F.coalesce(under(["Source", "source_sheet"]), F.col("sheet")).alias("source_name"), *[under(list(a)).alias(c) for c, a in keys.SHEET_ALIASES.items() if c not in ("source_name", "source_sheet")])
    return out.withColumn("delivery_label", F.col("delivery_end")).where("coalesce(location, commodity) is not null")


def _said(node: ElementTree.Element) -> str:
    return " ".join(" ".join(t.text or "" for t in node.iter(f"{_WORD}t")).split())


def read_mapping_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows path, table_no, position, headers, cells, citations: the tables of word-processor files, with the addresses
    ({number: url}) that paragraphs such as [3] announce within the next four paragraphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*batch.columns, strict=True):
                root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data.as_py())).read("word/document.xml"))
                lines = [x for x in map(_said, root.iter(f"{_WORD}p")) if x]
                cited = []
                for i, line in enumerate(lines):
                    if number := re.fullmatch(r"\[(\d+)\]", line):
                        url = next((x for x in lines[i + 1 : i + 5] if x.startswith(("http://", "https://"))), None)
                        cited += [(number[1], url)] if url else []
                out: list[tuple] = []
                for t, table in enumerate(root.iter(f"{_WORD}tbl")):
                    rows = [[_said(c) for c in r.findall(f"{_WORD}tc")] for r in table.findall(f"{_WORD}tr")]
                    rows = [r for r in rows if r]
                    out += [(name.as_py(), t, i, rows[0], r, list(dict(cited).items())) for i, r in enumerate(rows[1:], 1)]
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["path", "table_no", "position", "headers", "cells", "citations"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, table_no int, position long, headers array<string>, cells array<string>, citations map<string,string>")


def place_seeds(rows: DataFrame, default_url: str = "") -> DataFrame:
    """Who buys where, by the first table of each document that has a place, a single-elevator and an operator header.

    'yes' rows are verified (confidence 0.9) and named by their operator. 'yes?' rows are tentative (0.75) and stay only if
    they point to one parent company. Other statuses, and labels that name no single place, go.
    """
    low = F.transform("headers", lambda h: F.lower(h))

    def under(names: tuple[str, ...]) -> Column:
        holding = lambda word: F.transform(low, lambda h: h.contains(word))
        found = [F.nullif(F.array_position(holding(n), True), F.lit(0)) for n in names]
        return text.plain_punctuation(text.normalize_text(F.get("cells", (F.coalesce(*found) - 1).cast("int"))))

    has = lambda word: F.exists(low, lambda h: h.contains(word))
    kept = rows.where(has("location") & has("single elevator") & has("operator"))
    first = kept.groupBy("path").agg(F.min("table_no").alias("table_no"))
    kept = kept.join(first, ["path", "table_no"], "left_semi")
    kept = kept.select("path", "position", "citations", under(PLACE_HEADERS).alias("raw_location"), F.lower(under(SINGLE_HEADERS)).alias("single"), under(OPERATOR_HEADERS).alias("operator"), under(EVIDENCE_HEADERS).alias("evidence"))
    kept = kept.where(F.col("single").isin("yes", "yes?") & F.col("raw_location").isNotNull() & F.col("operator").isNotNull())
    for words in NOT_A_PLACE:
        kept = kept.where(~F.lower("raw_location").contains(words))
    sure = F.col("single") == "yes"
    company = F.when(sure, text.operator_company(F.col("operator"), F.col("raw_location"))).otherwise(text.parent_company(F.col("operator"), F.col("raw_location"), F.col("evidence")))
    numbers = F.regexp_extract_all(F.coalesce("evidence", F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1))
    urls = F.filter(F.transform(numbers, lambda n: F.col("citations")[n]), lambda u: u.isNotNull())
    return kept.select(
        "path",
        "position",
        "raw_location",
        F.coalesce(text.canonical_location(F.col("raw_location")), F.col("raw_location")).alias("location"),
        text.canonical_commodity(F.nullif(F.regexp_extract("raw_location", r"(?i)\b(corn|soybeans?|wheat)\b", 1), F.lit(""))).alias("commodity"),
        company.alias("company"),
        F.coalesce(F.get(urls, F.lit(0)), F.lit(default_url)).alias("source_url"),
        F.when(sure, 0.9).otherwise(0.75).alias("confidence"),
        sure.alias("verified"),
        F.concat(F.lit("Operator text: "), "operator", F.coalesce(F.concat(F.lit(" | Evidence: "), "evidence"), F.lit(""))).alias("notes"),
    ).where("company is not null")
