"""Workbooks written by tasks: one archive a file name, one sheet a sheet name, row by row.

Rows are dealt by file and sorted by sheet and position; a task streams them into the parts of its archive, so it holds one
batch of rows and the compressed archive. Texts are inline strings, which no spreadsheet reads as a formula. Archives are
written beside their place and renamed, so a task that runs again replaces its own file as a whole.

Edge cases: nulls and non-finite numbers are empty cells; a sheet of more rows than a spreadsheet holds goes on in `name (2)`;
sheet names lose the characters that spreadsheets forbid, are cut to 31 and kept apart by numbers; null file or sheet names are
'none'; characters that XML forbids are dropped; no rows, no file. One workbook is one task's work: split large exports by file.
"""

from __future__ import annotations

import io
import math
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHEET_ROWS = 1_048_576  # fixed by spreadsheets
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_FORBIDDEN = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


def _cell(value: object) -> str:
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, str):
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_FORBIDDEN.sub("", value))}</t></is></c>'
    return f"<c><v>{value}</v></c>"


class Workbook:
    """An archive that is written sheet after sheet."""

    def __init__(self) -> None:
        self.data = io.BytesIO()
        self.zip = zipfile.ZipFile(self.data, "w", zipfile.ZIP_DEFLATED)
        self.names: list[str] = []
        self.out = None

    def sheet(self, name: str, headers: list[str], limit: int = SHEET_ROWS) -> None:
        """Begin a sheet under its header row."""
        self._end()
        self.base, self.headers, self.limit, self.rows = name, headers, limit, 0
        plain = re.sub(r"[\[\]:*?/\\]", " ", _FORBIDDEN.sub("", name)).strip("' ")[:31] or "none"
        n, own = 1, plain
        while own.lower() in (x.lower() for x in self.names):
            n += 1
            own = f"{plain[: 31 - len(f' ({n})')]} ({n})"
        self.names.append(own)
        self.out = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True)
        self.out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        self._row(headers)

    def _row(self, values: list) -> None:
        self.out.write(("<row>" + "".join(map(_cell, values)) + "</row>").encode())
        self.rows += 1

    def row(self, values: list) -> None:
        if self.rows == self.limit:
            self.sheet(self.base, self.headers, self.limit)
        self._row(values)

    def _end(self) -> None:
        if self.out is not None:
            self.out.write(b"</sheetData></worksheet>")
            self.out.close()

    def finished(self) -> bytes:
        self._end()
        at = range(1, len(self.names) + 1)
        sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(at, self.names, strict=True))
        links = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in at)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in at)
        parts = {
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{sheets}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        }
        for name, text in parts.items():
            self.zip.writestr(name, _HEAD + text)
        self.zip.close()
        return self.data.getvalue()


def _save(folder: str, name: str, data: bytes) -> str:
    """Write a file beside its place and rename it; its path."""
    system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    system.create_dir(root, recursive=True)
    path = posixpath.join(root, re.sub(r"[^\w. -]", "_", name) + ".xlsx")
    with system.open_output_stream(f"{path}.part") as f:
        f.write(data)
    system.move(f"{path}.part", path)
    return path


def write_workbooks(df: DataFrame, folder: str, file: str, sheet: str, position: str, limit: int = SHEET_ROWS) -> DataFrame:
    """Write the rows and return (file, path, sheets, n_rows) of every workbook. Columns are those of `df` but the three."""
    columns = [c for c in df.columns if c not in (file, sheet, position)]
    kinds = dict(df.dtypes)
    plain = [F.col(f"`{c}`") if kinds[c] in ("string", "int", "bigint", "double", "boolean") else F.col(f"`{c}`").cast("double" if kinds[c].startswith(("decimal", "float", "smallint", "tinyint")) else "string") for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, at, n = None, (None, None), 0
        names = ["file", "path", "sheets", "n_rows"]

        def closed() -> pa.RecordBatch:
            path = _save(folder, at[0], book.finished())
            return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([path]), pa.array([len(book.names)], pa.int32()), pa.array([n], pa.int64())], names=names)

        for batch in batches:
            files, sheets, *values = (c.to_pylist() for c in batch.columns)
            for k, key in enumerate(zip(files, sheets, strict=True)):
                if key[0] != at[0]:
                    if book is not None:
                        yield closed()
                    book, n = Workbook(), 0
                if key != at:
                    book.sheet(key[1], columns, limit)
                    at = key
                book.row([v[k] for v in values])
                n += 1
        if book is not None:
            yield closed()

    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("none")).alias(a) for c, a in ((file, "__file"), (sheet, "__sheet"))]
    dealt = df.select(*named, F.col(f"`{position}`").alias("__at"), *[p.alias(f"c{i}") for i, p in enumerate(plain)]).repartition("__file").sortWithinPartitions("__file", "__sheet", "__at").drop("__at")
    return dealt.mapInArrow(run, "file string, path string, sheets int, n_rows long")
