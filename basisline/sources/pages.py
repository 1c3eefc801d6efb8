"""Bids on web pages: tables, script calls and quote objects, as rows.

Tables are cut out by a small parser per page (Arrow batches); which table holds bids, which column is which, and what a
row is worth are column expressions after that. Script-written pages need no parser at all: their calls and objects are
matched by regular expressions inside Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basisline.functions import periods, prices, text
from basisline.operators.sizes import dealt_by, parts_of
from basisline.storage import stored

# Headers of a bid table, and words that name a crop.
BID_HEADERS = ("name", "delivery", "delivery end", "futures month", "futures price", "change", "basis", "cash price")
CROP_WORDS = {"corn": "Corn", "soy": "Soybeans", "bean": "Soybeans", "wheat": "Wheat"}
CROPS_BY_PLACE = ("Corn", "Soybeans", "White Wheat", "Soft Red Wheat")
BID_KEYWORDS = ("basis", "cash", "price", "delivery", "futures", "bushel", "tonne")
CELLS_BY_PLACE = ("Delivery", "Futures Month", "Futures Price", "Change", "Basis", "Bushel Cash Price", "MT Cash Price", "Basis / (Tonnes)")
TITLE_STOPS = ("name", "delivery", "futures", "change", "basis", "cash", "settlement", "price")
TITLED_CLASS = "homepage_quoteboard"
CASH_CELL = r"^\$?\s*\d"
FUTURES_CELL = r"^[+-]?\d{1,4}-[0-7]$"
# End of fixed values.

Columns = Mapping[str, Sequence[str]]  # names of each column

BID_COLUMNS = ("Location", "Name", "Delivery", "Delivery End", "Futures Month", "Futures Price", "Change", "Basis", "Bushel Cash Price", "MT Cash Price", "Source")


# Plain tags, with the words before each. Markup of any other kind (comments, scripts, stray brackets) goes to HTMLParser.
_WS = r"[ \t\n\r\f]"
_NAME = r"[a-z][a-z0-9]*"
_RAW = re.compile("<(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)", re.IGNORECASE)  # what they hold is no markup
_TAG = re.compile(rf"""([^<]*)<(?:/({_NAME}){_WS}*|({_NAME})((?:{_WS}+[a-z][a-z0-9_:-]*(?:=(?:"[^"<>&]*"|'[^'<>&]*'|[^\s"'<>=`&/]+))?)*){_WS}*)>""", re.IGNORECASE | re.ASCII)
_ATTRIBUTE = re.compile(r"""([a-z][a-z0-9_:-]*)(?:="([^"]*)"|='([^']*)'|=([^\s"']+))?""", re.IGNORECASE | re.ASCII)
OUT_ROWS = 4096  # table rows of a batch that leaves the parser


class _Tables(HTMLParser):
    """Cells of every table with the heading before it; nested tables are tables of their own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[tuple[str, list[tuple[bool, list[str]]]]] = []
        self.classes: list[str] = []
        self.spanned: set[tuple[int, int]] = set()  # (table, row) whose first cell spans columns
        self.open: list[int] = []
        self.cell: list[str] | None = None
        self.title: list[str] | None = None
        self.heading = ""

    def read(self, page: str) -> None:
        """A whole page; plain markup in one regular expression, with the same results."""
        found = [] if _RAW.search(page) else _TAG.findall(page)
        if len(found) != page.count("<"):  # some bracket opens no plain tag
            self.feed(page)
            return self.close()
        for words, ended, started, attrs in found:  # words after the last tag belong to no closed cell
            if words:
                self.handle_data(unescape(words) if "&" in words else words)
            if ended:
                self.handle_endtag(ended.lower())
            else:
                self.handle_starttag(started.lower(), [(n.lower(), a or b or c) for n, a, b, c in _ATTRIBUTE.findall(attrs)] if attrs else [])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append((self.heading, []))
            self.classes.append(dict(attrs).get("class") or "")
            self.open.append(len(self.tables) - 1)
        elif tag == "tr" and self.open:
            self.tables[self.open[-1]][1].append((False, []))
        elif tag in ("td", "th") and self.open:
            rows = self.tables[self.open[-1]][1]
            if not rows:
                rows.append((False, []))
            rows[-1] = (rows[-1][0] or tag == "th", rows[-1][1])
            if not rows[-1][1] and "colspan" in dict(attrs):
                self.spanned.add((self.open[-1], len(rows) - 1))
            self.cell = []
        elif tag in ("h1", "h2", "h3", "h4", "h5", "caption"):
            self.title = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None and self.open:
            self.tables[self.open[-1]][1][-1][1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.open:
            self.open.pop()
        elif tag in ("h1", "h2", "h3", "h4", "h5", "caption") and self.title is not None:
            self.heading = " ".join("".join(self.title).split())
            self.title = None
            if tag == "caption" and self.open:
                self.tables[self.open[-1]] = (self.heading, self.tables[self.open[-1]][1])

    def handle_data(self, data: str) -> None:
        if self.title is not None:
            self.title.append(data)
        elif self.cell is not None:
            self.cell.append(data)


def _table_rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The table rows of batches of (key, page, part), in batches of OUT_ROWS: what a worker holds doesn't grow with its pages."""
    types = [pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.int32()]
    for batch in batches:
        of = [batch.schema.field(0).type, *types]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), of, strict=True)], names=names)  # noqa: B023, E731
        out: list[tuple] = []
        for k, page, p in zip(*batch.columns, strict=True):
            parser, k, p = _Tables(), k.as_py(), p.as_py()
            parser.read(page.as_py() or "")
            for t, (title, rows) in enumerate(parser.tables):
                for r, (is_header, values) in enumerate(rows):
                    if values:
                        out.append((k, t, r, is_header, title, values, parser.classes[t], (t, r) in parser.spanned, p))
                        if len(out) == OUT_ROWS:
                            yield made(out)
                            out = []
        if out:
            yield made(out)


def tables(pages: DataFrame, key: str = "page_id", html: str = "html", part: str | None = None) -> DataFrame:
    """Rows key, table_no, row_no, is_header, heading, cells, table_class, spanned (does the first cell span columns?): every
    table row of every page. `part` names an int column that tells the documents of a page apart (its frames) and goes along."""

    names = [key, "table_no", "row_no", "is_header", "heading", "cells", "table_class", "spanned", "__part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _table_rows(batches, names)

    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(key, html, (F.col(part) if part else F.lit(None)).cast("int").alias("__part")).mapInArrow(
        run, f"{key} {kind}, table_no int, row_no int, is_header boolean, heading string, cells array<string>, table_class string, spanned boolean, __part int"
    )
    return found.withColumnRenamed("__part", part) if part else found.drop("__part")


def header_score(cells: Column) -> Column:
    """How many wanted headers a row of cells names."""
    named = lambda low: sum((low.contains(h).cast("int") for h in BID_HEADERS), F.lit(0))
    return text.using(F.lower(F.concat_ws("\n", cells)), named)  # no header holds the line break


def _places(columns: Columns | None, headers: str) -> list[Column]:
    """`at`: where each of the columns stands under a table's headers, found once a table instead of once a row."""
    return [F.struct(*[place_in(names, headers).alias(c) for c, names in columns.items()]).alias("at")] if columns else []


def bid_tables(rows: DataFrame, key: str = "page_id", least: int = 3, columns: Columns | None = None) -> DataFrame:
    """Rows under the best header of each page, with `headers`: the table whose header names most wanted columns (the
    first among equals), if it names at least `least`. With `columns` also `at`, their places."""
    heads = rows.withColumn("score", header_score(F.col("cells"))).where(F.col("score") >= least)
    best = heads.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "table_no", F.col("row_no").alias("head_no"), F.col("cells").alias("headers"))).alias("b"))
    best = best.select(key, F.col("b.table_no").alias("__table"), "b.head_no", "b.headers", *_places(columns, "b.headers"))
    return rows.join(best, key).where((F.col("table_no") == F.col("__table")) & (F.col("row_no") > F.col("head_no"))).drop("head_no", "__table")


def titled_tables(rows: DataFrame, key: str = "page_id", part: str | None = None, table_class: str | None = None, least: int = 3, columns: Columns | None = None, parts: int | None = None) -> DataFrame:
    """Rows under the header of every data table, with `headers` and `place`: the title in force, read in document order.

    A table whose first row is one spanning cell without header words opens a section under that title; the section lasts
    over the tables that follow, and a table that also holds header words is data of its own section. Data tables before
    any title are places by their number. Tables without header words are neither. `table_class` keeps tables of that class.
    With `parts` the rows meet their page's tables in so many parts, dealt by key.
    """
    doc = [key, part] if part else [key]
    if table_class:
        rows = rows.where(F.array_contains(F.split("table_class", r"\s+"), table_class))
    names_header = lambda words: F.lower(words).rlike("|".join(TITLE_STOPS))
    shape = rows.groupBy(*doc, "table_no").agg(F.max(names_header(F.concat_ws(" ", "cells"))).alias("is_data"))
    text_ = F.get("cells", F.lit(0))
    titled = (F.col("row_no") == 0) & (F.size("cells") == 1) & F.col("spanned") & (text_ != "") & ~names_header(text_)
    titles = rows.where(titled).select(*doc, "table_no", text_.alias("title"))  # one row a titled table at most
    order = W.partitionBy(*doc).orderBy("table_no")
    place = F.last("title", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    named = shape.join(titles, [*doc, "table_no"], "left").withColumn("place", F.coalesce(place, F.concat(F.lit("Location_"), F.row_number().over(order).cast("string")))).where("is_data").select(*doc, "table_no", "place")
    heads = rows.withColumn("score", header_score(F.col("cells"))).where(F.col("score") >= least)
    heads = heads.groupBy(*doc, "table_no").agg(F.min(F.struct((-F.col("score")).alias("s"), "row_no", "cells")).alias("b"))
    heads = heads.select(*doc, "table_no", F.col("b.row_no").alias("head_no"), F.col("b.cells").alias("headers"), *_places(columns, "b.cells"))
    data = named.join(heads, [*doc, "table_no"])
    if parts:
        rows, data = rows.repartition(parts, key), data.repartition(parts, key)
    data = data.groupBy(key).agg(F.collect_list(F.struct(*[c for c in data.columns if c != key])).alias("__data"))  # the tables of a page
    mine = lambda t: reduce(lambda a, b: a & b, [t[c] == F.col(c) for c in (*doc[1:], "table_no")])
    rows = rows.join(data, key).select(*rows.columns, F.explode(F.filter("__data", mine)).alias("__t")).where(F.col("row_no") > F.col("__t.head_no"))
    return rows.select("*", "__t.place", "__t.headers", *(["__t.at"] if columns else [])).drop("__t")


def titled_bids(pages: DataFrame, key: str = "page_id", html: str = "html", part: str | None = None, table_class: str | None = TITLED_CLASS, source: str = "Agricharts") -> DataFrame:
    """Bids of pages whose tables stand in titled sections, in the wire columns: periods spelled in full, rows that are no bids
    left out, and of rows alike in place, crop, periods and futures price the first of the page (its frames in order)."""
    wanted = {c: names for c, names in _COMMON.items() if c != "Location"}
    cut = stored(tables(pages, key, html, part), "page-tables")
    rows = titled_tables(cut, key, part, table_class, columns=wanted, parts=parts_of(cut))
    found = rows.select(*([key, part] if part else [key]), "table_no", "row_no", "place", *_cells(wanted))
    found = without_spacers(found, cash="Bushel Cash Price").withColumnRenamed("place", "Location")
    found = found.withColumns({"Delivery": periods.short_month(F.col("Delivery")), "Delivery End": periods.short_month(F.col("Delivery End")), "Futures Month": periods.long_month(F.col("Futures Month")), "Source": F.lit(source)})
    same = W.partitionBy(key, "Location", "Name", "Delivery", "Delivery End", "Futures Month", "Futures Price").orderBy(*([part] if part else []), "table_no", "row_no")
    found = found.withColumn("__n", F.row_number().over(same)).where("__n = 1")
    cash = prices.tick_price(F.col("Bushel Cash Price"))
    return found.withColumn("MT Cash Price", F.coalesce("MT Cash Price", prices.adapter_per_tonne(F.col("Name"), cash.cast("double")).cast("string"))).select(key, *BID_COLUMNS)


def keyword_tables(rows: DataFrame, key: str = "page_id", least_cells: int = 3, columns: Columns | None = None) -> DataFrame:
    """Rows under the first row of each page's most bid-like table, with `headers`: the table whose text holds most bid
    words (the first among equals), if any row has `least_cells` cells. For pages whose headers name no wanted column."""
    words = F.lower(F.concat_ws(" ", "cells"))
    held = [F.max(words.contains(w).cast("int")) for w in BID_KEYWORDS]
    scored = rows.groupBy(key, "table_no").agg(sum(held[1:], held[0]).alias("score"), F.max(F.size("cells")).alias("width"), F.min(F.struct("row_no", "cells")).alias("head")).where((F.col("width") >= least_cells) & (F.col("score") > 0))
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "table_no", "head")).alias("b")).select(key, F.col("b.table_no").alias("__table"), F.col("b.head.row_no").alias("head_no"), F.col("b.head.cells").alias("headers"), *_places(columns, "b.head.cells"))
    return rows.join(best, key).where((F.col("table_no") == F.col("__table")) & (F.col("row_no") > F.col("head_no"))).drop("head_no", "__table")


def bid_or_keyword_tables(rows: DataFrame, key: str = "page_id", columns: Columns | None = None) -> DataFrame:
    """Tables by their header; pages without one by the bid words of their tables."""
    found = bid_tables(rows, key, columns=columns)
    rest = rows.join(found.select(key).distinct(), key, "left_anti")
    return found.unionByName(keyword_tables(rest, key, columns=columns), allowMissingColumns=True)


def merged_header_tables(rows: DataFrame, key: str = "page_id", least: int = 3, columns: Columns | None = None) -> DataFrame:
    """Rows under headers that run over several rows, with `headers`: the header cells at the table's top (else its first
    two rows) are joined column by column, and the table whose joined header names most wanted columns is taken."""
    table_of = [key, "table_no"]
    first = rows.groupBy(*table_of).agg(F.min(F.when(~F.col("is_header"), F.col("row_no"))).alias("body"), F.min("row_no").alias("top"), F.max("row_no").alias("end"))
    head_end = F.when(F.col("body") == F.col("top"), F.col("top") + 2).otherwise(F.coalesce("body", F.col("end") + 1))
    ends = first.select(*table_of, head_end.alias("head_end"))
    tops = rows.join(ends, table_of).where(F.col("row_no") < F.col("head_end"))
    stacked = tops.groupBy(*table_of, "head_end").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda x: x.cells).alias("stack"))  # a few header rows a table
    width = F.array_max(F.transform("stack", lambda c: F.size(c)))
    joined = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.array_join(F.filter(F.transform("stack", lambda c: F.trim(F.coalesce(F.get(c, i), F.lit("")))), lambda x: x != ""), " "))
    heads = stacked.select(*table_of, "head_end", joined.alias("headers")).withColumn("score", header_score(F.col("headers"))).where(F.col("score") >= least)
    best = heads.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "table_no", "head_end", "headers")).alias("b"))
    best = best.select(key, F.col("b.table_no").alias("__table"), "b.head_end", "b.headers", *_places(columns, "b.headers"))
    return rows.join(best, key).where((F.col("table_no") == F.col("__table")) & (F.col("row_no") >= F.col("head_end"))).drop("head_end", "__table")


def cells_by_place(rows: DataFrame, key: str = "page_id", least: int = 8) -> DataFrame:
    """Rows of tables whose columns are known by place alone (CELLS_BY_PLACE): each table's first row is its header; rows
    of fewer cells, and those without a cash price, tonne price and futures price, are no bids. The heading names the crop."""
    first = rows.groupBy(key, "table_no").agg(F.min("row_no").alias("head_no"))
    body = rows.join(first, [key, "table_no"]).where((F.col("row_no") > F.col("head_no")) & (F.size("cells") >= least))
    named = body.select(key, "table_no", "row_no", F.coalesce(F.nullif("heading", F.lit("")), F.lit("LAC Cash Bid")).alias("Name"), *[F.trim(F.get("cells", F.lit(i))).alias(c) for i, c in enumerate(CELLS_BY_PLACE)])
    return named.where(F.concat("Bushel Cash Price", "MT Cash Price", "Futures Price") != "")


def without_spacers(df: DataFrame, name: str = "Name", cash: str = "Cash Price", futures: str = "Futures Price") -> DataFrame:
    """Rows that repeat the header or hold no price leave: a name is needed, and a cash or futures price that looks like one."""
    cell_of = lambda c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    return df.where((cell_of(name) != "") & (F.lower(cell_of(name)) != "name") & (cell_of(cash).rlike(CASH_CELL) | cell_of(futures).rlike(FUTURES_CELL)))


def place_in(names: Sequence[str], headers: str = "headers") -> Column:
    """Place (from 0) of the first header that equals one of the names, else of the first that contains one; null for none."""
    low = F.transform(headers, lambda h: F.trim(F.rtrim(F.lower(h), F.lit("* "))))
    found = [F.nullif(F.array_position(low, n.lower()), F.lit(0)) for n in names]
    holding = lambda name: F.transform(low, lambda h: h.contains(name.lower()))
    partly = [F.nullif(F.array_position(holding(n), True), F.lit(0)) for n in names]
    return (F.coalesce(*found, *partly) - 1).cast("int")


def cell(names: Sequence[str], headers: str = "headers", cells: str = "cells") -> Column:
    """Cell under a column's place; null for none."""
    return F.get(cells, place_in(names, headers))


def _cells(columns: Columns) -> list[Column]:
    """The columns' cells by `at`; null for blank ones."""
    return [F.nullif(F.trim(F.get("cells", F.col(f"at.`{c}`"))), F.lit("")).alias(c) for c in columns]


def crop_in(words: Column) -> Column:
    """Crop that a heading or cell names."""
    out = F.lit(None).cast("string")
    for word, crop in reversed(CROP_WORDS.items()):
        out = F.when(F.lower(words).contains(word), crop).otherwise(out)
    return out


def crop_of_symbol(symbol: Column) -> Column:
    """Crop of a futures code: its first letters, after a leading Z or at-sign."""
    code = F.upper(F.regexp_replace(symbol, r"^@?Z?", ""))
    return F.when(code.startswith("S"), "Soybeans").when(code.startswith("C"), "Corn").when(code.startswith("W"), "Wheat")


@dataclass(frozen=True)
class Adapter:
    """How one kind of page is read: names of each column, the source's name, and what must be there for a row to count."""

    source: str
    columns: Mapping[str, Sequence[str]] = field(default_factory=dict)
    required: Sequence[str] = ("Delivery",)
    crop: str = "name"  # "name": the Name cell; "heading": the heading above the table; "symbol": the futures code; "place": the table's place on the page
    transposed: bool = False  # one row a metric and one column a period
    tables: str = "header"  # "header": the best header row; "merged": headers over several rows; "keywords": else the most bid-like table
    last_literal: bool = False  # price cells hold several numbers, the last one counts


_COMMON = {
    "Location": ("location", "elevator"),
    "Name": ("name", "commodity", "crop"),
    "Delivery": ("delivery", "delivery label", "delivery start"),
    "Delivery End": ("delivery end", "end"),
    "Futures Month": ("futures month", "futures symbol", "symbol", "month", "futures mon"),
    "Futures Price": ("futures price", "futures", "cbot futures"),
    "Change": ("change", "chg"),
    "Basis": ("basis",),
    "Bushel Cash Price": ("bushel cash price", "cash price", "cash"),
    "MT Cash Price": ("mt cash price", "cash price (tonne)", "price / (tonnes)", "tonne"),
}

# Words of the row labels of a transposed table (the first that a label contains), and the texts by which
# pages' scripts write quotes and bids.
_METRICS = {
    "Futures Month": ("futures month",),
    "Change": ("futures change", "change"),
    "MT Cash Price": ("converted price",),
    "Basis": ("basis",),
    "Bushel Cash Price": ("cash price", "cdn cash"),
    "Futures Price": ("futures price", "futures"),
}

_CALL = (
    r"writeBidRow\s*\(\s*'([^']+)'\s*,\s*([+-]?\d+(?:\.\d+)?)\s*,\s*(?:true|false)\s*,\s*(?:true|false)\s*,\s*(?:true|false)\s*,\s*[+-]?[\d.]*\s*,\s*'(\d{2}/\d{2}/\d{4})'\s*,\s*'(\d{2}/\d{2}/\d{4})'"
    r"\s*,\s*'[^']*'\s*,\s*'[^']*'\s*,\s*'[^']*'\s*,\s*\d+\s*,\s*'[^']*'\s*,\s*'[^']*'\s*,\s*(?:quotes|quotevar\w+)\['([A-Z0-9]+)'\]"
)
QUOTE_BLOCK = r"(['\"][A-Z0-9]+['\"]\s*:\s*\{[^}]+\})"
QUOTE_SYMBOL = r"['\"]([A-Z0-9]+)['\"]"
BID_BLOCK = r"(quote\s*=\s*quotevar\w+\[['\"][A-Z0-9]+['\"]\](?:(?!quote\s*=\s*quotevar)[\s\S])*)"
BID_SYMBOL = r"quotevar\w+\[['\"]([A-Z0-9]+)['\"]\]"
BASIS_CENTS = r"rounded\s*=\s*price\s*\+\s*\(?([+-]?\d+(?:\.\d+)?)\b"
BASIS_DOLLARS = r"(?i)(?:var\s+\w*basis\w*\s*=|addBasis\s*=|basis\s*[=:]|basisadj\s*=)\s*([+-]?\d+\.?\d*)"
CHART_DELIVERY = r"cashchart\.php\?c=\d+&(?:amp;)?l=\d+&(?:amp;)?d=([A-Z]\d{2})"
# End of fixed values.

#: Adapters by key. Pages that differ only in wording share one reader.
ADAPTERS: dict[str, Adapter] = {
    "agricharts": Adapter("Agricharts", _COMMON, ("Delivery", "Basis")),
    "andersons": Adapter("The Andersons", {}, ("Delivery",), "place", True),
    "bunge": Adapter("Bunge", _COMMON, ("Delivery",), "heading", tables="keywords"),
    "dg_global": Adapter("DG Global", _COMMON, ("Delivery",)),
    "glg": Adapter("GLG", _COMMON, ("Futures Month",), "symbol", tables="merged"),
    "hensall": Adapter("Hensall", _COMMON, ("Delivery", "Basis")),
    "lac": Adapter("LAC", _COMMON, ("Delivery",), "symbol", last_literal=True),
    "snobelen": Adapter("Snobelen", {}, ("Delivery",), "heading", True),
    "wanstead": Adapter("Wanstead", _COMMON, ("Delivery", "Basis"), "heading"),
    "us_dtn": Adapter("US DTN", _COMMON, ("Delivery", "Basis")),
}


def adapter(name: str) -> Adapter:
    """The adapter of a key; an unknown key is an error that names the known ones."""
    if name not in ADAPTERS:
        raise KeyError(f"unknown adapter {name!r}; known: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name]


def transposed_bids(rows: DataFrame, by_place: bool, key: str = "page_id") -> DataFrame:
    """Bids of tables with one row a metric and one column a period (named in the first row): one row a period.

    Only tables with a futures-month row count. Their crop is the one of their heading, or with `by_place` that of their
    place among the page's tables; tables beyond the known places go. A label means the most telling metric it contains
    ("Futures Change" is a change, not a price), and the first row of a metric stands for it.
    """
    label = F.lower(F.get("cells", F.lit(0)))
    metric = F.lit(None).cast("string")
    for name, words in reversed(_METRICS.items()):
        for w in words:
            metric = F.when(label.contains(w), name).otherwise(metric)
    table_of = [key, "table_no"]
    lines = F.array_sort(F.collect_list(F.struct("row_no", metric.alias("metric"), "cells", label.contains("futures month").alias("counts"))))  # the rows of a table, a line a metric
    table = rows.groupBy(table_of).agg(F.max("heading").alias("heading"), lines.alias("lines"))
    table = table.where(F.exists("lines", lambda x: x.counts)).withColumns({"periods": F.get("lines", F.lit(0)).cells, "lines": F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))}).where(F.size("periods") > 1)
    if by_place:
        place = F.row_number().over(W.partitionBy(key).orderBy("table_no"))
        table = table.withColumn("crop", F.get(F.array(*map(F.lit, CROPS_BY_PLACE)), place - 1)).where("crop is not null")
    else:
        table = table.withColumn("crop", F.coalesce(crop_in(F.col("heading")), F.nullif("heading", F.lit(""))))
    width = F.least(F.size("periods"), F.array_max(F.transform("lines", lambda x: F.size(x.cells))))  # null without lines
    out = table.where(width > 1).select(*table_of, "periods", "crop", "lines", F.explode(F.sequence(F.lit(0), width - 2)).alias("at"))
    at = F.col("at") + 1
    first = lambda m: F.get(F.filter("lines", lambda x: (x.metric == m) & (F.size(x.cells) > at)), F.lit(0)).cells
    value = lambda cells: F.nullif(F.trim(F.get(cells, at)), F.lit(""))
    none = F.lit(None).cast("string")
    return out.select(*table_of, F.col("at").alias("row_no"), F.col("crop").alias("Name"), value("periods").alias("Delivery"), none.alias("Location"), none.alias("Delivery End"), *[value(first(m)).alias(m) for m in _METRICS])


def page_bids(pages: DataFrame, name: str, key: str = "page_id", html: str = "html", place: str | None = None) -> DataFrame:
    """Bid rows of an adapter's pages in the wire columns (all text); repeats of a row's identity go, the first stays.

    `place` names a column of the pages that stands in where a row names no location.
    """
    how = adapter(name)
    cut = tables(pages, key, html)
    if how.transposed:
        found = transposed_bids(cut, how.crop == "place", key)  # reads the rows once
    else:
        cut = dealt_by(stored(cut, "page-tables"), key)  # read several times, cut once
        rows = {"header": bid_tables, "merged": merged_header_tables, "keywords": bid_or_keyword_tables}[how.tables](cut, key, columns=how.columns)
        found = rows.select(key, "table_no", "row_no", "heading", *_cells(how.columns))
        own = text.canonical_commodity(F.col("Name"))
        crop = {"name": own, "heading": F.coalesce(crop_in(F.col("heading")), own), "symbol": crop_of_symbol(F.col("Futures Month"))}[how.crop]
        found = found.withColumn("Name", F.coalesce(crop, own))
    if how.last_literal:
        found = found.withColumns({c: F.coalesce(prices.last_number(F.col(c)), F.col(c)) for c in ("Futures Price", "Bushel Cash Price", "MT Cash Price", "Basis")})
    if place:
        found = found.join(pages.select(key, F.col(place).alias("__place")), key).withColumn("Location", F.coalesce("Location", "__place"))
    found = found.withColumn("Source", F.lit(how.source))
    cash = prices.tick_price(F.col("Bushel Cash Price"))
    found = found.withColumn("MT Cash Price", F.coalesce("MT Cash Price", prices.adapter_per_tonne(F.col("Name"), cash.cast("double")).cast("string")))
    for c in how.required:
        found = found.where(F.col(f"`{c}`").isNotNull() & ~F.lower(f"`{c}`").isin(c.lower()))
    same = W.partitionBy(key, "Location", "Name", "Delivery", "Delivery End", "Futures Month").orderBy("table_no", "row_no")
    return found.withColumn("__n", F.row_number().over(same)).where("__n = 1").select(key, *BID_COLUMNS)


def quotes(script: Column) -> Column:
    """Array of (symbol, name, month, last) of a script's quote object: 'SYM': {name: '...', month: '...', last: '...'}."""
    blocks = F.regexp_extract_all(script, F.lit(QUOTE_BLOCK), F.lit(1))
    get = lambda b, f: F.nullif(F.regexp_extract(b, rf"\b{f}\s*:\s*'([^']*)'", 1), F.lit(""))
    return F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, QUOTE_SYMBOL, 1).alias("symbol"), get(b, "name").alias("name"), get(b, "month").alias("month"), get(b, "last").alias("last")))


def script_bids(pages: DataFrame, quote_rows: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Bids that a page's script computes per quote: one row for each `quote = quotevarX['SYM']` block.

    Basis is the number added to the price (cents) or a basis variable (dollars); the delivery is a code in the chart
    link. Cash is futures plus basis.
    """
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(BID_BLOCK), F.lit(1))).alias("position", "block"))
    got = lambda pattern, group=1: F.nullif(F.regexp_extract("block", pattern, group), F.lit(""))
    cents = got(BASIS_CENTS).try_cast("double") / 100
    dollars = got(BASIS_DOLLARS).try_cast("double")
    rows = rows.select(key, "position", got(BID_SYMBOL).alias("symbol"), periods.delivery_code(got(CHART_DELIVERY)).alias("delivery"), F.coalesce(cents, dollars).alias("basis"))
    rows = rows.join(quote_rows, "symbol")
    return _priced(rows)


def quotes_alone(pages: DataFrame, bids: DataFrame, quote_rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows of quotes without basis and cash, for pages whose script gave no bid: delivery and futures month are the
    quote's. `quote_rows` carries the page's key."""
    rest = pages.select(key).join(bids.select(key).distinct(), key, "left_anti")
    month = periods.quoted_month(F.col("month"))
    return quote_rows.join(rest, key, "left_semi").select(key, "symbol", F.initcap("name").alias("name"), month.alias("delivery"), month.alias("futures_month"), (prices.quoted_cents(F.col("last")) / 100).alias("futures_price"))


def _priced(rows: DataFrame) -> DataFrame:
    futures = prices.quoted_cents(F.col("last")) / 100
    rows = rows.withColumns({"futures_price": futures, "futures_month": periods.quoted_month(F.col("month")), "cash_price_bu": F.bround(futures + F.col("basis"), 4)})
    return rows.withColumn("cash_price_mt", prices.adapter_per_tonne(F.col("name"), F.col("cash_price_bu")))


def call_bids(pages: DataFrame, quote_rows: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Bids that a page writes by calls of writeBidRow, each under the last heading before it, with its quote."""
    marks = F.regexp_extract_all(F.col(html), F.lit(rf"(?i)(<h4[^>]*>[^<]+</h4>|{_CALL})"), F.lit(1))
    rows = pages.select(key, F.posexplode(marks).alias("position", "mark"))
    rows = rows.withColumn("place", F.when(F.col("mark").startswith("<"), text.strip_html(F.col("mark"))))
    now = W.partitionBy(key).orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("location", F.last("place", ignorenulls=True).over(now)).where("place is null")
    got = lambda group: F.regexp_extract("mark", _CALL, group)
    rows = rows.select(
        key, "position", "location", got(1).alias("name"), (got(2).try_cast("double") / 100).alias("basis"), F.try_to_date(got(3), "MM/dd/yyyy").alias("delivery_start"), F.try_to_date(got(4), "MM/dd/yyyy").alias("delivery_end"), got(5).alias("symbol")
    )
    rows = rows.join(quote_rows.select("symbol", "month", "last"), "symbol", "left")
    futures = prices.quoted_cents(F.col("last")) / 100
    return rows.withColumns({"futures_month": periods.quoted_month(F.col("month")), "futures_price": futures, "cash_price_bu": F.bround(futures + F.col("basis"), 4)})


def options(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Values and labels of the options of a page's selects: the places a page can show. Crop choices leave."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?i)(<option[^>]*>[^<]*)"), F.lit(1))
    rows = pages.select(key, F.posexplode(tags).alias("position", "tag"))
    rows = rows.select(key, "position", F.regexp_extract("tag", r"(?i)value\s*=\s*[\"']([^\"']*)", 1).alias("value"), F.trim(F.regexp_extract("tag", r">([^<]*)$", 1)).alias("label"))
    return rows.where((F.col("label") != "") & ~F.lower("label").rlike("^(corn|soybeans?|wheat)$"))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Links of a page in order, each address once: key, position (of the first), href."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r'(?i)href="([^"]*)"'), F.lit(1))).alias("position", "href"))
    return rows.groupBy(key, "href").agg(F.min("position").alias("position"))


def page_kind(html: Column) -> Column:
    """Which reader a bid page needs."""
    return (
        F.when(html.rlike(r"writeBidRow\s*\("), "script_calls")
        .when(html.rlike(r"quotevar\w+\["), "script_quotes")
        .when(html.rlike(r"(?i)class=[\"'][^\"']*dtn"), "widget_table")
        .when(html.rlike(r"(?i)<table"), "table")
        .otherwise("unknown")
    )
