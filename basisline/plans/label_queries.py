"""Queries of labels, periods, prices and cells. Their oracles read the same texts with expressions of their own.

Labels are dealt over a whole table by its key, so every row has one; each list holds spellings that take every branch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.functions import keys, periods, prices, text
from basisline.operators import market
from basisline.operators.sizes import by_distinct
from basisline.plans.queries import query, table


def dealt(labels: Sequence[str | None], key: str) -> Column:
    """One of the labels for each row, by its key."""
    return F.get(F.array(*[F.lit(x) for x in labels]), (F.col(key) % len(labels)).cast("int"))


def _q(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def dealt_sql(labels: Sequence[str | None], key: str) -> str:
    return f"[{', '.join(map(_q, labels))}][CAST({key} % {len(labels)} AS INT) + 1]"


def values_sql(table_: Mapping[str, str]) -> str:
    return "(VALUES " + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in table_.items()) + ")"


def in_sql(words: Sequence[str]) -> str:
    return "(" + ", ".join(map(_q, words)) + ")"


def clean_sql(x: str) -> str:
    """Trimmed text with single blanks, NULL for empty and null-like ones."""
    c = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN {c} <> '' AND lower({c}) NOT IN {in_sql(text.NULL_LIKE)} THEN {c} END"


# ---------------------------------------------------------------- sources, crops, places

SOURCES = [*[a.upper() for a in text.SOURCE_ALIASES], *[f"  {a.title()} ".replace(" ", "  ") for a in text.SOURCE_ALIASES], "N/A", "", " - ", None, "Some  Elevator", "AGRICHARTS "]
_ALIASES = f"a(k, v) AS {values_sql(text.SOURCE_ALIASES).replace('(VALUES', '(VALUES')}, g(k, region) AS {values_sql(text.REGION_OF_SOURCE)}"


@query(
    f"""WITH {_ALIASES}, l AS (SELECT c_custkey, {dealt_sql(SOURCES, 'c_custkey')} AS raw FROM customer), m AS (SELECT c_custkey, {clean_sql('raw')} AS clean FROM l),
 s AS (SELECT m.*, coalesce(a.v, clean) AS source FROM m LEFT JOIN a ON a.k = lower(clean)), r AS (SELECT s.*, g.region, source IS NOT NULL AND g.region IS NULL AND lower(source) NOT IN {in_sql(text.AGGREGATORS)} AS own FROM s LEFT JOIN g ON g.k = lower(source))
 SELECT c_custkey, lower(clean) AS label_key, source, region, own AS creates_company, CASE WHEN own THEN source END AS trusted, CASE WHEN NOT own THEN source END AS attribution, coalesce(region = 'Ontario', false) AS in_ontario FROM r"""
)
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source alias in two spellings: canonical name, scope, who names its own company, attribution, region."""
    raw = F.col("raw")
    scope = text.source_scope(raw)
    c = table(spark, sf_dir, "customer").select("c_custkey", dealt(SOURCES, "c_custkey").alias("raw"))
    return by_distinct(
        c,
        ["raw"],
        label_key=text.canonical_key(raw),
        source=text.canonical_source(raw),
        region=F.when(scope.scope == "region", scope.label),
        creates_company=text.creates_company(raw),
        trusted=text.trusted_company(raw),
        attribution=text.attribution(raw),
        in_ontario=market.in_region(raw, "ontario"),
    ).drop("raw")


CROPS = ["corn", "WHITE  corn", " soybean", "Soybeans", "winter WHEAT", "Ontario Daily File", "mixed daily file", "my cash bids list", "Source Sheet 3", "GLG", "glg ", None, "n/a", ""]


@query(
    f"""WITH a(k, v) AS {values_sql(text.COMMODITY_ALIASES)}, l AS (SELECT o_orderkey, {dealt_sql(CROPS, 'o_orderkey')} AS raw FROM orders), m AS (SELECT o_orderkey, {clean_sql('raw')} AS clean FROM l)
 SELECT o_orderkey, coalesce(a.v, clean) AS crop, coalesce(a.v, array_to_string(list_transform(string_split(lower(clean), ' '), lambda w: upper(w[1]) || w[2:]), ' ')) AS shown,
 coalesce(lower(clean) IN {in_sql(text.INVALID_COMMODITIES)} OR {' OR '.join(f"contains(lower(clean), {_q(t)})" for t in text.INVALID_COMMODITY_TOKENS)} OR lower(clean) = 'glg', false) AS invalid,
 coalesce(lower(trim(l.raw)) NOT IN {in_sql(text.HIDDEN_COMMODITIES)}, false) AS visible FROM m JOIN l USING (o_orderkey) LEFT JOIN a ON a.k = lower(clean)"""
)
def commodity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop labels: canonical and display names, labels that name a file or their source, hidden ones."""
    raw = F.col("raw")
    o = table(spark, sf_dir, "orders").select("o_orderkey", dealt(CROPS, "o_orderkey").alias("raw"))
    return by_distinct(o, ["raw"], crop=text.canonical_commodity(raw), shown=text.display_commodity(raw), invalid=text.invalid_commodity(raw, F.lit("GLG")), visible=market.shown_commodity(raw)).drop("raw")


PLACES = ["Toledo  Soybeans", "starffordville", "Any Dover Branch", "Any  Port Lambton Branch Corn", "Prescott (Transfer)", "Ridgetown/ West", "Blenheim Wet Corn", "Embrun Co-op, GLG", "Johnstown Ethanol", "Ingredion  Cardinal", "-", "Talbotville Milo", "Staffordville soybean", "Elgin, The Andersons", None]
ROW_COMPANIES = ["Some Co", "Agricharts", "GLG", None]
PLACE_COMPANIES = ["LAC", None, "Ontario Cash Bids"]
ROW_SOURCES = ["Agricharts", "snobelen", "ontario daily file", "Wanstead", ""]


def _trusted_sql(name: str) -> str:
    """Joins and value of a trusted company column `name`."""
    return f"LEFT JOIN a a_{name} ON a_{name}.k = lower({name}_c) LEFT JOIN g g_{name} ON g_{name}.k = lower(coalesce(a_{name}.v, {name}_c))"


def _trusted_value(name: str) -> str:
    v = f"coalesce(a_{name}.v, {name}_c)"
    return f"CASE WHEN g_{name}.k IS NULL AND lower({v}) NOT IN {in_sql(text.AGGREGATORS)} THEN {v} END"


@query(
    rf"""WITH {_ALIASES}, p(k, v) AS {values_sql(text.LOCATION_ALIASES)}, o(k, v) AS {values_sql(text.LOCATION_COMPANY)},
 l AS (SELECT c_custkey, {dealt_sql(PLACES, 'c_custkey')} AS raw, {clean_sql(dealt_sql(ROW_COMPANIES, 'c_custkey'))} AS row_c, {clean_sql(dealt_sql(PLACE_COMPANIES, 'c_custkey'))} AS loc_c, {clean_sql(dealt_sql(ROW_SOURCES, 'c_custkey'))} AS src_c FROM customer),
 s1 AS (SELECT *, trim(regexp_replace({clean_sql('raw')}, '\s*/\s*', ' / ', 'g')) AS p1 FROM l),
 s2 AS (SELECT *, CASE WHEN regexp_matches(p1, '(?i)\bwet\s+corn$') THEN p1 ELSE trim(regexp_replace(p1, '(?i)\s+(corn|soybeans?|wheat|barley|oats|milo)$', '')) END AS p2 FROM s1),
 s3 AS (SELECT *, trim(regexp_replace(p2, '(?i),\s*(glg|g\.l\.g\.|agricharts|andersons|the andersons|hensall|snobelen|wanstead)$', '')) AS p3 FROM s2),
 s4 AS (SELECT *, {clean_sql("regexp_replace(p3, '(?i)^any\\s+(.+?)\\s+branch$', '\\1 Branch')")} AS p4 FROM s3),
 s5 AS (SELECT s4.*, coalesce(p.v, p4) AS location FROM s4 LEFT JOIN p ON p.k = lower(p4))
 SELECT c_custkey, location, coalesce(o.v, {_trusted_value('row')}, {_trusted_value('loc')}, {_trusted_value('src')}) AS company FROM s5 LEFT JOIN o ON o.k = lower(location) {_trusted_sql('row')} {_trusted_sql('loc')} {_trusted_sql('src')}"""
)
def place_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place labels cleaned, and the company shown: fixed by the place, else of the row, the place or the source."""
    c = table(spark, sf_dir, "customer").select("c_custkey", dealt(PLACES, "c_custkey").alias("raw"), *[dealt(x, "c_custkey").alias(n) for n, x in (("row", ROW_COMPANIES), ("loc", PLACE_COMPANIES), ("src", ROW_SOURCES))])
    company = text.display_company(F.col("raw"), F.col("row"), F.col("loc"), F.col("src"))
    return by_distinct(c, ["raw", "row", "loc", "src"], location=text.canonical_location(F.col("raw")), company=company).select("c_custkey", "location", "company")


# ---------------------------------------------------------------- prices

PRICE_CELLS = ["ZCN26 @ 6.34", "456'6", "456-6s", "425-4", "12'34", "$1,234.50", "n/a", "1200", "1201", "@ 5 and $7", "3 then 4.25", "-5'2", "4.5-6", "", None, "12.5c", "425.25", " 49.5 ", "50"]


def tick_sql(x: str) -> str:
    t = f"regexp_replace(trim({x}), '([0-9])[A-Za-z]+$', '\\1')"
    whole, part = (f"regexp_extract({t}, '^(-?\\d+)\\s*[''-]\\s*(\\d+)$', {g})" for g in (1, 2))
    return (
        f"CASE WHEN regexp_matches({part}, '^[0-7]$') THEN TRY_CAST({whole} AS DOUBLE) + TRY_CAST({part} AS DOUBLE) / 8 WHEN {part} <> '' THEN TRY_CAST({whole} || '.' || {part} AS DOUBLE) "
        f"ELSE CAST(TRY_CAST(regexp_replace({t}, '[,$]', '', 'g') AS DECIMAL(18, 6)) AS DOUBLE) END"
    )


_CENTS = "CASE WHEN regexp_matches(trim(raw), '^(\\d+(?:\\.\\d+)?)(?:-(\\d+))?$') THEN TRY_CAST(regexp_extract(trim(raw), '^(\\d+(?:\\.\\d+)?)(?:-(\\d+))?$', 1) AS DOUBLE) + coalesce(TRY_CAST(nullif(regexp_extract(trim(raw), '^(\\d+(?:\\.\\d+)?)(?:-(\\d+))?$', 2), '') AS DOUBLE), 0) / 8 END"


@query(
    rf"""WITH l AS (SELECT p_partkey, {dealt_sql(PRICE_CELLS, 'p_partkey')} AS raw FROM part), t AS (SELECT *, replace(trim(raw), ',', '') AS t, regexp_replace(trim(raw), '[$,]', '', 'g') AS plain FROM l)
 SELECT p_partkey, {tick_sql('raw')} AS tick,
 coalesce({tick_sql("regexp_extract_all(t, '-?[0-9]+\\s*[''-]\\s*[0-9]+[A-Za-z]*')[-1]")}, TRY_CAST(regexp_extract_all(t, '-?\d+\.\d+')[-1] AS DOUBLE), CASE WHEN regexp_matches(t, '^-?\d+(?:\.\d+)?$') AND abs(TRY_CAST(t AS DOUBLE)) <= 1200 THEN TRY_CAST(t AS DOUBLE) END,
 TRY_CAST(regexp_extract_all(t, '(?:@|\$)\s*(-?\d+(?:\.\d+)?)', 1)[-1] AS DOUBLE)) AS in_text, TRY_CAST(regexp_replace(translate(raw, '''-', '..'), '[^0-9.]', '', 'g') AS DOUBLE) AS lenient, {_CENTS} AS cents,
 CASE WHEN regexp_matches(plain, '^\d+(-\d+)?$') THEN {_CENTS.replace('trim(raw)', 'plain')} / 100 WHEN TRY_CAST(plain AS DOUBLE) < 50 THEN TRY_CAST(plain AS DOUBLE) ELSE TRY_CAST(plain AS DOUBLE) / 100 END AS dollars,
 regexp_extract_all(raw, '-?\d+(?:\.\d+)?')[-1] AS last_literal, CAST(TRY_CAST(regexp_replace(raw, '[^0-9.\-]', '', 'g') AS DECIMAL(18, 6)) AS DOUBLE) AS amount FROM t"""
)
def price_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of a price cell: ticks, prices in free text, lenient numbers, quotes in cents and dollars, last literals."""
    raw = F.col("raw")
    p = table(spark, sf_dir, "part").select("p_partkey", dealt(PRICE_CELLS, "p_partkey").alias("raw"))
    return by_distinct(
        p,
        ["raw"],
        tick=prices.tick_price(raw).cast("double"),
        in_text=prices.price_in_text(raw).cast("double"),
        lenient=prices.lenient_number(raw),
        cents=prices.quoted_cents(raw),
        dollars=prices.dollars_per_bushel(raw),
        last_literal=prices.last_number(raw),
        amount=prices.money(raw).cast("double"),
    ).drop("raw")


ADAPTER_CROPS = ["Yellow Corn", "SOYBEANS", "soy meal", "Wheat", None]


@query(
    f"""WITH l AS (SELECT p_partkey, p_retailprice AS p, lower({dealt_sql(ADAPTER_CROPS, 'p_partkey')}) AS crop FROM part)
 SELECT p_partkey, round_even(CASE WHEN crop LIKE '%soy%' THEN p * 36.7437 WHEN crop LIKE '%corn%' THEN p * 39.3683 END, 2) AS tonne, CASE WHEN p_partkey % 4 = 0 THEN 'n/a' ELSE printf('$%.2f/bu', p) END AS cash_text,
 CASE WHEN p_partkey % 4 = 1 THEN 'n/a' ELSE printf('%+.2f/bu', p - 1000) END AS basis_text, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p END AS finite_price, CASE WHEN p >= 10 THEN p / 100 ELSE p END AS shown_basis FROM l"""
)
def price_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tonne prices of the adapters' crops, prices as text, and infinite ones as missing."""
    p, k = F.col("p_retailprice"), F.col("p_partkey")
    odd = F.when(k % 3 == 0, F.when(k % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(p)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        prices.adapter_per_tonne(dealt(ADAPTER_CROPS, "p_partkey"), p).alias("tonne"),
        prices.show_cash(F.when(k % 4 != 0, p)).alias("cash_text"),
        prices.show_basis(F.when(k % 4 != 1, p - 1000)).alias("basis_text"),
        prices.finite(odd).alias("finite_price"),
        prices.basis_to_show(p).alias("shown_basis"),
    )


# ---------------------------------------------------------------- periods

PERIODS = ["May 31, 2026", "may 3rd 2026", "May-26", "Sept/2027", "May 31", "May 45", "Harvest 26", "harvest", "Harvest 2027 crop", "N26", "zc6", "Dec", "DECEMBER 1999", "Old crop 2025", "  June   2026 ", "jul 2026 new", "spot", "n/a", None, "March 126", "Oct 5", "FSH27", "Kc4", "Feb26"]
_ABBR = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"
_FULL_NAMES = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December']"
_WORDS = "january|february|march|april|may|june|july|august|september|october|november|december|sept|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"


def _month_sql(name: str) -> str:
    """1 to 12 of a month's name, its three letters or 'sept'; NULL for other words."""
    low = f"lower({name})"
    return f"CASE WHEN {low} IN {in_sql(_WORDS.split('|'))} THEN list_position({_ABBR}, left({low}, 3)) END"


def _year_sql(token: str) -> str:
    return f"CASE WHEN TRY_CAST({token} AS INT) < 100 THEN TRY_CAST({token} AS INT) + 2000 ELSE TRY_CAST({token} AS INT) END"


def _part_sql(x: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


def _harvest_and_code(t: str) -> tuple[str, str]:
    harvest = f"{_year_sql(_part_sql(t, '\\bharvest\\b[^0-9]*(\\d{2,4})?', 1))} * 12 + 10"
    code = "\\b([fghjkmnquvxz])(?:c|s|w)?(\\d{1,2})\\b"
    return harvest, f"{_year_sql(_part_sql(t, code, 2))} * 12 + position({_part_sql(t, code, 1)} IN 'fghjkmnquvxz')"


def month_key_sql(t: str) -> str:
    """Month key of a cleaned, lower-cased label `t`, from its text. No label here has a day and year right after '-'."""
    dated = f"\\b({_WORDS})\\b\\s+(\\d{{1,2}})(?:st|nd|rd|th)?(?:\\s*,\\s*|\\s+)(\\d{{4}})\\b"
    short = f"\\b({_WORDS})\\b\\s*([-/\\s])\\s*(\\d{{2,4}})\\b"
    named = f"\\b({_WORDS})\\b[^0-9]*(\\d{{2,4}})?"
    digits = f"regexp_extract({t}, '{short}', 3)"
    day_like = f"(regexp_matches(regexp_extract({t}, '{short}', 2), '^\\s$') AND length({digits}) <= 2 AND TRY_CAST({digits} AS INT) <= 31)"
    token = _part_sql(t, named, 2)
    harvest, code = _harvest_and_code(t)
    return (
        f"CAST(coalesce({_year_sql(_part_sql(t, dated, 3))} * 12 + {_month_sql(_part_sql(t, dated, 1))}, CASE WHEN NOT {day_like} THEN {_year_sql(_part_sql(t, short, 3))} * 12 + {_month_sql(_part_sql(t, short, 1))} END, {harvest}, {code}, "
        f"(CASE WHEN {token} IS NOT NULL AND (length({token}) = 4 OR TRY_CAST({token} AS INT) > 31) THEN {_year_sql(token)} ELSE 9999 END) * 12 + {_month_sql(_part_sql(t, named, 1))}) AS INT)"
    )


def display_key_sql(t: str) -> str:
    harvest, code = _harvest_and_code(t)
    named = f"\\b({_WORDS})\\b[^0-9]*(\\d{{2,4}})?"
    return f"CAST(coalesce({harvest}, {code}, coalesce({_year_sql(_part_sql(t, named, 2))}, 0) * 12 + {_month_sql(_part_sql(t, named, 1))}) AS INT)"


def _shifted_sql(x: str, months: int) -> str:
    """The month some months from 'Name YY[YY]'; NULL if the label is no month and year."""
    t = f"trim(regexp_replace(replace({x}, ',', ' '), '\\s+', ' ', 'g'))"
    pattern = "^([A-Za-z]+)\\s*([0-9]{2,4})$"
    token = _part_sql(t, pattern, 2)
    year = f"CASE WHEN length({token}) = 2 THEN TRY_CAST({token} AS INT) + 2000 ELSE TRY_CAST({token} AS INT) END"
    key = f"((CASE WHEN ({year}) BETWEEN 1900 AND 2200 THEN ({year}) END) * 12 + {_month_sql(_part_sql(t, pattern, 1))} + {months})"
    return f"{_FULL_NAMES}[(({key} - 1) % 12) + 1] || ' ' || (({key} - 1) // 12)"


@query(
    rf"""WITH l AS (SELECT o_orderkey, {dealt_sql(PERIODS, 'o_orderkey')} AS raw FROM orders), c AS (SELECT o_orderkey, raw, {clean_sql('raw')} AS clean FROM l), k AS (SELECT *, {month_key_sql('lower(clean)')} AS month_key, {display_key_sql('lower(trim(raw))')} AS display_key FROM c)
 SELECT o_orderkey, month_key, display_key, CASE WHEN month_key IS NULL THEN clean WHEN (month_key - 1) // 12 >= 9999 THEN {_FULL_NAMES}[(month_key - 1) % 12 + 1] ELSE {_FULL_NAMES}[(month_key - 1) % 12 + 1] || ' ' || ((month_key - 1) // 12) END AS month_label,
 coalesce('month:' || month_key, lower(clean), '-') AS period_key, coalesce(NOT regexp_matches(lower(clean), 'crop|harvest') AND month_key < 9999 * 12 AND month_key < 2026 * 12 + 6, false) AS expired,
 {_shifted_sql('clean', -1)} AS before_month, {_shifted_sql('clean', 1)} AS after_month, coalesce({_shifted_sql('clean', -1)} IS NOT NULL OR regexp_matches(trim(regexp_replace(replace(clean, ',', ' '), '\s+', ' ', 'g')), '(?i)^({_WORDS})\b'), false) AS looks_like_month FROM k"""
)
def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of a period label: sort keys, display label, key of equal spellings, expiry, neighbouring months."""
    raw = F.col("raw")
    o = table(spark, sf_dir, "orders").select("o_orderkey", dealt(PERIODS, "o_orderkey").alias("raw"))
    return by_distinct(
        o,
        ["raw"],
        month_key=periods.month_key(raw),
        display_key=periods.display_key(raw),
        month_label=periods.month_label(raw),
        period_key=periods.period_key(raw),
        expired=periods.expired(raw, F.lit(None).cast("string"), F.lit("2026-06-15").cast("date")),
        before_month=periods.delivery_of_futures(raw),
        after_month=periods.next_month(raw),
        looks_like_month=periods.looks_like_month(raw),
    ).drop("raw")


SYMBOLS = ["@C6K", "ZCK26", "zsn2026", "C26Z", "May-26", "Sept 26", "Aug-2026", "J26", "jan 26", "Harvest", "", None, "SRW 6Z", "Abcd-26", "  dec 2027 ", "Q1", "ZW H27"]
_SHORT = r"^\s*([A-Za-z]{3,4})[-\s](\d{2}|\d{4})\s*$"
_QUOTED = r"^([A-Za-z]+)\s+(\d{2}|\d{4})$"
_CAP3 = f"upper(left(regexp_extract(raw, '{_SHORT}', 1), 1)) || lower(substr(regexp_extract(raw, '{_SHORT}', 1), 2, 2))"
_SYMBOL = r"(?i)(\d{1,2})([FGHJKMNQUVXZ])"
_LONG = r"(?i)^(ZC|ZS|ZW)([FGHJKMNQUVXZ])(\d{2,4})$"
_CODE_NAME = f"left({_FULL_NAMES}[position(upper({{}}) IN 'FGHJKMNQUVXZ')], 3)"


@query(
    rf"""WITH l AS (SELECT o_orderkey, {dealt_sql(SYMBOLS, 'o_orderkey')} AS raw FROM orders), s AS (SELECT *, regexp_replace(raw, '[^A-Za-z0-9]', '', 'g') AS bare, ltrim(regexp_replace(trim(raw), '[^A-Za-z0-9@]', '', 'g'), '@') AS code FROM l),
 m AS (SELECT *, {_part_sql('bare', _SYMBOL, 1)} AS y, {_part_sql('bare', _SYMBOL, 2)} AS c, {_part_sql('code', _LONG, 3)} AS ly, {_part_sql('code', _LONG, 2)} AS lc FROM s),
 n AS (SELECT *, {_CODE_NAME.format('c')} || ' ' || (CAST(y AS INT) + CASE WHEN length(y) = 1 THEN 2020 ELSE 2000 END) AS symbol_month FROM m)
 SELECT o_orderkey, symbol_month, coalesce(CASE WHEN regexp_matches(code, '(?i)^[A-Z]{{1,3}}\d{{1,2}}[FGHJKMNQUVXZ]$') THEN symbol_month END, {_FULL_NAMES}[position(upper(lc) IN 'FGHJKMNQUVXZ')] || ' ' || CASE WHEN length(ly) = 4 THEN CAST(ly AS INT) ELSE CAST(ly AS INT) + 2000 END) AS futures_month,
 CASE WHEN regexp_matches(raw, '{_SHORT}') THEN {_CAP3} || ' ' || {_year_sql(f"regexp_extract(raw, '{_SHORT}', 2)")} ELSE raw END AS short_month,
 CASE WHEN regexp_matches(raw, '{_SHORT}') THEN coalesce({_FULL_NAMES}[{_month_sql(_CAP3)}], {_CAP3}) || ' ' || {_year_sql(f"regexp_extract(raw, '{_SHORT}', 2)")} ELSE raw END AS long_month,
 CASE WHEN regexp_matches(raw, '{_SHORT}') AND ({_month_sql(_CAP3)}) IS NOT NULL THEN printf('%04d-%02d', {_year_sql(f"regexp_extract(raw, '{_SHORT}', 2)")}, {_month_sql(_CAP3)}) ELSE lower(trim(raw)) END AS iso_month,
 coalesce(CASE WHEN length(raw) >= 3 THEN {_CODE_NAME.format('left(raw, 1)')} || ' ' || (TRY_CAST(substr(raw, 2) AS INT) + 2000) END, raw) AS delivery_code,
 CASE WHEN regexp_matches(trim(raw), '{_QUOTED}') THEN upper(left(trim(raw), 1)) || lower(substr(regexp_extract(trim(raw), '{_QUOTED}', 1), 2)) || ' ' || {_year_sql(f"regexp_extract(trim(raw), '{_QUOTED}', 2)")} ELSE trim(raw) END AS quoted_month FROM n"""
)
def futures_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Futures symbols and short month labels in every spelling the feeds use."""
    raw = F.col("raw")
    o = table(spark, sf_dir, "orders").select("o_orderkey", dealt(SYMBOLS, "o_orderkey").alias("raw"))
    return by_distinct(
        o,
        ["raw"],
        symbol_month=periods.symbol_month(raw),
        futures_month=periods.futures_month(raw),
        short_month=periods.short_month(raw),
        long_month=periods.long_month(raw),
        iso_month=periods.iso_month(raw),
        delivery_code=periods.delivery_code(raw),
        quoted_month=periods.quoted_month(raw),
    ).drop("raw")


@query("SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS iso_week FROM orders")
def iso_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", periods.iso_week(F.col("o_orderdate")).alias("iso_week"))


# ---------------------------------------------------------------- keys

KEY_PLACES = [" Dover ", "Port  Lambton", None, "Any Dover Branch", "dover, GLG"]
KEY_MONTHS = ["May-26", "N26", "May 2026", "Harvest", None, " spot "]


@query(
    rf"""WITH l AS (SELECT o_orderkey, {dealt_sql(KEY_PLACES, 'o_orderkey')} AS place, {dealt_sql(CROPS, 'o_orderkey')} AS crop, {dealt_sql(KEY_MONTHS, 'o_orderkey')} AS month, o_clerk FROM (SELECT o_orderkey, o_orderstatus AS o_clerk FROM orders)),
 s AS (SELECT *, lower(trim(regexp_replace(coalesce(place, ''), '\s+', ' ', 'g'))) AS kp, lower(trim(regexp_replace(coalesce(crop, ''), '\s+', ' ', 'g'))) AS kc, {clean_sql('month')} AS cm, {clean_sql('place')} AS cp, {clean_sql('crop')} AS cc FROM l),
 b AS (SELECT *, CASE WHEN regexp_matches(month, '{_SHORT}') THEN printf('%04d-%02d', {_year_sql(f"regexp_extract(month, '{_SHORT}', 2)")}, {_month_sql(_CAP3.replace('raw', 'month'))}) ELSE lower(trim(month)) END AS iso, {month_key_sql('lower(cm)')} AS mk,
 lower({clean_sql("regexp_replace(trim(regexp_replace(cp, '(?i),\\s*(glg)$', '')), '(?i)^any\\s+(.+?)\\s+branch$', '\\1 Branch')")}) AS loc FROM s), a(k, v) AS {values_sql(text.COMMODITY_ALIASES)}
 SELECT o_orderkey, kp || '|' || kc || '|' || coalesce(iso, '') || '||' || coalesce(iso, '') AS sheet_key, coalesce(loc, '-') || '|' || lower(o_clerk) || '|' || coalesce(lower(cc), '-') || '|' || coalesce('month:' || mk, lower(cm), '-') || '|' || coalesce('month:' || mk, lower(cm), '-') AS preview_key,
 lower(o_clerk) || '|' || coalesce(loc, '-') || '|' || coalesce(lower(a.v), lower(cc), '-') || '|' || coalesce(lower(cm), '-') || '|-' AS market_key FROM b LEFT JOIN a ON a.k = lower(cc)"""
)
def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three keys of a row: of a sheet, of a preview, of a market."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", dealt(KEY_PLACES, "o_orderkey").alias("place"), dealt(CROPS, "o_orderkey").alias("crop"), dealt(KEY_MONTHS, "o_orderkey").alias("month"), F.col("o_orderstatus").alias("company"))
    place, crop, month, company = (F.col(c) for c in ("place", "crop", "month", "company"))
    market_key = keys.market_key(company, place, crop, month, F.lit(None).cast("string"))
    return by_distinct(
        o,
        ["place", "crop", "month", "company"],
        sheet_key=keys.sheet_key(place, crop, month, F.lit(None).cast("string"), month),
        preview_key=keys.preview_key(place, company, crop, month, month),
        market_key=F.concat_ws("|", *[market_key[f] for f in ("company", "location", "commodity", "delivery", "futures")]),
    ).select("o_orderkey", "sheet_key", "preview_key", "market_key")


# ---------------------------------------------------------------- cells and markup

CELLS = ["=SUM(A1)", "-5", "plain", "@x", "+1", None, ""]
MAILS = [" Ann@Example.ORG ", "no mail", "a@b", "x y@z.de", "q@w.co", None]
LISTS = ["a, b,,A , c", "", None, "x;y", " Z ,z, Z"]
QUOTED_TEXTS = ["“Old” – ‘new’", "a b — c", "plain  text", None]


@query(
    rf"""WITH l AS (SELECT c_custkey, {dealt_sql(CELLS, 'c_custkey')} AS cell, {dealt_sql(MAILS, 'c_custkey')} AS mail, {dealt_sql(LISTS, 'c_custkey')} AS list, {dealt_sql(QUOTED_TEXTS, 'c_custkey')} AS quoted FROM customer),
 p AS (SELECT *, list_filter(list_transform(string_split(list, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM l)
 SELECT c_custkey, CASE WHEN regexp_matches(cell, '^[=+\-@]') THEN '''' || cell ELSE cell END AS safe_cell, CASE WHEN regexp_matches(lower(trim(mail)), '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN lower(trim(mail)) END AS address,
 array_to_string(list_filter(parts, lambda x, i: list_position(list_transform(parts, lambda y: lower(y)), lower(x)) = i), ',') AS distinct_parts, trim(regexp_replace(translate(quoted, '‘’“”–—‐‑ ' || chr(160), '''''""----  '), '\s+', ' ', 'g')) AS plain FROM p"""
)
def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreadsheet-safe cells, addresses, distinct parts of lists, plain punctuation."""
    c = table(spark, sf_dir, "customer").select("c_custkey", *[dealt(x, "c_custkey").alias(n) for n, x in (("cell", CELLS), ("mail", MAILS), ("list", LISTS), ("quoted", QUOTED_TEXTS))])
    parts = F.array_join(text.distinct_list(F.col("list")), ",")
    return c.select("c_custkey", text.spreadsheet_safe(F.col("cell")).alias("safe_cell"), text.email(F.col("mail")).alias("address"), parts.alias("distinct_parts"), text.plain_punctuation(F.col("quoted")).alias("plain"))


@query(
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS stripped,
 md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped_md5 FROM pages"""
)
def markup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages without their tags, and escaped."""
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("stripped"), F.md5(text.escape_html(F.col("html"))).alias("escaped_md5"))
