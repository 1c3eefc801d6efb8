"""Prices as column expressions: grain ticks, lenient numbers, units, rounding (half to even) and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basisline.functions.text import lookup, nonempty, using

PRICE = "decimal(18,6)"

# Bushels in a metric tonne, as each kind of feed counts them.
BUSHELS_PER_TONNE = {"corn": "39.368", "soybean": "36.744", "soybeans": "36.744", "wheat": "36.744", "canola": "44.092"}
ADAPTER_BUSHELS_PER_TONNE = {"corn": 39.3683, "soy": 36.7437}
POSTED_BUSHELS_PER_TONNE = {"corn": 39.368, "soybeans": 36.744, "wheat": 36.743}
# End of fixed values.

_TICK = r"^(-?\d+)\s*['-]\s*(\d+)$"


def tick_price(text: Column) -> Column:
    """Price of a cell: 456'6 and 456-6 are eighths, other digits after the mark are decimals; commas and dollar signs go.

    Letters after the last digit are dropped; null for what is no finite number. A negative price adds its eighths.
    """


    def read(t: Column, whole: Column, part: Column) -> Column:
        eighths = whole.try_cast(PRICE) + part.try_cast("int") / F.lit(8).cast("decimal(4,0)")
        plain = F.regexp_replace(t, r"[,$]", "").try_cast(PRICE)
        return F.when(part.rlike("^[0-7]$"), eighths).when(part != "", F.concat(whole, F.lit("."), part).try_cast(PRICE)).otherwise(plain).cast(PRICE)

    parts = lambda t: F.struct(F.regexp_extract(t, _TICK, 1).alias("whole"), F.regexp_extract(t, _TICK, 2).alias("part"))
    cell = F.regexp_replace(F.trim(text.cast("string")), r"(?<=\d)[A-Za-z]+$", "")
    ticks = using(cell, lambda t: using(parts(t), lambda p: read(t, p["whole"], p["part"])))
    return F.coalesce(text.cast("string").try_cast(PRICE), ticks)  # most cells are plain numbers


def _last(text: Column, pattern: str, group: int = 0) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def price_in_text(text: Column) -> Column:
    """Price named in free text ('ZCN26 @ 6.34'): the last tick, else the last decimal, else the whole text if it is a
    number up to 1200, else the last number marked with @ or $."""


    def read(t: Column) -> Column:
        alone = nonempty(F.regexp_extract(t, r"^-?\d+(?:\.\d+)?$", 0)).try_cast(PRICE)
        return F.coalesce(
            tick_price(_last(t, r"-?\d+\s*['-]\s*\d+[A-Za-z]*")),
            _last(t, r"-?\d+\.\d+").try_cast(PRICE),
            using(alone, lambda x: F.when(F.abs(x) <= 1200, x)),
            _last(t, r"(?:@|\$)\s*(-?\d+(?:\.\d+)?)", 1).try_cast(PRICE),
        )

    return using(F.replace(F.trim(text.cast("string")), F.lit(","), F.lit("")), read)


def lenient_number(text: Column) -> Column:
    """Any number in a cell: quotes and hyphens become points, all other signs go (a minus too)."""
    return F.regexp_replace(F.translate(text, "'-", ".."), r"[^0-9.]", "").try_cast("double")


def quoted_cents(text: Column) -> Column:
    """Exchange quote in cents: 425-4 is 425 and 4 eighths, with any number of digits after the hyphen."""
    pattern = r"^(\d+(?:\.\d+)?)(?:-(\d+))?$"
    part = lambda t: F.coalesce(nonempty(F.regexp_extract(t, pattern, 2)).try_cast("double"), F.lit(0.0))
    return using(F.trim(text), lambda t: nonempty(F.regexp_extract(t, pattern, 1)).try_cast("double") + part(t) / 8)


def dollars_per_bushel(text: Column) -> Column:
    """Futures price in dollars: quotes in whole cents or eighths are cents; decimals under 50 are dollars already."""
    decimal = lambda v: F.when(v < 50, v).otherwise(v / 100)
    read = lambda t: F.when(t.rlike(r"^\d+(-\d+)?$"), quoted_cents(t) / 100).otherwise(using(t.try_cast("double"), decimal))
    return using(F.regexp_replace(F.trim(text), r"[$,]", ""), read)


def basis_to_store(basis: Column) -> Column:
    """Basis in dollars: values of ten or more are cents, rounded half to even."""
    return using(basis, lambda b: F.when(F.abs(b) >= 10, F.bround(b / 100, 2)).otherwise(b).cast(PRICE))


def basis_to_show(basis: Column) -> Column:
    """Basis in dollars as it is read back: values of ten or more are cents; nothing is rounded."""
    return using(finite(basis.cast("double")), lambda b: F.when(F.abs(b) >= 10, b / 100).otherwise(b))


def per_tonne(commodity: Column, price_bu: Column) -> Column:
    """Tonne price of a bushel price; unknown commodities count as corn."""
    factor = using(F.lower(F.trim(commodity)), lambda key: F.coalesce(lookup(BUSHELS_PER_TONNE, key), lookup(BUSHELS_PER_TONNE, F.rtrim(key, F.lit("s"))), F.lit(BUSHELS_PER_TONNE["corn"])))
    return F.bround(price_bu * factor.cast("decimal(9,4)"), 2).cast(PRICE)


def adapter_per_tonne(commodity: Column, price_bu: Column) -> Column:
    """Tonne price for feeds that only list corn and soybeans; null for anything else."""
    out = F.lit(None).cast("double")
    for word, factor in ADAPTER_BUSHELS_PER_TONNE.items():
        out = F.when(F.lower(commodity).contains(word), F.bround(price_bu * factor, 2)).otherwise(out)
    return out


def finite(value: Column) -> Column:
    """Null instead of NaN and infinities."""
    return using(value, lambda v: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v))


def last_number(text: Column) -> Column:
    """Last numeric literal of a cell."""
    return _last(text, r"-?\d+(?:\.\d+)?")


def money(text: Column) -> Column:
    """Visible amount without currency signs and separators."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast(PRICE)


def delta(now: Column, before: Column) -> Column:
    """Change; null where either side is."""
    return now - before


def show_cash(price: Column) -> Column:
    """'$5.45/bu', or 'n/a'."""
    return F.when(price.isNotNull(), F.format_string("$%.2f/bu", price.cast("double"))).otherwise("n/a")


def show_basis(basis: Column) -> Column:
    """'+1.10/bu', or 'n/a'."""
    return F.when(basis.isNotNull(), F.format_string("%+.2f/bu", basis.cast("double"))).otherwise("n/a")
