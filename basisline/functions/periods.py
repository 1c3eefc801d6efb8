"""Delivery periods and futures months as column expressions.

A period becomes a month key, `year * 12 + month`; labels that name a month without a year get a key beyond every year.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basisline.functions.text import lookup, nonempty, normalize_text, using

# Month names, abbreviations and exchange month codes.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTH_CODES = "FGHJKMNQUVXZ"
_NUMBER = {m.lower(): i + 1 for i, m in enumerate(MONTHS)} | {m[:3].lower(): i + 1 for i, m in enumerate(MONTHS)} | {"sept": 9}
_NAMES = "|".join(sorted(_NUMBER, key=len, reverse=True))
_FULL = "|".join(m.lower() for m in MONTHS)
# Readings of a period label.
DATED = rf"\b({_NAMES})\b\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:\s*,\s*|\s+)(\d{{4}})\b"
MONTH_AND_DIGITS = rf"\b({_NAMES})\b\s*([-/\s])\s*(\d{{2,4}})(?!\s*,\s*\d{{4}})\b"
HARVEST = r"\bharvest\b[^0-9]*(\d{2,4})?"
CONTRACT = r"\b([fghjkmnquvxz])(?:c|s|w)?(\d{1,2})\b"
NAMED = rf"\b({_NAMES})\b[^0-9]*(\d{{2,4}})?"
# End of fixed values.

#: Month of a year-less label: after every dated one.
NO_YEAR = 9999


def month_number(name: Column) -> Column:
    """1 to 12 of a month's name or abbreviation, null for other words."""
    return lookup({k: str(v) for k, v in _NUMBER.items()}, F.lower(name)).cast("int")


def code_number(letter: Column) -> Column:
    """1 to 12 of an exchange month code."""
    return lookup({x: str(i + 1) for i, x in enumerate(MONTH_CODES)}, F.upper(letter)).cast("int")


def month_name(number: Column, short: bool = False) -> Column:
    return F.get(F.array(*[F.lit(m[:3] if short else m) for m in MONTHS]), number - 1)


def full_year(token: Column) -> Column:
    """Year of its digits: two-digit years are in this century; null for no digits."""
    return using(token.try_cast("int"), lambda y: F.when(y < 100, y + 2000).otherwise(y))


def _part(text: Column, pattern: str, group: int) -> Column:
    return nonempty(F.regexp_extract(text, pattern, group))


def _key(year: Column, month: Column) -> Column:
    return year * 12 + month


def _month_of(key: Column) -> Column:
    """'Month YYYY' of a key that is a bound variable."""
    year = F.floor((key - 1) / 12).cast("int")
    return F.concat(month_name((key - 1) % 12 + 1), F.lit(" "), year.cast("string"))


def month_key(label: Column) -> Column:
    """Month key of a free-text period, by the first reading that fits.

    'May 31, 2026' and 'May-26' are dated; 'May 31' is a day and thus May of no year; 'Harvest 26' is October; futures
    codes such as 'N26' count; a bare month has no year.
    """
    return using(F.lower(normalize_text(label)), _read_month)


def _read_month(text: Column) -> Column:
    """The readings of month_key on a bound, cleaned label."""
    with_day = _key(full_year(_part(text, DATED, 3)), month_number(_part(text, DATED, 1)))

    def month_year(digits: Column) -> Column:
        day_like = F.regexp_extract(text, MONTH_AND_DIGITS, 2).rlike(r"^\s$") & (F.length(digits) <= 2) & (digits.try_cast("int") <= 31)
        return F.when(~day_like, _key(full_year(nonempty(digits)), month_number(_part(text, MONTH_AND_DIGITS, 1))))

    def bare(token: Column) -> Column:
        has_year = token.isNotNull() & ((F.length(token) == 4) | (token.try_cast("int") > 31))
        return _key(F.when(has_year, full_year(token)).otherwise(NO_YEAR), month_number(_part(text, NAMED, 1)))

    harvest, contract = _harvest_and_contract(text)
    return F.coalesce(with_day, using(F.regexp_extract(text, MONTH_AND_DIGITS, 3), month_year), harvest, contract, using(_part(text, NAMED, 2), bare)).cast("int")


def _harvest_and_contract(text: Column) -> tuple[Column, Column]:
    return _key(full_year(_part(text, HARVEST, 1)), F.lit(10)), _key(full_year(_part(text, CONTRACT, 2)), code_number(_part(text, CONTRACT, 1)))


def display_key(label: Column) -> Column:
    """Month key by which boards order labels: harvests and futures codes are read before month names, the first number of
    two to four digits after a name is its year, and a name without one has year 0."""


    def read(text: Column) -> Column:
        bare = _key(F.coalesce(full_year(_part(text, NAMED, 2)), F.lit(0)), month_number(_part(text, NAMED, 1)))
        return F.coalesce(*_harvest_and_contract(text), bare).cast("int")

    return using(F.lower(F.trim(label)), read)


def month_label(label: Column) -> Column:
    """'Month YYYY' (or 'Month' without a year) of a period, the cleaned label itself if it names none."""

    named = lambda key: F.when(key > NO_YEAR * 12, month_name((key - 1) % 12 + 1)).otherwise(_month_of(key))
    return using(normalize_text(label), lambda clean: F.coalesce(using(_read_month(F.lower(clean)), named), clean))


def period_key(label: Column) -> Column:
    """Text that is equal for spellings of one period."""
    return using(F.lower(normalize_text(label)), lambda text: F.coalesce(F.concat(F.lit("month:"), _read_month(text).cast("string")), text, F.lit("-")))


def expiry_key(label: Column) -> Column:
    """Month key that can expire: none for crop years, harvests and months without a year."""
    dated = lambda key: F.when(key < NO_YEAR * 12, key)
    return using(F.lower(normalize_text(label)), lambda text: F.when(~text.rlike("crop|harvest"), using(_read_month(text), dated)))


def expired(delivery: Column, futures: Column, as_of: Column) -> Column:
    """Does the delivery or the futures month lie before the month of `as_of`?"""
    now = F.year(as_of) * 12 + F.month(as_of)
    return F.coalesce(expiry_key(delivery) < now, F.lit(False)) | F.coalesce(expiry_key(futures) < now, F.lit(False))


def month_start(label: Column) -> Column:
    """First day of a period written 'Fullmonth YYYY', else null."""
    text = nonempty(F.regexp_extract(F.trim(label), rf"(?i)^({_FULL})\s+\d{{4}}$", 0))
    return F.try_to_date(F.regexp_replace(F.initcap(text), r"\s+", " "), "MMMM yyyy")


def current(label: Column, as_of: Column) -> Column:
    """True unless the label is a full month before that of `as_of`."""
    return F.coalesce(month_start(label) >= F.trunc(as_of, "month"), F.lit(True))


def _without_commas(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_text(label), ",", " "), r"\s+", " "))


_MONTH_YEAR = r"^([A-Za-z]+)\s*([0-9]{2,4})$"


def _named_key(text: Column) -> Column:
    """Month key of a bound text that is a month's name and a year from 1900 to 2200, else null."""
    of_token = lambda t: F.when(F.length(t) == 2, t.try_cast("int") + 2000).otherwise(t.try_cast("int"))
    in_range = lambda y: F.when(y.between(1900, 2200), y)
    return _key(using(using(_part(text, _MONTH_YEAR, 2), of_token), in_range), month_number(_part(text, _MONTH_YEAR, 1)))


def _shifted(label: Column, months: int) -> Column:
    return using(_without_commas(label), lambda text: using(_named_key(text) + months, _month_of))


def delivery_of_futures(futures: Column) -> Column:
    """Month before a futures month ('Jul 2026' gives 'June 2026'); null if it names no month and year."""
    return _shifted(futures, -1)


def next_month(delivery: Column) -> Column:
    """Month after a delivery month, the contract it is priced on where none is named."""
    return _shifted(delivery, 1)


def looks_like_month(label: Column) -> Column:
    """Does the label begin with a month's name?"""
    return F.coalesce(_without_commas(label).rlike(rf"(?i)^(?:(?:{_NAMES})\b|(?:{_NAMES})(?:19\d\d|20\d\d|21\d\d|2200|\d\d)$)"), F.lit(False))


def symbol_month(symbol: Column) -> Column:
    """Month of a contract written year first or code last ('@C6K' gives 'May 2026'); one-digit years follow 2020."""
    pattern = rf"(?i)(\d{{1,2}})([{MONTH_CODES}])"

    def read(text: Column) -> Column:
        year = using(_part(text, pattern, 1), lambda d: d.try_cast("int") + F.when(F.length(d) == 1, 2020).otherwise(2000))
        return F.concat(month_name(code_number(_part(text, pattern, 2)), short=True), F.lit(" "), year.cast("string"))

    return using(F.regexp_replace(symbol, "[^A-Za-z0-9]", ""), read)


def _code_year(token: Column) -> Column:
    """Year of the two to four digits beside a month code."""
    return token.try_cast("int") + F.when(F.length(token) == 4, 0).otherwise(2000)


def _scanned(text: Column) -> Column:
    """Letter-by-letter reading: the first month code followed by 2 to 4 digits, or with digits just before it."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)))

    def reading(i: Column) -> Column:
        after = _part(F.substr(text, i + 1), r"^(\d{2,4})", 1)
        before = _part(F.substr(text, F.lit(1), i - 1), r"(\d{1,4})$", 1)
        year = using(F.coalesce(after, before), _code_year)
        return F.concat(month_name(code_number(F.substr(text, i, F.lit(1)))), F.lit(" "), year.cast("string"))

    return F.get(F.filter(F.transform(at, reading), lambda x: x.isNotNull()), F.lit(0))


def futures_month(symbol: Column, scan_letters: bool = False) -> Column:
    """Month of a futures symbol: '@C6K', 'ZCK26'; null for what is no symbol.

    `scan_letters` also reads any month code letter beside digits, as older feeds need; it misreads plain labels such as
    'Jan 2026', so it is off by default.
    """
    long = rf"(?i)^(ZC|ZS|ZW)([{MONTH_CODES}])(\d{{2,4}})$"

    def named(text: Column) -> Column:
        return F.concat(month_name(code_number(_part(text, long, 2))), F.lit(" "), using(_part(text, long, 3), _code_year).cast("string"))

    def read(text: Column) -> Column:
        like_symbol = text.rlike(rf"(?i)^[A-Z]{{1,3}}\d{{1,2}}[{MONTH_CODES}]$")
        return F.coalesce(F.when(like_symbol, symbol_month(text)), named(text))

    text = F.ltrim(F.regexp_replace(F.trim(symbol), "[^A-Za-z0-9@]", ""), F.lit("@"))
    if scan_letters:
        plain = F.regexp_replace(symbol, "[^A-Za-z0-9]", "")
        return F.coalesce(symbol_month(symbol), using(text, named), using(plain, _scanned))
    return using(text, read)


def short_month(label: Column) -> Column:
    """'May-26' as 'May 2026'; other labels stay."""
    return _respelled(label, short=True)


def long_month(label: Column) -> Column:
    """'Aug-26' as 'August 2026'; other labels stay."""
    return _respelled(label, short=False)


_SHORT = r"^\s*([A-Za-z]{3,4})[-\s](\d{2}|\d{4})\s*$"


def _respelled(label: Column, short: bool) -> Column:

    def read(x: Column) -> Column:
        name = F.initcap(F.substr(F.regexp_extract(x, _SHORT, 1), F.lit(1), F.lit(3)))
        full = name if short else using(name, lambda n: F.coalesce(month_name(month_number(n)), n))
        return F.when(x.rlike(_SHORT), F.concat_ws(" ", full, full_year(_part(x, _SHORT, 2)).cast("string"))).otherwise(x)

    return using(label, read)


def iso_month(label: Column) -> Column:
    """'May-26' as '2026-05', other labels lower-cased: the period part of the older row key."""


    def read(x: Column) -> Column:
        month = month_number(F.substr(F.regexp_extract(x, _SHORT, 1), F.lit(1), F.lit(3)))
        dated = using(month, lambda m: F.when(m.isNotNull(), F.format_string("%04d-%02d", full_year(_part(x, _SHORT, 2)), m)))
        return F.coalesce(dated, F.lower(F.trim(x)))

    return using(label, read)


def delivery_code(code: Column) -> Column:
    """'J26' as 'Apr 2026'; other codes stay."""
    year = F.substr(code, F.lit(2)).try_cast("int")
    name = month_name(code_number(F.substr(code, F.lit(1), F.lit(1))), short=True)
    return F.coalesce(F.when(F.length(code) >= 3, F.concat(name, F.lit(" "), (year + 2000).cast("string"))), code)


def quoted_month(label: Column) -> Column:
    """'May 26' or 'may 2026' as 'May 2026'; other labels stay."""
    pattern = r"^([A-Za-z]+)\s+(\d{2}|\d{4})$"
    spelled = lambda x: F.concat_ws(" ", F.initcap(F.regexp_extract(x, pattern, 1)), full_year(_part(x, pattern, 2)).cast("string"))
    return using(F.trim(label), lambda x: F.when(x.rlike(pattern), spelled(x)).otherwise(x))


def iso_week(day: Column) -> Column:
    """'YYYY-Www' of a date."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))
