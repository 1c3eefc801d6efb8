"""Label canonicalization as column expressions: text, sources, commodities, locations, companies.

Every function maps columns to a column, so Catalyst sees through it; none calls Python per row. What a function uses more
than once it binds once (`using`), so its expression stays small however functions are nested, and plans of many compile.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that must equal those users already have.
NULL_LIKE = ("nan", "none", "null", "na", "n/a", "-")
SOURCE_ALIASES = {
    "glg": "Great Lakes Grain",
    "g.l.g.": "Great Lakes Grain",
    "great lakes grain": "Great Lakes Grain",
    "agris": "Great Lakes Grain",
    "agris co-operative": "Great Lakes Grain",
    "agris cooperative": "Great Lakes Grain",
    "central ontario fs": "Great Lakes Grain",
    "lac": "London Agricultural Commodities",
    "london ag commodities": "London Agricultural Commodities",
    "london agricultural commodities": "London Agricultural Commodities",
    "hensall": "Hensall Co-operative",
    "hensall hdc": "Hensall Co-operative",
    "hdc": "Hensall Co-operative",
    "hensall co-op": "Hensall Co-operative",
    "hensall co-operative": "Hensall Co-operative",
    "hensall cooperative": "Hensall Co-operative",
    "snobelen": "Snobelen Farms",
    "snobelen farms": "Snobelen Farms",
    "port of prescott grain terminal": "Port of Prescott",
    "port of prescott": "Port of Prescott",
    "agricharts": "Agricharts",
    "andersons": "The Andersons",
    "the andersons": "The Andersons",
    "thompsons": "The Andersons",
    "thompsons ltd": "The Andersons",
    "thompsons limited": "The Andersons",
    "wanstead": "Wanstead",
    "eastern ontario cash bids": "Eastern Ontario Cash Bids",
    "eastern ontario daily file": "Eastern Ontario Cash Bids",
    "ontario cash bids": "Ontario Cash Bids",
    "ontario daily file": "Ontario Cash Bids",
}
COMMODITY_ALIASES = {"corn": "Corn", "white corn": "White Corn", "soybean": "Soybeans", "soybeans": "Soybeans", "wheat": "Wheat"}
LOCATION_ALIASES = {
    "starffordville": "Straffordville",
    "staffordville": "Straffordville",
    "prescott transfer": "Prescott",
    "prescott (transfer)": "Prescott",
    "ingredion cardinal": "Cardinal",
    "johnstown ethanol": "Johnstown",
    "johnstown (ethanol)": "Johnstown",
    "embrun elevator": "Embrun",
    "embrun co-op": "Embrun",
    "embrun coop": "Embrun",
    "toledo": "Toledo Elevator",
    "toledo corn": "Toledo Elevator",
    "toledo soybeans": "Toledo Elevator",
}
LOCATION_COMPANY = {"prescott": "Port of Prescott", "cardinal": "Ingredion", "johnstown": "Greenfield Global", "embrun": "Embrun Co-op (GLG)"}
REGION_OF_SOURCE = {"eastern ontario cash bids": "Eastern Ontario", "ontario cash bids": "Ontario"}
# Ordered: the first company of which any text occurs.
OPERATOR_TEXTS = {
    "The Andersons": ("andersons", "thompsons"),
    "Great Lakes Grain": ("great lakes grain",),
    "London Agricultural Commodities": ("london agricultural commodities",),
    "Hensall Co-operative": ("hensall",),
    "Ingredion": ("ingredion",),
    "Oakwood-Sunderland Co-op": ("oakwood-sunderland", "sunderland co-operative", "sunderland co operative"),
    "Toledo Elevator": ("toledo elevator",),
    "North Gower Grains": ("north gower grains",),
    "Greenfield Global": ("greenfield global",),
    "BroadGrain Commodities": ("broadgrain",),
    "Parrish & Heimbecker": ("parrish", "p&h"),
    "Richardson International": ("richardson",),
    "Wilson Farm Grain": ("wilson farm grain",),
    "ADM": ("adm",),
}
HENSALL_TEXTS = ("hdc", "co-op", "co operative")
# Ordered: these parents win over every other text.
PARENT_TEXTS = {
    "Great Lakes Grain": ("central ontario fs", "agris co-operative", "agris cooperative", "agris / great lakes grain"),
    "The Andersons": ("thompsons", "the andersons", "andersons"),
    "Huron Bay Co-operative": ("huron bay co-operative", "huron bay cooperative", "varna grain"),
}
SEVERAL_TEXTS = (" or ", "; ", " and ", "/")
PARENT_CANDIDATES = {
    "Great Lakes Grain": ("great lakes grain", "agris", "central ontario fs"),
    "The Andersons": ("thompsons", "andersons"),
    "Huron Bay Co-operative": ("huron bay co-operative", "huron bay cooperative", "varna grain"),
    "Cargill": ("cargill",),
    "ADM": ("adm",),
    "Parrish & Heimbecker": ("parrish", "p&h"),
    "Snobelen Farms": ("snobelen",),
    "BroadGrain Commodities": ("broadgrain",),
    "Haggerty Creek Ltd.": ("haggerty creek",),
}
EASTERN_PLACES = ("brinston", "cardinal", "chesterville", "dalkeith", "embrun", "johnstown", "kars", "lansdowne", "north gower", "prescott", "vankleek hill", "winchester")
AGGREGATORS = ("agricharts",)
HIDDEN_COMMODITIES = ("mixed daily file",)
INVALID_COMMODITIES = ("mixed daily file", "ontario daily file", "ontario cash bids", "eastern ontario daily file", "eastern ontario cash bids")
INVALID_COMMODITY_TOKENS = ("daily file", "cash bids", "source sheet")
PLACE_CROP = r"(?i)\s+(corn|soybeans?|wheat|barley|oats|milo)$"
PLACE_WET_CORN = r"(?i)\bwet\s+corn$"
PLACE_COMPANY = r"(?i),\s*(glg|g\.l\.g\.|agricharts|andersons|the andersons|hensall|snobelen|wanstead)$"
PLACE_ANY_BRANCH = r"(?i)^any\s+(.+?)\s+branch$"
EASTERN_CUTS = (r"^LAC\s*-\s*", r"^Ingredion\s+", r"\s+\([^)]*\)\s*$", r"\s+(corn|soybeans?|wheat|hrw new crop wheat|hrw old crop wheat)$", r"\s+(transfer|ethanol|elevator)$")
# End of fixed values.


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Value of a small constant table, null where the key is missing."""
    quoted = ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for kv in table.items() for x in kv)
    return F.expr(f"map({quoted})")[key]


def using(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` names it: a lambda variable is never expanded."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def nonempty(value: Column) -> Column:
    """The text, null for the empty one; names its value once."""
    return F.get(F.array_remove(F.array(value), ""), F.lit(0))


_NO_TEXT = "(?i)^(?:" + "|".join(NULL_LIKE) + ")$"


def normalize_text(value: Column) -> Column:
    """Trimmed text with inner white space (any Unicode blank) collapsed; null for empty and null-like words."""
    clean = F.trim(F.regexp_replace(value.cast("string"), r"(?U)\s+", " "))
    return nonempty(F.regexp_replace(clean, _NO_TEXT, ""))


def _known(clean: Column, names: Mapping[str, str]) -> Column:
    """The name that a table gives a cleaned label, else the label."""
    return using(clean, lambda c: F.coalesce(lookup(names, F.lower(c)), c))


def canonical_key(value: Column) -> Column:
    """Comparison key of a label: normalized and lower-cased."""
    return F.lower(normalize_text(value))


def canonical_source(value: Column) -> Column:
    return _known(normalize_text(value), SOURCE_ALIASES)


def canonical_commodity(value: Column) -> Column:
    return _known(normalize_text(value), COMMODITY_ALIASES)


def display_commodity(value: Column) -> Column:
    """Known commodity name, else the words capitalized."""
    return using(normalize_text(value), lambda c: F.coalesce(lookup(COMMODITY_ALIASES, F.lower(c)), F.initcap(c)))


def canonical_location(value: Column) -> Column:
    """One label for a market place: no commodity or company suffix, no 'Any ... Branch', known variants merged."""
    place = F.trim(F.regexp_replace(normalize_text(value), r"\s*/\s*", " / "))
    place = using(place, lambda p: F.when(p.rlike(PLACE_WET_CORN), p).otherwise(F.trim(F.regexp_replace(p, PLACE_CROP, ""))))
    place = F.trim(F.regexp_replace(place, PLACE_COMPANY, ""))
    place = normalize_text(F.regexp_replace(place, PLACE_ANY_BRANCH, "$1 Branch"))
    return _known(place, LOCATION_ALIASES)


def source_scope(value: Column) -> Column:
    """struct(scope, label): a source that stands for a whole region, or a company."""


    def scoped(name: Column) -> Column:
        region = lookup(REGION_OF_SOURCE, F.lower(name))
        return F.struct(F.when(region.isNotNull(), "region").otherwise("company").alias("scope"), F.coalesce(region, name).alias("label"))

    return using(canonical_source(value), scoped)


def region_sources(region: Column) -> Column:
    """Names of the sources that stand for a region; empty if it is unknown."""
    by_region = {v.lower(): SOURCE_ALIASES[k] for k, v in REGION_OF_SOURCE.items()}
    return F.array_compact(F.array(lookup(by_region, canonical_key(region))))


def is_aggregator(source: Column) -> Column:
    return F.coalesce(F.lower(canonical_source(source)).isin(*AGGREGATORS), F.lit(False))


def creates_company(source: Column) -> Column:
    """Does a row of this source name its own company? Not if it stands for a region or repeats others' bids."""
    return using(canonical_source(source), _own_company)


def _own_company(name: Column) -> Column:
    """Does a canonical source name its own company?"""
    return F.coalesce(lookup(REGION_OF_SOURCE, F.lower(name)).isNull() & ~F.lower(name).isin(*AGGREGATORS), F.lit(False))


def trusted_company(name: Column) -> Column:
    """Canonical company name, null for regions and aggregators."""
    return using(canonical_source(name), lambda n: F.when(_own_company(n), n))


def display_company(location: Column, row_company: Column, location_company: Column, source: Column) -> Column:
    """Company to show: fixed by the place, else the row's, else the place's, else that of the source itself."""
    return F.coalesce(
        lookup(LOCATION_COMPANY, canonical_key(canonical_location(location))),
        trusted_company(row_company),
        trusted_company(location_company),
        trusted_company(source),
    )


def attribution(source: Column) -> Column:
    """The source named beside a bid whose company is another: regions and aggregators."""
    return using(canonical_source(source), lambda n: F.when(~_own_company(n), n))


def invalid_commodity(commodity: Column, source: Column) -> Column:
    """A label that names a file or its source instead of a crop."""


    def invalid(key: Column) -> Column:
        words = F.lit(False)
        for token in INVALID_COMMODITY_TOKENS:
            words = words | key.contains(token)
        return F.coalesce(key.isin(*INVALID_COMMODITIES) | words | F.coalesce(key == canonical_key(source), F.lit(False)), F.lit(False))

    return using(canonical_key(commodity), invalid)


def distinct_list(text: Column, sep: str = ",") -> Column:
    """Trimmed, non-empty parts of a separated list, in order; the first spelling of each (ignoring case) stays."""
    found = F.filter(F.transform(F.split(text, sep), lambda x: F.trim(x)), lambda x: x != "")
    first = lambda parts, lowered: F.filter(parts, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    return using(found, lambda parts: using(F.transform(parts, lambda x: F.lower(x)), lambda lowered: first(parts, lowered)))


def strip_html(text: Column) -> Column:
    """Text without tags; the five basic entities and non-breaking blanks decoded."""
    out = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def escape_html(text: Column) -> Column:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def plain_punctuation(text: Column) -> Column:
    """Typographic quotes, dashes and blanks as ASCII, blanks collapsed."""
    plain = F.translate(text, "\u2018\u2019\u201c\u201d\u2013\u2014\u2010\u2011\u202f\u00a0", "''\"\"----  ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def _any_of(words: Column, texts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in texts:
        out = out | words.contains(t)
    return out


def operator_company(operator: Column, location: Column) -> Column:
    """Company that an operator's free text stands for, else the text itself."""


    def read(plain: Column, said: Column, place: Column) -> Column:
        out = plain
        for company, texts in reversed(OPERATOR_TEXTS.items()):
            here = _any_of(said, texts)
            if company == "Hensall Co-operative":
                here = here & _any_of(said, HENSALL_TEXTS)
            if company == "Oakwood-Sunderland Co-op":
                here = here | (place.contains("oakwood") & place.contains("sunderland"))
            out = F.when(here, company).otherwise(out)
        return out

    both = F.struct(plain_punctuation(operator).alias("operator"), F.lower(plain_punctuation(location)).alias("place"))
    return using(both, lambda x: using(F.lower(x["operator"]), lambda said: read(x["operator"], said, x["place"])))


def parent_company(operator: Column, location: Column, evidence: Column) -> Column:
    """The one parent company that a tentative row points to; null where several operators or none are named."""


    def read(said: Column) -> Column:
        named = F.array_compact(F.array(*[F.when(_any_of(said, texts), F.lit(company)) for company, texts in PARENT_CANDIDATES.items()]))
        out = using(named, lambda n: F.when(~_any_of(said, SEVERAL_TEXTS) & (F.size(n) == 1), F.get(n, F.lit(0))))
        for company, texts in reversed(PARENT_TEXTS.items()):
            out = F.when(_any_of(said, texts), company).otherwise(out)
        return out

    return using(F.lower(F.concat_ws(" ", operator, location, F.coalesce(evidence, F.lit("")))), read)


def eastern_key(location: Column) -> Column:
    """Key of a place in the eastern list: without source prefix, plant owner, bracketed note, crop and kind of site."""
    out = F.trim(F.regexp_replace(F.coalesce(location, F.lit("")), r"\s+", " "))
    for pattern in EASTERN_CUTS:
        out = F.trim(F.regexp_replace(out, f"(?i){pattern}", ""))
    return F.lower(out)


def in_eastern_ontario(location: Column) -> Column:
    return eastern_key(location).isin(*EASTERN_PLACES)


def spreadsheet_safe(text: Column) -> Column:
    """Cells that a spreadsheet would run as a formula get a leading apostrophe."""
    return F.regexp_replace(text, r"^(?=[=+\-@])", "'")


def email(text: Column) -> Column:
    """Lower-cased address, null if it isn't one."""
    return nonempty(F.regexp_extract(F.lower(F.trim(text)), r"^[^@\s]+@[^@\s]+\.[^@\s]+$", 0))
