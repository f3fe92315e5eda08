"""Address keys as column expressions. The variants answer different questions and are not interchangeable."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street types and their short forms.
STREET_SHORT = {
    "AVENUE": "AVE", "STREET": "ST", "DRIVE": "DR", "ROAD": "RD", "LANE": "LN", "COURT": "CT",
    "CIRCLE": "CIR", "BOULEVARD": "BLVD", "PLACE": "PL", "PARKWAY": "PKWY", "HIGHWAY": "HWY",
    "TERRACE": "TER", "TRAIL": "TRL", "CROSSING": "XING", "HEIGHTS": "HTS", "POINT": "PT", "SQUARE": "SQ",
}
# Compass words and their short forms.
COMPASS_SHORT = {"NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW", "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W"}
# Words that start a unit.
UNIT_WORDS = ("APT", "UNIT", "STE", "SUITE")
# Street types that a comparison key leaves out, long or short.
STREET_TYPES = "ROAD RD STREET ST AVENUE AVE DRIVE DR LANE LN COURT CT BOULEVARD BLVD PLACE PL CIRCLE CIR TERRACE TER PARKWAY PKWY HIGHWAY HWY TRAIL TRL PATH WAY".split()


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(pairs.items())))


def normalize_address(raw: Column) -> Column:
    """Upper case, first comma part, nothing from a unit mark on, short street types and compass words."""
    head = F.substring_index(F.substring_index(F.upper(F.coalesce(raw, F.lit(""))), "#", 1), ",", 1)
    words = _words(F.regexp_replace(head, r"[^A-Z0-9 ]", " "))
    unit = F.array_min(F.transform(F.array(*map(F.lit, UNIT_WORDS)), lambda u: F.nullif(F.array_position(words, u), F.lit(0))))
    words = F.when(unit.isNull(), words).otherwise(F.slice(words, 1, (unit - 1).cast("int")))
    short = _lookup({**STREET_SHORT, **COMPASS_SHORT})
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")


def house_number(normalized: Column) -> Column:
    """Leading number of a normalised address; null if it has none."""
    return F.nullif(F.regexp_extract(normalized, r"^([0-9]+)( |$)", 1), F.lit(""))


def street_part(normalized: Column) -> Column:
    return F.regexp_replace(normalized, r"^[0-9]+( |$)", "")


def is_searchable(raw: Column) -> Column:
    """A number and a street word: enough to look for one house."""
    n = normalize_address(raw)
    return (F.length(n) >= 4) & house_number(n).isNotNull() & (F.length(street_part(n)) >= 2)


def addr_key(raw: Column) -> Column:
    """Comparison key: letters and digits of the first comma part, street types dropped, compass words short."""
    head = F.upper(F.regexp_replace(F.substring_index(F.coalesce(raw, F.lit("")), ",", 1), r"[^A-Za-z0-9]", " "))
    kept = F.filter(_words(head), lambda w: ~w.isin(*STREET_TYPES))
    short = _lookup(COMPASS_SHORT)
    return F.array_join(F.transform(kept, lambda w: F.coalesce(F.try_element_at(short, w), w)), "")


def two_layer_key(raw: Column) -> Column:
    """Key of two layers of one county: upper case, nothing from a # on, street types and compass words short, word for word."""
    words = _words(F.upper(F.substring_index(F.trim(F.coalesce(raw, F.lit(""))), "#", 1)))
    short = _lookup({**STREET_SHORT, **COMPASS_SHORT})
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")


def street_line(raw: Column) -> Column:
    """Street of a mailing address: upper case, single spaces, without a unit at its end ('#12', 'UNIT 4'); null if blank."""
    words = _words(F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), "#", " #")))
    n = F.size(words)
    marked = F.when(F.get(words, n - 1).startswith("#") & (F.length(F.get(words, n - 1)) > 1), 1).when((n > 2) & F.get(words, n - 2).isin("#", *UNIT_WORDS), 2).otherwise(0)
    return F.nullif(F.array_join(F.slice(words, 1, F.greatest(n - marked, F.lit(0))), " "), F.lit(""))


# More words that a rekey leaves out: a unit with its number at the end, compass words at the end, street types anywhere.
REKEY_UNITS = (*UNIT_WORDS, "APARTMENT")
REKEY_TYPES = "ST AVE LN CIR BLVD DR CT PL TRL PKWY TER RD WAY STREET AVENUE LANE CIRCLE BOULEVARD DRIVE COURT PLACE TRAIL PARKWAY TERRACE ROAD".split()


def rekey_key(raw: Column) -> Column:
    """Loose key of a rekey: letters and digits, without street types, without compass words and a unit at the end."""
    words = _words(F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), r"[^A-Z0-9-]", " "))
    n = F.size(words)
    is_unit = F.get(words, n - 2).isin(*REKEY_UNITS)
    words = F.when(n < 2, words).when(is_unit, F.slice(words, 1, F.greatest(n - 2, F.lit(0)))).when(F.get(words, n - 1).isin(*REKEY_UNITS), F.slice(words, 1, n - 1)).otherwise(words)
    words = F.filter(words, lambda w: ~w.isin(*REKEY_TYPES))
    compass = [*COMPASS_SHORT, *COMPASS_SHORT.values()]
    m = F.size(words)
    words = F.when((m > 0) & F.get(words, m - 1).isin(*compass), F.slice(words, 1, F.greatest(m - 1, F.lit(0)))).otherwise(words)
    return F.regexp_replace(F.array_join(words, ""), "[^A-Z0-9]", "")


def one_house(raw: Column) -> Column:
    """False for lists of addresses and for addresses without a house number: these are never resolved."""
    words = _words(F.lower(F.regexp_replace(raw, ";", " ; ")))
    listed = F.arrays_overlap(words, F.array(F.lit(";"), F.lit("&"), F.lit("and")))
    return F.coalesce((F.size(words) > 1) & F.get(words, 0).try_cast("decimal(38,0)").isNotNull() & ~F.get(words, 0).rlike("[^0-9]") & ~listed, F.lit(False))


def masked(raw: Column) -> Column:
    """The house number's first digit is kept, the others are X: 4120 Oak St is 4XXX Oak St."""
    number = F.regexp_extract(raw, r"^\s*([0-9]+)", 1)
    rest = F.regexp_replace(raw, r"^\s*[0-9]+", "")
    return F.when(number == "", raw).otherwise(F.concat(F.substring(number, 1, 1), F.repeat(F.lit("X"), F.length(number) - 1), rest))


def city_state_zip(line: Column, most: int = 5) -> Column:
    """struct(city, state, zip) of 'CITY ST 55401-1234'; nulls if the line has another form. Codes of up to ``most`` digits are read where they are not postal ones."""
    pattern = rf"^\s*(.*?)[, ]+([A-Za-z]{{2}})[, ]+([0-9]{{5,{most}}})(?:-?[0-9]{{4}})?\s*$"
    part = lambda k: F.nullif(F.regexp_extract(line, pattern, k), F.lit(""))
    return F.struct(part(1).alias("city"), F.upper(part(2)).alias("state"), part(3).alias("zip"))


def title_case(text: Column) -> Column:
    """First letter of every run of letters in upper case, the others in lower case."""
    marked = F.regexp_replace(F.lower(text), r"(\p{L}+)", "\u0001$1")
    parts = F.split(marked, "\u0001")
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, F.length(p)))), ""))
