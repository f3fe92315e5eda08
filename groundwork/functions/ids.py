"""Parcel identifiers and county names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits that a county's parcel number must have, and the counties whose
# number is digits of any length.
PID_LENGTHS = {"hennepin": 13, "ramsey": 12, "fillmore": 9}
PID_DIGITS = ("wabasha",)
#: Fewer signs than this are a fragment, not a parcel number.
LEAST_SIGNS = 6
# County names with a second spelling.
COUNTY_ALIASES = {"saint_louis": "st_louis"}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def pid_digits(value: Column) -> Column:
    """Digits of a parcel number; null if there are too few to be one."""
    d = digits(value)
    return F.when(F.length(d) >= LEAST_SIGNS, d)


def parcel_id(county: Column, raw: Column) -> Column:
    """struct(id, error): the canonical number, or why there is none.

    A 12-digit Hennepin number has lost its leading zero. Counties without a rule of
    their own keep letters and digits in lower case.
    """
    county = F.lower(F.trim(county))
    d = digits(raw)
    d13 = F.when((county == "hennepin") & (F.length(d) == 12), F.lpad(d, 13, "0")).otherwise(d)
    plain = F.lower(F.regexp_replace(raw, r"[^a-zA-Z0-9]", ""))
    wanted = F.lit(None).cast("int")
    for name, n in PID_LENGTHS.items():
        wanted = F.when(county == name, n).otherwise(wanted)
    any_digits = county.isin(*PID_DIGITS)
    found = F.when(wanted.isNotNull(), d13).when(any_digits, d).otherwise(plain)
    error = (
        F.when(raw.isNull() | (raw == ""), "empty")
        .when(wanted.isNotNull() & (F.length(d13) != wanted), "wrong length")
        .when(wanted.isNull() & (F.length(found) == 0), "empty")
        .when(wanted.isNull() & ~any_digits & (F.length(found) < LEAST_SIGNS), "too short")
    )
    return F.struct(F.when(error.isNull(), found).alias("id"), error.alias("error"))


def county_slug(name: Column) -> Column:
    """'St. Louis County' and 'Saint Louis' are both st_louis; null if nothing usable is left."""
    bare = F.trim(F.regexp_replace(name, r"(?i)\s*\b(county|counties)\b\s*", " "))
    slug = F.btrim(F.regexp_replace(F.lower(bare), r"[^a-z0-9]+", "_"), F.lit("_"))
    for alias, real in COUNTY_ALIASES.items():
        slug = F.when(slug == alias, real).otherwise(slug)
    return F.when(slug != "", slug)


def is_stub(parcel: Column) -> Column:
    """A made-up number that stands in for an unresolved parcel."""
    return F.coalesce(parcel.contains("-FC-"), F.lit(False))


def effective_pid(parcel: Column, published: Column, foreclosure: Column) -> Column:
    """The stored number if it is real; a foreclosure's stub gives way to the published number's digits."""
    return F.when(parcel.isNotNull() & ~is_stub(parcel), parcel).when(foreclosure, F.coalesce(F.nullif(digits(published), F.lit("")), parcel)).otherwise(parcel)
