"""Facts of legal notices: each field has its labels and the kind of value that stands behind one of them.

A pattern is made of the two: a label, what may stand between, and the value. Labels are tried in
their order, the first that has a value wins. A fact is the text of the notice as written; its
day, amount or number is read from that text, and a fact that does not stand in the notice
(whatever the white space) is not given out.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import coerce, notices

MONTHS = "January February March April May June July August September October November December".split()
#: Values by kind. Each is one group.
VALUES = {
    "day": rf"((?:{'|'.join(MONTHS)})\s+[0-9]{{1,2}},\s+[0-9]{{4}})",
    "clock": r"([0-9]{1,2}:[0-9]{2}\s*[AaPp]\.?\s*[Mm]\.?)",
    "money": r"\$\s*([0-9][0-9,]*(?:\.[0-9]{2})?)",
    "parcel": r"([A-Za-z]{0,3}[0-9][0-9.\-]{5,28}[0-9])",
    "period": r"((?:[0-9]{1,2}|[A-Za-z]+)\s*(?:\([0-9]{1,2}\)\s*)?months?)",
    "name": r"([A-Z][^:;\n]{2,119}?)",
    "place": r"([^:;\n]{5,120}?)",
    "number": r"([0-9][0-9-]{2,20})",
}


@dataclass(frozen=True)
class Field:
    """``labels`` in the order in which they are tried; ``gap``: what may stand between, in signs, none of them an end of a sentence; ``until``: where a name or place ends."""

    name: str
    kind: str
    labels: tuple[str, ...]
    gap: int = 6
    until: tuple[str, ...] = ()


# Labels that notices use, and what ends a name or a place.
ENDS = ("MORTGAGEE", "PROPERTY ADDRESS", "COUNTY IN WHICH", "TAX PARCEL", "PROPERTY TAX ID", "PROPERTY IDENTIFICATION", "PID", "ORIGINAL PRINCIPAL", "DATE OF MORTGAGE", "THE AMOUNT", "and legally described", "legally described", "and shall be sold")
FIELDS = (
    Field("parcel_id", "parcel", ("PID #", "PID:", "PROPERTY TAX ID NO.", "PROPERTY TAX IDENTIFICATION NUMBER", "TAX PARCEL NO.", "TAX PARCEL I.D. NO.", "PROPERTY IDENTIFICATION NUMBER", "PARCEL ID", "PARCEL NO.")),
    Field("sale_day", "day", ("DATE AND TIME OF SALE", "will sell at public auction", "public auction"), gap=160),
    Field("sale_time", "clock", ("DATE AND TIME OF SALE", "will sell at public auction", "public auction"), gap=200),
    Field("postponed_to", "day", ("postponed until", "postponed to"), gap=16),
    Field("vacate_by", "day", ("DATE TO VACATE", "must vacate"), gap=300),
    Field("redemption", "period", ("redemption",), gap=100),
    Field("amount_due", "money", ("AMOUNT DUE AND CLAIMED TO BE DUE", "AMOUNT CLAIMED TO BE DUE", "AMOUNT DUE"), gap=120),
    Field("original_principal", "money", ("ORIGINAL PRINCIPAL AMOUNT SECURED BY THE MORTGAGE", "ORIGINAL PRINCIPAL AMOUNT OF MORTGAGE"), gap=10),
    Field("mortgagor", "name", ("MORTGAGOR(S):", "MORTGAGOR:"), until=ENDS),
    Field("property_address", "place", ("PROPERTY ADDRESS", "ADDRESS OF THE PROPERTY", "ADDRESS OF PROPERTY", "commonly known as", "premises located at", "land located at"), until=ENDS),
    Field("county", "name", ("COUNTY IN WHICH PROPERTY IS LOCATED", "Sheriff of"), until=(*ENDS, "County", ".")),
    Field("attorney_file", "number", ("attorney file no.", "file no.", "file number")),
)


def words(label: str) -> str:
    """A label whose words may stand on several lines."""
    return r"\s+".join(re.escape(w) for w in label.split())


def patterns(field: Field, label: str) -> list[str]:
    """Patterns of a label and its value. A name or place runs to a word that ends it, over lines too; else to the end of its line."""
    head = rf"(?i:{words(label)})" + ("" if label[-1] in ":#" else r"(?![A-Za-z])")
    value = VALUES[field.kind]
    if field.until:
        stops = "|".join(words(u) if u[-1].isalnum() else re.escape(u) for u in field.until)
        over_lines = value.replace(r"\n", "")
        return [rf"{head}[\s:.#]*(?s:{over_lines})(?=[\s,.]*(?i:{stops}))", rf"{head}[\s:.#]*{value}(?=[\s,.]*(?:[;\n]|$))"]
    if field.kind in ("parcel", "number"):
        return [rf"{head}[\s:.#]*{value}(?![0-9A-Za-z])"]
    if field.kind == "money":
        return [rf"{head}[^.$\n]{{0,{field.gap}}}?{value}"]
    return [rf"{head}(?:[^.]|\.(?=\S)|(?<=[AaPp]\.[Mm])\.){{0,{field.gap}}}?(?<![A-Za-z0-9]){value}"]  # in the same sentence


def only(value: Column, ok: Callable[[Column], Column]) -> Column:
    """The value if it is as it should be, else null; it is computed once."""
    return F.get(F.filter(F.array(value), ok), 0)


def fact(text: Column, field: Field, low: Column | None = None) -> Column:
    """The value of the first label that has one, as written; null if there is none or it is not in the text.

    ``low`` is the text in small letters: a pattern is tried only where the words of its label stand.
    """
    low, tried = F.lower(text) if low is None else low, []
    for label in field.labels:
        there = reduce(lambda a, b: a & b, [low.contains(w) for w in label.lower().split()])
        tried += [F.when(there, only(F.regexp_extract(text, p, 1), lambda v: v != "")) for p in patterns(field, label)]
    found = F.coalesce(*tried)
    found = F.trim(F.regexp_replace(found, r"[\s,.]+$", "")) if field.until else found
    return only(found, lambda v: notices.appears(v, text))


def facts(rows: DataFrame, text: str, carry: list[str], fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """``carry``, field, fact (as written), day, amount, number of every fact that is found: one row for each."""
    value, kind = F.col("f.fact"), F.col("f.kind")
    plain = F.regexp_replace(value, r"\s+", " ")
    numbers = F.when(kind == "period", notices.redemption_months(value))
    made = F.array(*[F.struct(F.lit(f.name).alias("field"), F.lit(f.kind).alias("kind"), fact(F.col(text), f, F.col("__low")).alias("fact")) for f in fields])
    rows = rows.select(*carry, *([] if text in carry else [text]), F.lower(text).alias("__low"))
    # the outer form, as the plain one lets Spark ask beforehand whether the list is empty, which computes all facts again
    out = rows.select(*carry, F.explode_outer(F.filter(made, lambda f: f.fact.isNotNull())).alias("f")).filter("f is not null")
    return out.select(*carry, "f.field", "f.fact", F.when(kind == "day", coerce.day(plain)).alias("day"), F.when(kind == "money", coerce.money(value)).alias("amount"), numbers.alias("months"))
