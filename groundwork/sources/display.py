"""What each source's raw JSON shows in the property list, as paths by column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A value is the first that there is: "$.a" a path in the JSON, "@a" a column of the row, "=a" a text, or a function of nothing.
Value = Sequence[str | Callable[[], Column]]
COLUMNS = (
    "address", "city", "zip", "owner", "sale_date", "sale_time", "amount", "status", "tax_parcel_no", "original_principal", "municipality", "lat", "lng", "neighborhood", "registered_date", "market_value", "earliest_delq_year", "dwelling_type", "ward", "owner_mailing", "is_absentee", "homestead",
    "annual_tax", "special_assessment_due", "redemption_ends_at", "mortgagee", "law_firm", "type_of_sale", "redemption_basis", "redemption_abandonment_caveat", "redemption_months",
    "probate_case_number", "probate_representative", "probate_hearing_date", "probate_decedent", "probate_match_basis", "probate_notice_url",
)
NUMBERS = ("amount", "original_principal", "lat", "lng", "market_value", "annual_tax")


def at(path: str) -> Column:
    return F.get_json_object("raw", path)


def names(between: str) -> Column:
    """The names of the borrowers who have one."""
    people = F.from_json(at("$.mortgagors"), "array<struct<display string>>")
    shown = F.transform(people, lambda p: F.regexp_replace(p["display"], r"^\s+|\s+$", ""))
    return F.nullif(F.array_join(F.filter(shown, lambda n: n != ""), between), F.lit(""))


def iso_day() -> Column:
    """Month/day/year as an ISO day, three other parts as they are, the day of the event for anything else."""
    text = at("$.attributes.VACANT_AS_OF")
    parts = F.split(text, "/")
    n = F.transform(parts, lambda p: F.trim(p).try_cast("int"))
    iso = F.when(F.forall(n, lambda p: p.isNotNull()), F.format_string("%04d-%02d-%02d", F.get(n, F.lit(2)), F.get(n, F.lit(0)), F.get(n, F.lit(1))))
    return F.when(F.size(parts) == 3, F.coalesce(iso, text)).otherwise(F.col("event_date").cast("string"))


def vacant_status() -> Column:
    label = {"1": "Category 1 (sound)", "2": "Category 2 (boarded)", "3": "Category 3 (nuisance)"}
    kind = F.trim(at("$.attributes.VB_CATEGORY"))
    found = F.element_at(F.create_map(*[x for pair in label.items() for x in map(F.lit, pair)]), kind)
    return F.coalesce(found, F.nullif("title", F.lit("")), F.lit("Vacant"))


def roll_status() -> Column:
    return F.when(F.col("event_type") == "tax_forfeit", "Tax-forfeited").when(F.col("event_type") == "tax_assessment", "Special assessment").otherwise("Tax-delinquent")


def list_status() -> Column:
    return F.when(at("$.sale_status") == "otc_available", "Available over the counter").otherwise("On auction list")


def sale_status() -> Column:
    return F.when(truthy(at("$.postponed")), "Scheduled sale (postponed)").otherwise("Scheduled sale")


def estate_status() -> Column:
    who = at("$.decedent")
    return F.when(truthy(who), F.concat(F.lit("Estate of "), who, F.lit(" in probate"))).otherwise("Owner of record is a decedent in probate")


def roll_amount() -> Column:
    return F.coalesce(at("$.market_value").try_cast("double"), F.col("event_value").cast("double")).cast("string")


def ward_name() -> Column:
    ward = at("$.attributes.WARD")
    return F.when(truthy(ward), F.concat(F.lit("Ward "), ward))


def truthy(value: Column) -> Column:
    """There is a value, and it is neither empty nor zero nor false."""
    return F.coalesce(~value.isin("", "0", "0.0", "false", "[]", "{}"), F.lit(False))


# Where each source keeps what is shown.
_GIS = {"owner_mailing": ["$.detail.gis_owner_mailing"], "is_absentee": ["$.detail.gis_is_absentee"], "homestead": ["$.detail.gis_homestead"], "market_value": ["$.detail.gis_market_value"]}
_PARTIES = {"mortgagee": ["$.mortgagee"], "law_firm": ["$.lawFirm"]}
_VACANT = {"address": ["$.attributes.ADDRESS"], "city": ["=Saint Paul"], "amount": ["@event_value"], "status": [vacant_status], "tax_parcel_no": ["$.attributes.PIN"], "municipality": ["=Saint Paul"], "lat": ["$.attributes.LATITUDE"], "lng": ["$.attributes.LONGGITUDE"], "neighborhood": [ward_name], "registered_date": [iso_day], "dwelling_type": ["$.dwelling_type", "$.attributes.DWELLING_TYPE"], "ward": ["$.attributes.WARD"]}
_ROLL = {"address": ["$.property_address"], "city": ["$.property_city", "$.municipality"], "zip": ["$.property_zip"], "owner": ["$.owner_name"], "amount": [roll_amount], "status": [roll_status], "tax_parcel_no": ["@parcel_id"], "municipality": ["$.municipality"], "market_value": ["$.market_value"], "earliest_delq_year": ["$.earliest_delq_year"], "owner_mailing": ["$.owner_mailing"], "is_absentee": ["$.is_absentee"], "annual_tax": ["$.annual_tax"], "special_assessment_due": ["$.special_assessment_due"]}
_LEGAL = {"address": ["$.property_address"], "city": ["$.property_city"], "zip": ["$.property_zip"], "sale_date": ["$.sale_date", "@event_date"], "sale_time": ["$.sale_time"], "amount": ["$.amount_due"], "status": [sale_status], "tax_parcel_no": ["@parcel_id"], "original_principal": ["$.original_principal"], "municipality": ["$.property_city"], "redemption_basis": ["$.redemption_basis"], "redemption_abandonment_caveat": ["$.redemption_abandonment_caveat"], "redemption_months": ["$.redemption_months"]}
_PROBATE = {"address": ["$.property_address"], "city": ["$.property_city"], "owner": ["$.matched_owner_name"], "status": [estate_status], "tax_parcel_no": ["@parcel_id"], "municipality": ["$.property_city"], "registered_date": ["$.published_date", "@event_date"], "market_value": ["$.emv_total"], "dwelling_type": ["$.property_type"], "owner_mailing": ["$.owner_mailing_address"], "is_absentee": ["$.owner_is_absentee"], "probate_case_number": ["$.case_number"], "probate_representative": ["$.personal_representatives[0].name"], "probate_hearing_date": ["$.hearing_date"], "probate_decedent": ["$.decedent"], "probate_match_basis": ["$.match_basis"], "probate_notice_url": ["$.notice_url"]}
DISPLAY: dict[str, Mapping[str, Value]] = {
    "anoka_sheriff": {**_GIS, "address": ["$.list.address", "$.detail.detail_address"], "city": ["$.list.city"], "zip": ["$.list.zip"], "owner": ["$.detail.gis_owner", "$.detail.owner_name"], "sale_date": ["$.list.scheduled_date", "@event_date"], "sale_time": ["$.detail.sale_time"], "amount": ["@event_value"], "status": ["$.detail.status", "=Active"], "tax_parcel_no": ["$.detail.tax_parcel_no"], "original_principal": ["$.detail.original_principal"], "municipality": ["$.list.city"]},
    "hennepin_sheriff": {**_GIS, **_PARTIES, "address": ["$.address"], "city": ["$.city"], "owner": ["$.detail.gis_owner", lambda: names("; ")], "sale_date": ["$.dateOfSale", "@event_date"], "amount": ["$.finalBidAmount", "@event_value"], "status": ["=Sold"], "municipality": ["$.city"], "redemption_ends_at": ["$.redemptionExpirationDate"], "type_of_sale": ["$.typeOfSale"]},
    "dakota_sheriff": {**_GIS, "address": ["$.attributes.GeoAddress"], "city": ["$.attributes.GeoCity", "$.attributes.CITYNAME"], "owner": ["$.detail.gis_owner", lambda: F.nullif(F.regexp_replace(at("$.attributes.Mortgagor"), r"^\s+|\s+$", ""), F.lit(""))], "sale_date": ["@event_date"], "amount": ["$.attributes.SaleAmount", "@event_value"], "status": ["=Sold"], "tax_parcel_no": ["$.detail.gis_pid"], "municipality": ["$.attributes.GeoCity"], "lat": ["$.geometry.y"], "lng": ["$.geometry.x"]},
    "washington_sheriff": {**_GIS, "address": ["$.detail.gis_site_address"], "city": ["$.detail.gis_city"], "zip": ["$.detail.gis_zip"], "owner": ["$.detail.gis_owner", "$.sale.owner"], "sale_date": ["$.sale.sale_date", "@event_date"], "amount": ["@event_value"], "status": ["=Sold"], "tax_parcel_no": ["$.detail.gis_pid", "$.sale.pid"], "municipality": ["$.detail.gis_city"]},
    "startribune_legal": {**_PARTIES, "address": ["$.address"], "city": ["$.city"], "owner": [lambda: names("; ")], "sale_date": ["$.dateOfSale", "@event_date"], "amount": ["$.amount_due", "@event_value"], "status": ["=Scheduled sale"], "tax_parcel_no": ["$.detail.gis_pid"], "municipality": ["$.city"]},
    "mnpublicnotice": {**_PARTIES, "address": ["$.address"], "city": ["$.city"], "zip": ["$.zip"], "owner": [lambda: names(" & ")], "sale_date": ["$.dateOfSale", "@event_date"], "amount": ["$.amount_due", "@event_value"], "tax_parcel_no": ["$.detail.gis_pid", "@parcel_id"], "municipality": ["$.city"], "registered_date": ["@event_date"]},
    "mpls_vbr": {"address": ["$.attributes.Address"], "city": ["=Minneapolis"], "amount": ["@event_value"], "status": ["$.attributes.Property_s"], "tax_parcel_no": ["$.attributes.APN_Txt"], "municipality": ["=Minneapolis"], "lat": ["$.attributes.Latitude"], "lng": ["$.attributes.Longitude"], "neighborhood": ["$.neighborhood"], "registered_date": ["$.condemned_date", "@event_date"]},
    "mpls_311": {"address": ["$.address", "$.attributes.Display"], "city": ["=Minneapolis"], "status": ["$.attributes.Inspection_Result", "$.inspection_result"], "tax_parcel_no": ["$.attributes.APN", "@parcel_id"], "municipality": ["=Minneapolis"], "lat": ["$.attributes.Latitude"], "lng": ["$.attributes.Longitude"], "registered_date": ["@event_date"]},
    "saint_paul_vacant": _VACANT,
    "saint_paul_dsi": _VACANT,
    "hennepin_tax_roll": _ROLL,
    "ramsey_tax_roll": _ROLL,
    "ramsey_tfl": {"address": ["$.property_address"], "city": ["$.property_city"], "amount": ["$.appraised_value"], "status": [list_status], "tax_parcel_no": ["@parcel_id"], "municipality": ["$.property_city"], "registered_date": ["$.list_date"], "dwelling_type": ["$.property_type"]},
    "postbulletin_legal": _LEGAL,
    "fillmore_legal": _LEGAL,
    "olmsted_delq_list": {"amount": ["$.total_tax_penalties"], "status": ["=On the delinquent tax list"], "tax_parcel_no": ["@parcel_id"], "municipality": ["$.city_section"], "registered_date": ["$.published"], "earliest_delq_year": ["$.pay_year"]},
    "fillmore_probate": _PROBATE,
    "olmsted_probate": _PROBATE,
}
#: Sources that are not listed.
OTHER: Mapping[str, Value] = {"address": ["$.address", "$.attributes.Address"], "city": ["$.city", "$.attributes.City"], "zip": ["$.zip"], "owner": ["$.owner_name", "$.owner"], "sale_date": ["@event_date"], "amount": ["@event_value"], "tax_parcel_no": ["@parcel_id"], "municipality": ["$.municipality", "$.city"], "registered_date": ["@event_date"]}


def _value(value: Value) -> Column:
    def one(v: str | Callable[[], Column]) -> Column:
        if callable(v):
            return v()
        return at(v) if v[0] == "$" else F.col(v[1:]).cast("string") if v[0] == "@" else F.lit(v[1:])

    *first, last = [one(v) for v in value]
    return F.coalesce(*[F.when(truthy(v), v) for v in first], last)


def display(rows: DataFrame, columns: Sequence[str] = COLUMNS, listed: Mapping[str, Mapping[str, Value]] = DISPLAY, other: Mapping[str, Value] = OTHER) -> DataFrame:
    """The rows (source, raw as JSON, event_type, event_date, event_value, parcel_id, title) with the columns of the list.

    A column that a source does not have is null, and so is a number that is none. Each row's
    JSON is read at its own source's paths only, and only for the columns asked for.
    """
    nothing = F.lit(None).cast("string")

    def column(c: str) -> Column:
        by_paths: dict[int, tuple[list[str], Value]] = {}
        for source, paths in listed.items():  # sources that share a place share a branch
            if c in paths:
                by_paths.setdefault(id(paths[c]), ([], paths[c]))[0].append(source)
        otherwise = F.when(F.coalesce(~F.col("source").isin(*listed), F.lit(True)), _value(other[c])) if c in other else nothing
        found = otherwise
        for sources, value in by_paths.values():
            found = F.when(F.col("source").isin(*sources), _value(value)).otherwise(found)
        return (found.try_cast("double") if c in NUMBERS else found).alias(c)

    return rows.select("*", *[column(c) for c in columns])
