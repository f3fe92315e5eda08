"""Parcels of all counties from their landed features, by a table of field maps: a county is one row of it.

The table is compiled to one expression for each column. It looks up the names that the feature's
county gives to the column and takes the first of them that is filled, so all counties run as
one plan, and a county more is a row more. What has no number or comes from no county of
the table is a reject with its reason.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import addresses, coerce, ids
from groundwork.operators import derive


@dataclass(frozen=True)
class County:
    """Names of a county's fields by column: the first filled one counts; ``house`` are joined to an address. ``prefix`` is where its numbers are looked for in the shared layer."""

    slug: str
    pin: Sequence[str]
    fields: Mapping[str, Sequence[str]] = field(default_factory=dict)
    house: Sequence[str] = ()


# Fields of the counties' layers.
SHARED = {
    "city": ("postcomm", "ctu_name"), "zip": ("zip",), "year_built": ("year_built",), "emv_total": ("emv_total",), "emv_land": ("emv_land",), "emv_building": ("emv_bldg",), "acres": ("acres_poly", "acres_deed"),
    "num_units": ("num_units",), "use_class": ("useclass1",), "school_district": ("school_dst",), "property_type": ("dwell_type", "useclass1"),
}
HOUSE = ("anumberpre", "anumber", "anumbersuf", "st_pre_mod", "st_pre_dir", "st_pre_typ", "st_name", "st_pos_typ", "st_pos_dir")
COUNTIES = (
    County("hennepin", ("PID",), {"city": ("MUNIC_NM",), "zip": ("ZIP_CD",), "year_built": ("BUILD_YR",), "emv_total": ("MKT_VAL_TOT",), "property_type": ("PR_TYP_CD1",), "lat": ("LAT",), "lng": ("LON",)}, ("HOUSE_NO", "FRAC_HOUSE_NO", "STREET_NM")),
    County("ramsey", ("ParcelID",), {"address": ("SiteAddress",), "city": ("SiteCityName",), "zip": ("SiteZIP5",), "year_built": ("YearBuilt",), "emv_total": ("EMVTotal",), "property_type": ("LandUseCode",), "lat": ("Latitude",), "lng": ("Longitude",)}),
    County("dakota", ("PIN",), {"address": ("SITEADDRESS",), "city": ("MUNICIPALITY",), "year_built": ("YEAR_BUILT",), "emv_total": ("TOTALVAL",), "emv_land": ("LANDVAL",), "emv_building": ("BLDGVAL",), "acres": ("TOTAL_ACRES",), "sqft": ("FNSHD_SF",), "use_class": ("USE1_DESC",), "school_district": ("SCHOOL_DST",), "annual_tax": ("TOTAL_TAX",), "last_sale_price": ("SALE_VALUE",), "last_sale_ms": ("SALE_DATE",)}),
    County("washington", ("PIN",), {"address": ("SITUS_ADDRESS",), "city": ("CITY",), "zip": ("ZIP",), "year_built": ("YEAR_BUILT",), "emv_total": ("EMV_TOTAL",), "emv_land": ("EMV_LAND",), "emv_building": ("EMV_BLDG",), "acres": ("ACRES_DEED",), "sqft": ("FIN_SQ_FT",), "num_units": ("NUM_UNITS",), "use_class": ("USE1_DESC",), "school_district": ("SCHOOL_DST",)}),
    County("olmsted", ("PARID",), {"address": ("SiteAddress",), "city": ("SiteCity",), "zip": ("SiteZip5",), "emv_total": ("EMVTotal",), "emv_land": ("EMVLand",), "emv_building": ("EMVBldg",), "acres": ("DeedAcres",), "lot_sqft": ("DeededSqFt",), "num_units": ("LivngUnits",), "use_class": ("Class",), "school_district": ("SchoolDist",)}),
    County("fillmore", ("PIN",), {"address": ("PROPERTYAD",), "city": ("PROPERTYCI",), "zip": ("PROPERTYZI",), "emv_total": ("ESTIMATEDT",), "emv_land": ("ESTIMATEDL",), "emv_building": ("ESTIMATEDB",), "acres": ("DEEDEDACRE", "Acres"), "use_class": ("CLASSDESCR",), "school_district": ("SCHOOLDIST",)}),
    County("wabasha", ("county_pin",), SHARED, HOUSE),
    County("koochiching", ("county_pin",), SHARED, HOUSE),
)

TEXTS = ("use_class", "school_district", "property_type")
AMOUNTS = ("emv_land", "emv_building", "annual_tax", "last_sale_price")


def compiled(counties: Sequence[County], attributes: str, county: str, column: str) -> Column:
    """Value of a column: the first filled field of those that the row's county names; null where it names none."""
    named = {c.slug: c.fields[column] for c in counties if column in c.fields} if column not in ("pin", "house") else {c.slug: getattr(c, column) for c in counties if getattr(c, column)}
    if not named:
        return F.lit(None).cast("string")
    table = F.create_map(*[x for slug, names in named.items() for x in (F.lit(slug), F.array(*map(F.lit, names)))])
    found = F.transform(F.try_element_at(table, F.col(county)), lambda n: coerce.clean(F.try_element_at(F.col(attributes), n)))
    if column == "house":
        return F.nullif(F.array_join(F.filter(found, lambda v: v.isNotNull()), " "), F.lit(""))
    return F.get(F.filter(found, lambda v: v.isNotNull()), 0)


def parcels(features: DataFrame, as_of: Column, counties: Sequence[County] = COUNTIES, county: str = "county", attributes: str = "attributes", ring: str = "ring") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of features (county, attributes map<string,string>, ring array<struct<x, y>>).

    Zero is no value for a total, a year and a count of units; an empty total is land and buildings
    where there is land. Acres beyond the cap are an error. A number that the county's rule
    does not take is kept without white space. Points outside of the state are dropped.
    """
    get = lambda column: compiled(counties, attributes, county, column)
    raw = features.withColumn("__pin", get("pin"))
    known = F.col(county).isin([c.slug for c in counties])
    reason = F.when(~F.coalesce(known, F.lit(False)), "unknown county").when(F.col("__pin").isNull(), "no parcel number")
    raw = raw.withColumn("reason", reason)
    bare = F.regexp_replace("__pin", r"\s+", "")
    amount = lambda column: coerce.money(get(column))
    land, building = amount("emv_land"), amount("emv_building")
    total = F.coalesce(coerce.positive(amount("emv_total")), F.when(land > 0, land + F.coalesce(building, F.lit(0)))).cast("decimal(18,2)")
    middle = derive.centroid(F.col(ring))
    lat, lng = F.coalesce(get("lat").try_cast("double"), middle["y"]), F.coalesce(get("lng").try_cast("double"), middle["x"])
    inside = derive.in_box(lat, lng)
    lot = F.coalesce(coerce.positive(coerce.whole(get("lot_sqft"))), coerce.square_feet(get("acres").try_cast("double")).cast("long"))
    good = raw.filter("reason is null").select(
        F.col(county).alias("county"),
        F.coalesce(ids.parcel_id(F.col(county), F.col("__pin"))["id"], bare).alias("parcel_id"),
        F.coalesce(get("address"), get("house")).alias("address"),
        addresses.title_case(get("city")).alias("city"),
        F.nullif(F.regexp_extract(get("zip"), r"^([0-9]{5})", 1), F.lit("")).alias("zip"),
        F.when(inside, lat).alias("lat"),
        F.when(inside, lng).alias("lng"),
        coerce.plausible_year(coerce.positive(coerce.whole(get("year_built"))), as_of).alias("year_built"),
        total.alias("emv_total"),
        *[amount(c).alias(c) for c in AMOUNTS],
        coerce.day_of_epoch_ms(coerce.whole(get("last_sale_ms"))).alias("last_sale_date"),
        lot.alias("lot_sqft"),
        coerce.positive(coerce.whole(get("sqft"))).alias("sqft"),
        coerce.positive(coerce.whole(get("num_units"))).alias("num_units"),
        *[get(c).alias(c) for c in TEXTS],
        F.to_json(F.map_filter(attributes, lambda _, v: v.isNotNull() & (F.trim(v) != ""))).alias("raw"),
    )
    return good, raw.filter("reason is not null").select(F.col(county).alias("county"), F.col(attributes).alias("attributes"), "reason")
