"""Rows made of landed rows: owners of assessor features, look-ups for a geocoder, forfeited parcels of pages, lists with their details, published bands, and moves of unresolved events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import addresses, notices
from groundwork.functions.ids import is_stub
from groundwork.operators.matching import street_parts
from groundwork.operators.resolve import resolve_unique, unique_index, within_radius

# Channels that are not shown, those that a comparison needs, and the least sales of a band.
HIDDEN, NEEDED, LEAST_SALES = ("transfer_non_market", "seller_financed"), ("direct_standard", "reo_resale"), 15
STATE = "MN"


def filled(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def owner_rows(features: DataFrame) -> DataFrame:
    """Owner and mailing address of features (county, parcel_id, site, owner, taxpayer, line1, line2, line3); features without a name give none.

    The last line that reads as city, state and zip ends the mailing address, the line before it is its street.
    Absent and out of state are null where the address or the state is not known.
    """
    place3, place2 = addresses.city_state_zip(F.col("line3")), addresses.city_state_zip(F.col("line2"))
    third, second = place3["zip"].isNotNull(), place2["zip"].isNotNull()
    name = F.coalesce(filled("owner"), filled("taxpayer"))
    rows = features.withColumns({"__name": name, "__street": F.when(third, filled("line2")).when(second, filled("line1")), "__place": F.when(third, place3).when(second, place2)})
    mail, site = addresses.street_line(F.col("__street")), addresses.street_line(F.col("site"))
    return rows.filter("__name is not null").select(
        "county", "parcel_id", F.col("__name").alias("owner_name"), notices.owner_class(F.col("__name")).alias("owner_type"), F.col("__street").alias("mailing_address"), F.col("__place.city").alias("mailing_city"), F.col("__place.state").alias("mailing_state"), F.col("__place.zip").alias("mailing_zip"),
        (mail != site).alias("is_absentee"), (F.col("__place.state") != STATE).alias("is_out_of_state"),
    )


def geocode_queries(parcels: DataFrame) -> DataFrame:
    """county, parcel_id, query of parcels without a place whose address has a number and a word, and whose city is known."""
    asked = parcels.filter("lat is null").filter(F.col("address").rlike("[0-9]") & F.col("address").rlike("(?i)[a-z]{3}") & (F.coalesce("city", F.lit("")) != ""))
    built = F.concat_ws(", ", F.substring_index("address", ",", 1), "city", F.concat_ws(" ", F.lit(STATE), filled("zip")))
    return asked.select("county", "parcel_id", F.when(F.col("address").rlike("(?i), *(MN|Minnesota)"), F.col("address")).otherwise(built).alias("query"))


def forfeited(cells: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Rows of page tables (``readers.html_tables``) that look like forfeited parcels: three cells at least, the first of eight signs or more with a digit."""
    first = F.get("cells", F.lit(0))
    return cells.filter((F.size("cells") >= 3) & (F.length(first) >= 8) & first.rlike("[0-9]")).select(*carry, first.alias("parcel_id"), "cells")


def with_details(listed: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Rows of a list with what their detail page says, ``detail`` as a map of its labels; a row without a page stays, with no detail.

    ``details`` are label and value rows of pages; of a label that is there twice the first counts.
    """
    by_page = details.filter(F.coalesce("label", F.lit("")) != "").groupBy(key, "label").agg(F.min_by("value", "row_no").alias("value"))
    maps = by_page.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("detail"))
    return listed.join(maps, key, "left")


def shown_bands(bands: DataFrame, asked: DataFrame) -> DataFrame:
    """county, scope, channel, n and percentiles for each asked county: its own bands if both needed channels have enough sales, else the state's, else none.

    ``bands`` have county null for the state. Scope is all or nothing: half a comparison is not shown.
    """
    usable = bands.filter(~F.col("channel").isin(*HIDDEN) & (F.coalesce("n", F.lit(0)) >= LEAST_SALES))
    whole = usable.groupBy("county").agg(F.count_distinct(F.when(F.col("channel").isin(*NEEDED), F.col("channel"))).alias("__k")).filter(F.col("__k") == len(NEEDED)).select("county")
    own = asked.select("county").distinct().join(whole.filter("county is not null"), "county", "left_semi")
    state = usable.filter("county is null").drop("county")
    state_ok = whole.filter("county is null").agg(F.count(F.lit(1))).scalar() > 0
    ours = usable.join(own, "county", "left_semi").withColumn("scope", F.col("county").cast("string"))
    # every county left over has the state's bands: a few rows, the same for all
    few = state.agg(F.array_sort(F.collect_list(F.struct(*sorted(state.columns)))).alias("__b"))
    others = asked.select("county").distinct().join(own, "county", "left_anti").filter(state_ok)
    others = others.withColumn("__b", few.scalar()).select("county", F.explode("__b").alias("__e")).select("county", "__e.*").withColumn("scope", F.lit("minnesota"))
    return ours.select(*others.columns).unionByName(others)


def normalised_rekey(events: DataFrame, parcels: DataFrame, source: str) -> DataFrame:
    """id, parcel_id: unresolved events of a source whose number, digits only, is that of exactly one real parcel of the county."""
    bare = F.nullif(F.regexp_replace("parcel_id", "[^0-9]", ""), F.lit(""))
    open_ = events.filter(F.col("source") == source).join(parcels.select("county", "parcel_id"), ["county", "parcel_id"], "left_anti").withColumn("__digits", bare).filter(~is_stub(F.col("parcel_id"))).select("id", "county", "__digits")
    spine = parcels.filter(~is_stub(F.col("parcel_id"))).select("county", bare.alias("__digits"), "parcel_id")
    return resolve_unique(open_, spine, ["county", "__digits"], "parcel_id").filter("status = 'match'").select("id", "parcel_id")


def near_house(stubs: DataFrame, parcels: DataFrame, metres: float = 250) -> DataFrame:
    """stub, parcel_id: the one parcel within so many metres (lat, lng; lat2, lng2) with the same house number and street; two are none."""
    part = lambda rows, a, b: rows.withColumn("__s", street_parts(F.col("address"))).filter("__s.house is not null").withColumns({a: F.col("__s.house"), b: F.col("__s.street")}).drop("__s", "address")
    left, right = part(stubs, "__h1", "__t1"), part(parcels, "__h2", "__t2")
    pairs = within_radius(left, right, metres).filter("__h1 = __h2 and __t1 = __t2")
    return unique_index(pairs, ["stub"], "parcel_id").filter("n_targets = 1").select("stub", "parcel_id")
