"""The event view with its parcel, and the listings that buyers browse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.ids import county_slug, is_stub
from groundwork.operators.resolve import exact_or_latest

# Dollars of a value bucket, and the kind of event that a debt comes from.
BUCKET, SALE = 50_000, "sheriff_sale"
#: What the view takes from a parcel.
PARCEL_COLUMNS = ("year_built", "sqft", "lot_sqft", "emv_total", "emv_land", "emv_building", "annual_tax", "last_sale_price", "last_sale_date", "num_units", "use_class", "property_type", "school_district")


def at(raw: str, path: str) -> Column:
    return F.nullif(F.get_json_object(raw, path), F.lit(""))


def distress_with_parcel(events: DataFrame, source_counties: DataFrame, parcels: DataFrame, sales: DataFrame, as_of: Column, columns: tuple[str, ...] = PARCEL_COLUMNS) -> DataFrame:
    """One row for each event: its effective parcel and county, that parcel's columns, days left to redeem and the equity.

    The parcel is the stored number if it is no placeholder, else the number that the raw record
    publishes, else the placeholder. The county is the stored one, that of the source (one that
    serves many has none), or that of the raw record. Days left are those of the parcel's sale of the event's day,
    else of its latest sale. Source, parcel and sale are made one row for each key before they are joined, so
    neither a parcel that is there twice nor one with many sales adds rows.
    """
    own = F.when(~is_stub(F.col("parcel_id")), F.col("parcel_id"))
    effective = F.coalesce(own, at("raw", "$.detail.gis_pid"), F.col("parcel_id"))
    by_source = source_counties.groupBy(F.col("source").alias("__source")).agg(F.max("county").alias("__slug"))
    rows = events.join(by_source, F.col("source") == F.col("__source"), "left")
    county = F.coalesce("county", "__slug", county_slug(F.get_json_object("raw", "$.detail.county")))
    rows = rows.withColumn("eff_parcel_id", effective).withColumn("county_slug", county).drop("__source", "__slug")
    kept = parcels.groupBy(F.col("county").alias("__county"), F.col("parcel_id").alias("__parcel")).agg(F.min(F.struct(*columns)).alias("__p"))
    rows = rows.join(kept, (F.col("county_slug") == F.col("__county")) & (F.col("eff_parcel_id") == F.col("__parcel")), "left").drop("__county", "__parcel")
    rows = rows.select(*[c for c in rows.columns if c != "__p"], *[F.col(f"__p.{c}").alias(c) for c in columns])
    ends = sales.select(F.col("county").alias("county_slug"), F.col("parcel_id").alias("eff_parcel_id"), "sale_date", F.col("redemption_date").alias("__ends"))
    rows = exact_or_latest(rows, ends, ["county_slug", "eff_parcel_id"], "event_date", "sale_date", "__ends").drop("found")
    left = F.datediff("__ends", as_of)
    return rows.select(
        *[c for c in rows.columns if c != "__ends"],
        left.alias("redemption_days_left"),
        F.when(left.isNull(), 2).when(left >= 0, 0).otherwise(1).alias("redemption_sort_bucket"),
        (F.col("emv_total") - F.col("event_value")).alias("equity_spread"),
    )


def browse(listings: DataFrame, parcels: DataFrame, tracker: DataFrame, view: DataFrame, offers: DataFrame, county: str | None = None, limit: int = 50, buyer: str = "investor", most: int = 1_000) -> DataFrame:
    """One page of active listings, newest first, with comparable parcels, the amount owed, offers, and the total of all pages.

    Listings are those whose owner admits the ``buyer`` (no list admits all), of the county, and not yet redeemed or sold;
    a listing without a tracked sale is one. The page is found first; it is ``limit`` rows
    (``most`` at most), so it is broadcast, and comparables, debts and offers are only
    counted for its parcels. A parcel with many sales has one debt, the latest dated.
    """
    if not 0 < limit <= most:
        raise ValueError(f"a page has 1 to {most} rows")
    tracked = tracker.groupBy("county", "parcel_id").agg(F.max(F.struct("anchor", "outcome", "days_remaining")).alias("r")).select("county", "parcel_id", "r.outcome", "r.days_remaining")
    admitted = F.col("buyer_types").isNull() | F.array_contains("buyer_types", buyer)
    shown = listings.filter((F.col("status") == "active") & admitted)
    if county is not None:
        shown = shown.filter(F.col("county") == county.strip().lower())
    shown = shown.join(tracked, ["county", "parcel_id"], "left").filter("outcome is null or outcome = 'pending'")
    total = shown.agg(F.count(F.lit(1)))
    bucket = lambda value: F.floor(F.col(value) / BUCKET)
    page = shown.orderBy(F.desc("created_at"), "id").limit(limit).withColumn("bucket", bucket("assessed_value"))
    keys = lambda *names: F.broadcast(page.select(*names).distinct())
    sale = view.filter(F.col("event_type") == SALE).select(F.col("county_slug").alias("county"), F.col("eff_parcel_id").alias("parcel_id"), "event_value", "event_date")
    valued = parcels.filter("market_value is not null").select("county", "parcel_id", bucket("market_value").alias("bucket")).join(keys("county", "bucket"), ["county", "bucket"], "left_semi")
    alike = sale.select("county", "parcel_id").join(valued, ["county", "parcel_id"]).groupBy("county", "bucket").agg(F.count(F.lit(1)).alias("comparable_parcels"))
    order = F.struct(F.col("event_date").isNotNull().alias("a"), F.col("event_date").alias("b"), F.col("event_value").alias("c"))
    owed = sale.filter("event_value is not null").join(keys("county", "parcel_id"), ["county", "parcel_id"], "left_semi").groupBy("county", "parcel_id").agg(F.max_by("event_value", order).alias("amount_owed"))
    made = offers.join(keys("id"), F.col("listing_id") == F.col("id"), "left_semi").groupBy(F.col("listing_id").alias("id")).agg(F.count(F.lit(1)).alias("offer_count"))
    out = page.join(alike, ["county", "bucket"], "left").join(owed, ["county", "parcel_id"], "left").join(made, "id", "left")
    return out.select("id", "created_at", "county", "assessed_value", "days_remaining", "outcome", "comparable_parcels", "amount_owed", F.coalesce("offer_count", F.lit(0).cast("long")).alias("offer_count"), total.scalar().alias("total"))
