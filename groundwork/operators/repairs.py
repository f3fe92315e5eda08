"""Repairs of stored rows as plans of what changes, run records, and flags of pictures. Each returns the rows that change and leaves the others alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import coerce
from groundwork.functions.ids import is_stub
from groundwork.operators.checks import run_status

# Days between runs that sources are held to.
CADENCE = {"dakota_parcels": 31, "ramsey_parcels": 31, "ramsey_tax_roll": 31, "olmsted_tax_detail": 7}
# Fields of the raw record that typed columns are filled from, and the class that tells a home.
RAW_FIELDS = "EMVTotal string, EMVLand string, EMVBldg string, DeededSqFt string, DeedAcres string, LivngUnits string, Class string, SchoolDist string"
ONE_HOME = "RESIDENTIAL SINGLE UNIT"


def bare(text: Column) -> Column:
    """Letters and digits in upper case."""
    return F.regexp_replace(F.upper(text), r"[^A-Z0-9]", "")


def wrong_parcels(events: DataFrame, parcels: DataFrame, source: str) -> DataFrame:
    """ids of copies of a case that hang on a parcel of another address than the case's own; a case's only row stays, wherever it hangs."""
    own = events.filter(F.col("source") == source)
    keys = ["county", "source_id", "event_date"]
    several = own.groupBy(*keys).agg(F.min("id").alias("__a"), F.max("id").alias("__b")).filter("__a < __b")
    on = (F.col("e.county") == F.col("s.county")) & (F.col("e.source_id") == F.col("s.source_id")) & F.col("e.event_date").eqNullSafe(F.col("s.event_date"))
    copies = own.alias("e").join(several.alias("s"), on, "left_semi")
    placed = copies.join(parcels.select("county", "parcel_id", F.col("address").alias("__site")), ["county", "parcel_id"])
    return placed.filter(~bare(F.col("__site")).eqNullSafe(bare(F.get_json_object("raw", "$.address")))).select("id")


def typed_backfill(parcels: DataFrame, county: str) -> DataFrame:
    """Typed columns of a county's parcels from their raw records: a total of zero is none, square feet before acres, a property type that is there stays."""
    rows = parcels.filter((F.col("county") == county) & F.col("raw").isNotNull()).withColumn("__r", F.from_json("raw", RAW_FIELDS))
    amount = lambda name: coerce.clean(F.col(f"__r.{name}")).try_cast("decimal(18,2)")
    feet, acres = amount("DeededSqFt"), amount("DeedAcres")
    home = F.when(F.upper("__r.Class").contains(ONE_HOME), "single_family")
    return rows.select(
        "county", "parcel_id",
        F.nullif(amount("EMVTotal"), F.lit(0).cast("decimal(18,2)")).alias("emv_total"), amount("EMVLand").alias("emv_land"), amount("EMVBldg").alias("emv_building"),
        F.when(feet > 0, feet).when(acres > 0, acres * 43_560).cast("decimal(18,2)").alias("lot_sqft"),
        amount("LivngUnits").cast("int").alias("num_units"), F.nullif(F.col("__r.Class"), F.lit("")).alias("use_class"), F.nullif(F.col("__r.SchoolDist"), F.lit("")).alias("school_district"), F.coalesce("property_type", home).alias("property_type"),
    )


def changed_only(stored: DataFrame, found: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys and the new value where ``found`` has a value that is not the stored one; a null is no value."""
    both = stored.select(*keys, F.col(column).alias("__old")).join(found.select(*keys, column), keys)
    return both.filter(F.col(column).isNotNull() & ~F.col(column).eqNullSafe(F.col("__old"))).select(*keys, column)


def cadence(health: DataFrame, now: Column, days: Mapping[str, int] = CADENCE) -> DataFrame:
    """source_name, expected_interval_days, updated_at of the sources that a cadence is set for."""
    table = F.create_map(*[F.lit(x) for pair in days.items() for x in pair])
    return health.filter(F.col("source_name").isin(*days)).select("source_name", F.try_element_at(table, F.col("source_name")).alias("expected_interval_days"), now.alias("updated_at"))


def rekey_first(events: DataFrame, parcels: DataFrame, source: str) -> DataFrame:
    """id, parcel_id: events on a placeholder, moved to the real, valued parcel of the county with the same address, the smallest number if there are several."""
    key = F.nullif(bare(F.col("address")), F.lit(""))
    real = parcels.filter(~is_stub(F.col("parcel_id")) & F.col("emv_total").isNotNull()).groupBy("county", key.alias("__key")).agg(F.min("parcel_id").alias("__new"))
    stubs = parcels.filter(is_stub(F.col("parcel_id"))).select("county", "parcel_id", key.alias("__key"))
    own = events.filter((F.col("source") == source) & is_stub(F.col("parcel_id")))
    return own.join(stubs, ["county", "parcel_id"]).join(real, ["county", "__key"]).select("id", F.col("__new").alias("parcel_id"))


def open_runs(names: DataFrame, now: Column, first_id: Column) -> DataFrame:
    """A running row for each scraper of ``names`` (scraper)."""
    return names.select(first_id.alias("id"), "scraper", F.lit("running").alias("status"), now.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))


def close_runs(runs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Runs that are still open and have a result (id, fetched, new, updated, failed, error), closed with its status; what is closed stays closed.

    An error is a failure; else the share of failed records tells success, partial or failed.
    """
    open_ = runs.filter("status = 'running'").select("id", "scraper", "started_at")
    status = F.when(F.col("error").isNotNull(), "failed").otherwise(run_status(F.col("fetched"), F.col("failed")))
    took = F.unix_timestamp(now) - F.unix_timestamp("started_at")
    return open_.join(results, "id").select("id", "scraper", status.alias("status"), now.alias("finished_at"), took.alias("duration_seconds"), "fetched", "new", "updated", "failed", F.col("error").alias("error_message"))


def with_imagery_flag(rows: DataFrame, imagery: DataFrame, county: str = "county", parcel: str = "parcel_id") -> DataFrame:
    """``imagery_available``: has the parcel of this county a picture that came out? It says nothing about where."""
    seen = imagery.filter("status = 'ok'").select(F.col("county").alias("__county"), F.col("parcel_id").alias("__parcel")).distinct().withColumn("__ok", F.lit(True))
    return rows.join(seen, (F.col(county) == F.col("__county")) & (F.col(parcel) == F.col("__parcel")), "left").withColumn("imagery_available", F.coalesce("__ok", F.lit(False))).drop("__county", "__parcel", "__ok")
