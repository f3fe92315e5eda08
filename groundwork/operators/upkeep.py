"""Repairs and bookkeeping: interrupted runs, look-ups that are due, better parcel numbers, notices that were promoted before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.ids import digits, is_stub
from groundwork.operators.derive import next_check

# A number that the county's look-up takes.
LOOK_UP_PID = r"^[0-9]{13}$"
#: What makes two events of a parcel the same one.
SAME_EVENT = ("event_type", "event_date", "source")


def close_orphans(runs: DataFrame, now: Column, reason: str = "process restart") -> DataFrame:
    """Runs (id, scraper, status, started_at) that still say running, closed as interrupted.

    ``unhealthy`` is true where the run is its scraper's latest, so that the source has failed;
    an older one has been made good since. A run without a scraper marks none.
    """
    latest = runs.filter("scraper is not null").groupBy("scraper").agg(F.max(F.struct("started_at", "id"))["id"].alias("__latest"))
    note = F.concat(F.lit(f"closed by a sweep after {reason}: it left no end, so what it counted is unknown; started_at="), F.coalesce(F.col("started_at").cast("string"), F.lit("unknown")))
    out = runs.filter("status = 'running'").join(latest, "scraper", "left")
    return out.select("id", "scraper", "started_at", F.lit("interrupted").alias("status"), now.alias("finished_at"), note.alias("error_message"), F.coalesce(F.col("id") == F.col("__latest"), F.lit(False)).alias("unhealthy"))


def health_summary(sources: DataFrame) -> DataFrame:
    """One row of counts over sources (enabled, is_healthy): what is disabled counts as nothing else, unknown health as never run."""
    on, well = F.col("enabled"), F.col("is_healthy")
    return sources.agg(F.count(F.lit(1)).alias("total"), F.count_if(on & well).alias("healthy"), F.count_if(on & ~well).alias("unhealthy"), F.count_if(~on).alias("disabled"), F.count_if(on & well.isNull()).alias("never_run"))


def due(tracker: DataFrame, counties: Sequence[str], as_of: Column) -> DataFrame:
    """Pending outcomes whose check is due, of counties that can be looked up, earliest end of the window first within a county."""
    ready = (F.col("outcome") == "pending") & (F.col("next_check_date") <= as_of) & F.col("county").isin(*counties) & F.col("parcel_id").rlike(LOOK_UP_PID)
    return tracker.filter(ready).orderBy("county", F.col("redemption_date").asc_nulls_last(), "id")


def check_day(expiry: Column, as_of: Column) -> Column:
    """The first check day of a new entry: the ladder's next one, or today when it is exhausted or there is no window."""
    return F.coalesce(next_check(expiry, as_of), as_of)


def unique_rekey(events: DataFrame, spine: DataFrame) -> DataFrame:
    """(id, parcel_id): the number for events under a made-up one, by county and address key.

    ``events``: id, county, parcel_id, key and SAME_EVENT. ``spine``: county, parcel_id, key. A
    key with two parcels says nothing; an event that its new parcel has already, or that two
    events would become, stays. Events without a date are never the same.
    """
    keys = ["county", "key"]
    one = spine.filter(~is_stub(F.col("parcel_id")) & F.col("key").isNotNull()).groupBy(*keys).agg(F.min("parcel_id").alias("new_id"), F.max("parcel_id").alias("__last")).filter("new_id = __last").drop("__last")
    found = events.filter(is_stub(F.col("parcel_id"))).join(one, keys).select("id", "county", "new_id", *SAME_EVENT)
    same = ["county", "new_id", *SAME_EVENT]
    twice = found.groupBy(*same).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    there = events.filter(~is_stub(F.col("parcel_id"))).select("county", F.col("parcel_id").alias("new_id"), *SAME_EVENT)
    return found.join(there, same, "left_anti").join(twice, same, "left_anti").select("id", F.col("new_id").alias("parcel_id"))


def not_promoted(notices: DataFrame, events: DataFrame, sources: Sequence[str], compat: bool = False) -> DataFrame:
    """Notices (county, parcel_id, pin) of which the feed has no sheriff sale yet.

    It has one if an event of ``sources`` is under the notice's county and parcel, or if an open one of its
    county was published (``published``) with the same digits, whatever parcel it is under.
    ``compat``: a parcel of the same number in any county counts, though numbers repeat across counties.
    """
    sales = events.filter(F.col("source").isin(*sources) & (F.col("event_type") == "sheriff_sale"))
    on = ["parcel_id"] if compat else ["county", "parcel_id"]
    by_parcel = notices.join(sales.select(*on), on, "left_anti")
    known = sales.filter("resolved_at is null").select("county", F.nullif(digits(F.col("published")), F.lit("")).alias("__pin"))
    numbered = by_parcel.withColumn("__pin", F.nullif(digits(F.col("pin")), F.lit("")))
    fresh = numbered.filter("__pin is not null").join(known, ["county", "__pin"], "left_anti")
    return fresh.unionByName(numbered.filter("__pin is null")).select(*notices.columns)  # rows without digits would meet in one task


def mined(parcels: DataFrame, county: str, source: str, after: Column, size: int) -> DataFrame:
    """The next ``size`` parcels of a county after a number that a source has contributed to."""
    return parcels.filter((F.col("county") == county) & F.array_contains("data_sources", source) & (F.col("parcel_id") > after)).orderBy("parcel_id").limit(size)
