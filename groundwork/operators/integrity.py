"""Ten checks of the stored tables. Each gives its own findings; nothing is repaired.

A finding is check, severity (alert, warn, info), county, n and detail, a map of texts.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.ids import is_stub
from groundwork.operators.checks import repeated
from groundwork.operators.matching import resolve_house

#: Findings from this on are alerts, and warnings; None is never.
Levels = tuple[int | None, int | None]
# Levels of each check, days of silence, the sales whose day decides a label.
MINTED, RESOLVABLE, UNMATCHED, UNREGISTERED = (20, 5), (50, 10), (20, 0), (100, 10)
SILENT_WARN, SILENT_ALERT = 14, 30
SALE = "sheriff_sale"
IN_WINDOW, AFTER = "redeemed_by_owner", "foreclosed_sold"


def severity(n: Column, levels: Levels) -> Column:
    alert, warn = levels
    said = F.when(n >= alert, "alert") if alert is not None else F.when(F.lit(False), "alert")
    return (said.when(n >= warn, "warn") if warn is not None else said).otherwise("info")


def finding(rows: DataFrame, check: str, level: Column, county: Column, n: Column, **detail: Column) -> DataFrame:
    texts = F.map_from_arrays(F.array(*map(F.lit, detail)), F.array(*[c.cast("string") for c in detail.values()])) if detail else F.create_map().cast("map<string,string>")
    return rows.select(F.lit(check).alias("check"), level.alias("severity"), county.cast("string").alias("county"), n.cast("long").alias("n"), texts.alias("detail"))


def stubs_minted(parcels: DataFrame, as_of: Column) -> DataFrame:
    """Placeholders made on the day, by county and writer."""
    new = parcels.filter(is_stub(F.col("parcel_id")) & (F.to_date("created_at") >= as_of)).groupBy("county", "data_sources").agg(F.count(F.lit(1)).alias("n"), F.min("parcel_id").alias("sample"))
    return finding(new, "stubs_minted_today", severity(F.col("n"), MINTED), F.col("county"), F.col("n"), writer=F.col("data_sources"), sample=F.col("sample"))


def stubs_resolvable(parcels: DataFrame) -> DataFrame:
    """Placeholders whose address is that of exactly one real parcel of the county."""
    stub = is_stub(F.col("parcel_id"))
    found = resolve_house(parcels.filter(stub & F.col("address").isNotNull()).select("county", "address", F.col("parcel_id").alias("stub")), parcels.filter(~stub).select("county", "address", "parcel_id"), "parcel_id")
    found = found.filter("status = 'match'").groupBy("county").agg(F.count(F.lit(1)).alias("n"), F.min("stub").alias("sample"))
    return finding(found, "stubs_resolvable", severity(F.col("n"), RESOLVABLE), F.col("county"), F.col("n"), sample=F.col("sample"))


def duplicate_sales(events: DataFrame) -> DataFrame:
    """Sales of one parcel, day and subtype that are there twice: each is a finding. A pending and a completed sale are two facts."""
    keys = ["county", "parcel_id", "event_date", "event_subtype"]
    sales = events.filter(F.col("event_type") == SALE)
    twice = repeated(sales, keys, "id").select(*[F.col(k).alias(f"__{k}") for k in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    found = sales.join(twice, on).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("ids"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return finding(found, "duplicate_events_same_parcel", F.lit("alert"), F.col("county"), F.col("n"), parcel_id=F.col("parcel_id"), event_date=F.col("event_date"), event_subtype=F.col("event_subtype"), ids=F.col("ids"), sources=F.col("sources"))


def sales_without_event(sales: DataFrame, events: DataFrame) -> DataFrame:
    """Stored sales whose parcel has no sale event."""
    there = events.filter(F.col("event_type") == SALE).select("county", "parcel_id")
    bare = sales.join(there, ["county", "parcel_id"], "left_anti").groupBy("county").agg(F.count(F.lit(1)).alias("n"), F.min("parcel_id").alias("sample"), F.count_if(is_stub(F.col("parcel_id"))).alias("stubs"))
    return finding(bare, "sheriff_sales_without_event", severity(F.col("n"), UNMATCHED), F.col("county"), F.col("n"), sample=F.col("sample"), on_stub=F.col("stubs"))


def imagery_on_stubs(imagery: DataFrame) -> DataFrame:
    rows = imagery.filter(is_stub(F.col("parcel_id"))).groupBy("county").agg(F.count(F.lit(1)).alias("n"), F.count("pano_id").alias("panos"), F.count_if(F.col("status") == "ok").alias("ok"))
    return finding(rows, "imagery_failures_on_stubs", F.lit("info"), F.col("county"), F.col("n"), with_real_pano=F.col("panos"), status_ok=F.col("ok"))


def orphaned_events(events: DataFrame, parcels: DataFrame) -> DataFrame:
    """Events under a parcel that the county has not, or without a county."""
    known = events.filter(F.col("county").isNotNull()).join(parcels.select("county", "parcel_id"), ["county", "parcel_id"], "left_anti").select("county", "id")
    none = events.filter(F.col("county").isNull()).select(F.lit("(no county)").alias("county"), "id")
    rows = known.unionByName(none).groupBy("county").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("sample"))
    return finding(rows, "events_orphaned_from_parcels", F.lit("alert"), F.col("county"), F.col("n"), sample=F.col("sample"))


def never_promoted(extractions: DataFrame) -> DataFrame:
    rows = extractions.filter("review_status = 'approved' and promoted_at is null").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("sample")).filter("n > 0")
    return finding(rows, "approved_never_promoted", F.lit("warn"), F.lit(None), F.col("n"), sample=F.col("sample"))


def silent(events: DataFrame, as_of: Column) -> DataFrame:
    """Sources that have written nothing for over two weeks; n is the days."""
    rows = events.filter("observed_at is not null").groupBy("source").agg(F.max("observed_at").alias("last"), F.count(F.lit(1)).alias("events"))
    rows = rows.withColumn("days", F.datediff(as_of, F.to_date("last"))).filter(F.col("days") > SILENT_WARN)
    return finding(rows, "source_silent_days", F.when(F.col("days") > SILENT_ALERT, "alert").otherwise("warn"), F.lit(None), F.col("days"), source=F.col("source"), events=F.col("events"))


def labels_invalidated(tracker: DataFrame) -> DataFrame:
    """Labels of the sale matcher that their own sale no longer bears out: the window has moved past or before it. Labels of other checkers are theirs."""
    by_sale = F.col("detection_source").startswith("ecrv") & F.col("sale_date").isNotNull() & F.col("expiry").isNotNull()
    wrong = F.when(F.col("outcome") == IN_WINDOW, F.col("sale_date") > F.col("expiry")).when(F.col("outcome") == AFTER, F.col("sale_date") <= F.col("expiry"))
    rows = tracker.filter(by_sale & wrong).groupBy("county").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("sample"))
    return finding(rows, "tracker_labels_invalidated", F.lit("warn"), F.col("county"), F.col("n"), sample=F.col("sample"))


def unregistered(events: DataFrame, source_counties: DataFrame, source_health: DataFrame) -> DataFrame:
    """Sources that write events but stand in one of the two registries only, or in none; a row without a county is there all the same."""
    own = events.filter("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("county").isNull()).alias("bare"))
    mapped = source_counties.select("source").distinct().withColumn("mapped", F.lit(True))
    judged = source_health.select("source").distinct().withColumn("judged", F.lit(True))
    rows = own.join(mapped, "source", "left").join(judged, "source", "left").filter("mapped is null or judged is null")
    return finding(rows, "source_missing_registration", severity(F.col("n"), UNREGISTERED), F.lit(None), F.col("n"), source=F.col("source"), missing_county_map=F.col("mapped").isNull(), missing_source_health=F.col("judged").isNull(), county_null_events=F.col("bare"))


def run(t: Mapping[str, DataFrame], as_of: Column) -> DataFrame:
    """Findings of all ten checks over the tables parcels, events, sales, imagery, extractions, tracker, source_counties and source_health."""
    found = [
        stubs_minted(t["parcels"], as_of), stubs_resolvable(t["parcels"]), duplicate_sales(t["events"]), sales_without_event(t["sales"], t["events"]), imagery_on_stubs(t["imagery"]),
        orphaned_events(t["events"], t["parcels"]), never_promoted(t["extractions"]), silent(t["events"], as_of), labels_invalidated(t["tracker"]), unregistered(t["events"], t["source_counties"], t["source_health"]),
    ]
    return reduce(DataFrame.unionByName, found)


def worst_first(findings: DataFrame) -> list[Column]:
    """The order of a report."""
    return [F.when(F.col("severity") == "alert", 1).when(F.col("severity") == "warn", 2).otherwise(3), F.desc("n"), F.col("check")]
