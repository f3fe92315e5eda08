import datetime

import pytest
from pyspark.sql import functions as F

from groundwork.operators import integrity, views

DAY = datetime.date(2026, 8, 18)


@pytest.fixture
def tables(spark):
    event = "id int, source string, source_id string, parcel_id string, county string, event_type string, event_subtype string, event_date date, event_value int, observed_at date, raw string"
    d = datetime.date
    events = [
        (1, "s", "a", "P1", "anoka", "sheriff_sale", "pending", d(2026, 1, 1), 50, DAY, None),
        (2, "s", "b", "X-FC-2", None, "sheriff_sale", "pending", d(2026, 1, 1), None, DAY, '{"detail": {"gis_pid": "P1", "county": "Anoka County"}}'),
        (3, "t", "c", None, "scott", "vacant", None, None, 7, d(2026, 7, 1), "no json"),
        (4, None, "d", "X-FC-9", None, "sheriff_sale", "pending", d(2025, 1, 1), 1, DAY, '{"detail": {}}'),
        (5, "s", "e", "P1", "anoka", "sheriff_sale", "pending", d(2026, 1, 1), 60, DAY, None),
        (6, "s", "f", "P1", "anoka", "sheriff_sale", "completed", d(2026, 1, 1), 60, DAY, None),
    ]
    return {
        "events": spark.createDataFrame(events, event),
        "source_counties": spark.createDataFrame([("s", None), ("s", "anoka"), ("u", "x")], "source string, county string"),
        "parcels": spark.createDataFrame([("anoka", "P1", 100, "1 Oak St", DAY, "w"), ("anoka", "P1", 100, "1 Oak St", DAY, "w"), ("scott", "P1", 900, "1 Oak St", DAY, "w"), ("anoka", "X-FC-2", None, "1 Oak Street", DAY, "w"), ("anoka", "X-FC-3", None, "1 Oak St; 2 Oak St", DAY, "w")], "county string, parcel_id string, emv_total int, address string, created_at date, data_sources string"),
        "sales": spark.createDataFrame([("anoka", "P1", d(2026, 1, 1), d(2026, 9, 1)), ("anoka", "P1", d(2026, 1, 1), d(2026, 8, 28)), ("anoka", "P1", d(2020, 1, 1), d(2020, 7, 1)), ("scott", "P7", d(2026, 1, 1), None)], "county string, parcel_id string, sale_date date, redemption_date date"),
    }


def test_one_row_for_each_event(spark, tables):
    rows = {r["id"]: r for r in views.distress_with_parcel(tables["events"], tables["source_counties"], tables["parcels"], tables["sales"], F.lit(DAY), ("emv_total",)).collect()}
    assert len(rows) == 6 and tables["events"].count() == 6
    assert (rows[1]["eff_parcel_id"], rows[1]["county_slug"], rows[1]["emv_total"], rows[1]["redemption_days_left"], rows[1]["equity_spread"]) == ("P1", "anoka", 100, 14, 50)
    assert (rows[2]["eff_parcel_id"], rows[2]["county_slug"], rows[2]["emv_total"]) == ("P1", "anoka", 100)
    assert (rows[3]["eff_parcel_id"], rows[3]["county_slug"], rows[3]["redemption_sort_bucket"]) == (None, "scott", 2)
    assert (rows[4]["eff_parcel_id"], rows[4]["county_slug"], rows[4]["emv_total"]) == ("X-FC-9", None, None)


def test_ten_checks(spark, tables):
    more = {
        "imagery": spark.createDataFrame([("anoka", "X-FC-2", None, "no_location")], "county string, parcel_id string, pano_id string, status string"),
        "extractions": spark.createDataFrame([(1, "approved", None), (2, "pending", None)], "id int, review_status string, promoted_at date"),
        "tracker": spark.createDataFrame([(1, "anoka", "ecrv_x", "redeemed_by_owner", DAY, datetime.date(2026, 8, 1)), (2, "anoka", "arcgis", "redeemed_by_owner", DAY, datetime.date(2026, 8, 1)), (3, "anoka", "ecrv_x", "foreclosed_sold", DAY, None)], "id int, county string, detection_source string, outcome string, sale_date date, expiry date"),
        "source_health": spark.createDataFrame([("s",)], "source string"),
    }
    found = {(r["check"], r["county"]): r for r in integrity.run({**tables, **more}, F.lit(DAY)).collect()}
    n = {k: r["n"] for k, r in found.items()}
    assert n == {
        ("stubs_minted_today", "anoka"): 2, ("stubs_resolvable", "anoka"): 1, ("duplicate_events_same_parcel", "anoka"): 2, ("sheriff_sales_without_event", "scott"): 1, ("imagery_failures_on_stubs", "anoka"): 1, ("events_orphaned_from_parcels", "(no county)"): 2,
        ("events_orphaned_from_parcels", "scott"): 1, ("approved_never_promoted", None): 1, ("source_silent_days", None): 48, ("tracker_labels_invalidated", "anoka"): 1, ("source_missing_registration", None): 1,
    }
    assert found["duplicate_events_same_parcel", "anoka"]["detail"]["ids"] == "1,5"
    assert found["source_missing_registration", None]["detail"] == {"source": "t", "missing_county_map": "true", "missing_source_health": "true", "county_null_events": "0"}
    assert found["stubs_minted_today", "anoka"]["severity"] == "info" and found["source_silent_days", None]["severity"] == "alert"


def test_empty_tables_give_no_findings(spark, tables):
    assert integrity.orphaned_events(tables["events"].limit(0), tables["parcels"]).count() == 0
    assert integrity.duplicate_sales(tables["events"].limit(0)).count() == 0
    assert views.distress_with_parcel(tables["events"].limit(0), tables["source_counties"], tables["parcels"], tables["sales"], F.lit(DAY), ("emv_total",)).count() == 0


def test_page_of_listings(spark, tables):
    view = views.distress_with_parcel(tables["events"], tables["source_counties"], tables["parcels"], tables["sales"], F.lit(DAY), ("emv_total",))
    row = "id int, created_at date, county string, parcel_id string, assessed_value int, status string, buyer_types array<string>"
    listings = spark.createDataFrame([(1, DAY, "anoka", "P1", 120, "active", None), (2, DAY, "anoka", "P2", 120, "active", ["retail"]), (3, DAY, "scott", "P1", 5, "active", ["investor"]), (4, DAY, "anoka", "P4", 9, "sold", None), (5, DAY, "anoka", "P5", 9, "active", [])], row)
    tracker = spark.createDataFrame([("scott", "P1", DAY, "pending", 4), ("anoka", "P1", DAY, None, 9)], "county string, parcel_id string, anchor date, outcome string, days_remaining int")
    offers = spark.createDataFrame([(1,), (1,), (4,)], "listing_id int")
    valued = tables["parcels"].withColumn("market_value", F.col("emv_total")).dropDuplicates(["county", "parcel_id"])
    page = {r["id"]: r for r in views.browse(listings, valued, tracker, view, offers, limit=10).collect()}
    assert set(page) == {1, 3} and {r["total"] for r in page.values()} == {2}
    assert (page[1]["comparable_parcels"], page[1]["amount_owed"], page[1]["offer_count"], page[3]["offer_count"], page[3]["amount_owed"]) == (4, 60, 2, 0, None)
    assert [r["id"] for r in views.browse(listings, valued, tracker, view, offers, county=" Scott ", limit=1).collect()] == [3]
    with pytest.raises(ValueError):
        views.browse(listings, valued, tracker, view, offers, limit=5_000)
