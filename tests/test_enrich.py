"""Nulls, blanks and empty tables in the operators on landed rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from groundwork.functions import absence, addresses
from groundwork.operators import county_feeds, enrich, repairs
from groundwork.sources import county_parcels

DAY = datetime.date(2026, 6, 1)


def one(spark, fn, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return row.select(fn(*[F.col(f"c{k}") for k in range(len(values))])).first()[0]


@pytest.mark.parametrize("homestead, mailing, site, want", [("Y", "a", "b", False), ("N", "a", "a", False), ("N", None, "a", True), (None, "A  1", "a 1", False), (None, " ", "a", None), ("", None, None, None), (None, "a", "b", True)])
def test_flag_or_street(spark, homestead, mailing, site, want):
    assert one(spark, absence.by_flag_or_street, homestead, mailing, site) is want


@pytest.mark.parametrize("raw, street, rekey", [("12 Oak St #4", "12 OAK ST", "12OAK4"), ("12  Oak Street Unit 4B", "12 OAK STREET", "12OAK"), ("12 Oak Ave NW", "12 OAK AVE NW", "12OAK"), ("", None, ""), (None, None, ""), ("#", "#", ""), ("APT 4", "APT 4", "")])
def test_address_keys(spark, raw, street, rekey):
    assert one(spark, addresses.street_line, raw) == street and one(spark, addresses.rekey_key, raw) == rekey


def test_sales_without_their_facts(spark):
    anoka = "detail_id string, mode string, scheduled_date string, recorded_date string, status string, gis_pid string, tax_parcel_no string, resolved_parcel string, address string, amount_due string, observed_at timestamp"
    rows = [(None,) * 11, ("7", None, "05/01/2026", "04/01/2026", None, "", None, None, None, None, None), ("8", "PENDING", "07/01/2026", None, None, None, None, None, "", "$5", None), (None, "pending", "07/01/2026", None, None, None, None, None, None, None, None)]
    got = county_feeds.anoka_sales(spark.createDataFrame(rows, anoka), F.lit(DAY)).collect()
    assert sorted((r["source_id"], r["severity"], r["title"]) for r in got) == [("ANOKA-FC-7-2026-04-01-completed_sale", "low", "Completed sale: address unknown"), ("ANOKA-FC-8-2026-07-01-pending_sale", "high", "Scheduled sale: address unknown")]
    washington = spark.createDataFrame([(None, "1", None, None, None, None, None), (" 123 ", None, "image only", "nope", "x", None, None)], "pid string, docnum string, instrument_desc string, sale_date string, sale_amount string, owner string, observed_at timestamp")
    (r,) = county_feeds.washington_sales(washington).collect()
    assert (r["parcel_id"], r["event_subtype"], r["event_date"], r["event_value"], r["title"]) == ("WASHINGTON-FC-123", "other_lien", None, None, "Completed sale")
    assert county_feeds.anoka_sales(spark.createDataFrame([], anoka), F.lit(DAY)).count() == 0


def test_owners_and_details(spark):
    lines = "county string, parcel_id string, site string, owner string, taxpayer string, line1 string, line2 string, line3 string"
    rows = [("h", "1", None, None, None, None, None, None), ("h", "2", None, " ", "Bo", "x", None, "EDINA MN 55424"), ("h", "3", "1 A ST", "Cy", None, None, None, None)]
    got = {r["parcel_id"]: r for r in enrich.owner_rows(spark.createDataFrame(rows, lines)).collect()}
    assert set(got) == {"2", "3"} and got["2"]["mailing_city"] == "EDINA" and got["2"]["is_absentee"] is None and got["3"]["is_out_of_state"] is None
    listed = spark.createDataFrame([("a",), (None,)], "id string")
    details = spark.createDataFrame([("a", "x", "1", 2), ("a", "x", "0", 1), ("a", None, "2", 0), (None, "x", "3", 0)], "id string, label string, value string, row_no int")
    assert {r["id"]: r["detail"] for r in enrich.with_details(listed, details, "id").collect()} == {"a": {"x": "0"}, None: None}


def test_parcels_of_a_shape(spark):
    rows = [("dakota", {"PIN": " 12 34567 ", "TOTALVAL": "0", "LANDVAL": "5", "TOTAL_ACRES": "99999", "YEAR_BUILT": "x"}, [(-93.0, 45.0), (-93.0, 45.2), (-92.8, 45.2), (-92.8, 45.0), (-93.0, 45.0)]), ("dakota", {"PIN": None}, None), (None, None, None), ("ramsey", {"ParcelID": "N/A"}, None)]
    features = spark.createDataFrame(rows, "county string, attributes map<string,string>, ring array<struct<x: double, y: double>>")
    good, bad = county_parcels.parcels(features, F.lit(DAY))
    (r,) = good.collect()
    assert (r["county"], float(r["emv_total"]), r["lot_sqft"], r["year_built"], round(r["lat"], 3), round(r["lng"], 3)) == ("dakota", 5.0, None, None, 45.1, -92.9)
    assert sorted(r["reason"] for r in bad.collect()) == ["no parcel number", "no parcel number", "unknown county"]


def test_runs_and_flags(spark):
    runs = spark.createDataFrame([(1, "a", "running", None), (2, "a", "success", None)], "id int, scraper string, status string, started_at timestamp")
    results = spark.createDataFrame([(1, 0, 0, 0, 0, None), (2, 9, 9, 9, 9, "x"), (3, 1, 1, 1, 1, None)], "id int, fetched int, new int, updated int, failed int, error string")
    assert [(r["id"], r["status"]) for r in repairs.close_runs(runs, results, F.lit("2026-06-01").cast("timestamp")).collect()] == [(1, "success")]
    rows = spark.createDataFrame([("a", "1"), ("b", "1"), (None, None)], "county string, parcel_id string")
    shots = spark.createDataFrame([("a", "1", "ok"), ("a", "1", "ok"), ("b", "1", "none"), (None, None, "ok")], "county string, parcel_id string, status string")
    assert sorted((r["county"] or "", r["imagery_available"]) for r in repairs.with_imagery_flag(rows, shots).collect()) == [("", False), ("a", True), ("b", False)]
