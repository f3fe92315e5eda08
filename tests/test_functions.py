"""Worked pairs of the scalar functions, and properties of the normalisers."""

import datetime

import pytest
from pyspark.sql import functions as F

from groundwork.functions import addresses, coerce, ids, notices


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "county, raw, want",
    [
        ("hennepin", "01-029-24-13-0001", "0102924130001"),
        ("hennepin", "902924220131", "0902924220131"),
        ("Ramsey", "01.23.45.6789.01", "012345678901"),
        ("wabasha", "R08-00241-00", "080024100"),
        ("fillmore", "sunset", None),
        ("anoka", "ab", None),
        ("anoka", None, None),
    ],
)
def test_parcel_id(spark, county, raw, want):
    r = spark.createDataFrame([(county, raw)], "c string, r string").select(ids.parcel_id(F.col("c"), F.col("r")).alias("p")).first()["p"]
    assert r["id"] == want and (r["error"] is None) == (want is not None)


@pytest.mark.parametrize("name, want", [("St. Louis", "st_louis"), ("Saint Louis", "st_louis"), ("Washington County", "washington"), ("Otter Tail", "otter_tail"), ("--", None), (None, None)])
def test_county_slug(spark, name, want):
    assert one(spark, name, ids.county_slug) == want


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("8344 Onigum Road Northwest", "8344 ONIGUM RD NW", True),
        ("9665 Glacial Valley Rd.", "9665 GLACIAL VALLEY RD, CITY OF WOODBURY", True),
        ("1221 1st Avenue Northwest", "1221 1ST AVE NW", True),
        ("100 Main St N", "100 Main St S", False),
        ("100 Main St NE", "100 Main St NW", False),
    ],
)
def test_addr_key(spark, a, b, same):
    assert (one(spark, a, addresses.addr_key) == one(spark, b, addresses.addr_key)) is same


def test_normalised_addresses_are_fixed_points(spark):
    raw = ["4120 Cedar Ave. N.", "12 Oak Street Apt 4, Crystal", "# 4", "", None, "7 North Heights Way"]
    df = spark.createDataFrame([(r,) for r in raw], "v string").select(addresses.normalize_address(F.col("v")).alias("n"))
    assert df.filter(F.col("n") != addresses.normalize_address(F.col("n"))).count() == 0


@pytest.mark.parametrize("raw, want", [("12 Oak St", True), ("12 Oak St; 14 Oak St", False), ("12 Oak and 14 Oak", False), ("Oak St", False), ("12", False), ("12-14 Oak St", False), ("7 Andover Ct", True), ("7 A & B St", False), (None, False)])
def test_one_house(spark, raw, want):
    assert one(spark, raw, addresses.one_house) is want


@pytest.mark.parametrize("raw, want", [("4120 Cedar Ave", "4XXX Cedar Ave"), ("Oak St", "Oak St")])
def test_masked(spark, raw, want):
    assert one(spark, raw, addresses.masked) == want


@pytest.mark.parametrize("text, want", [("twelve (12) months", 12), ("six (6) months", 6), ("No right of redemption", 0), ("5 weeks", None), ("not stated", None), ("6.00 months", 6), ("twelve calendar months", 12), ("period: six (6)", 6), ("(5) weeks", None), ("99 months", None), ("months", None), ("", None), (None, None)])
def test_redemption_months(spark, text, want):
    assert one(spark, text, notices.redemption_months) == want


@pytest.mark.parametrize("text, want", [("150063915; 150063922", ["150063915", "150063922"]), ("08.032.21.11.0036 COT# 77608", ["08.032.21.11.0036"]), ("45-118", []), ("1234567 and 1234567", ["1234567"]), ("C.O.T. 123456, 7654321 and DOC #9999999; 12 34 56", ["7654321", "12 34 56"]), ("and", []), (None, [])])

def test_split_pids(spark, text, want):
    assert one(spark, text, notices.split_pids) == want


@pytest.mark.parametrize("text, want", [("$.00", 0), ("$1,234.50", 1234.5), ("(12.00)", -12), ("N/A", None), (None, None)])
def test_money(spark, text, want):
    got = one(spark, text, coerce.money)
    assert (None if got is None else float(got)) == want


@pytest.mark.parametrize("text, want", [("2026-04-22", (2026, 4, 22)), ("4/2/2026", (2026, 4, 2)), ("April 2, 2026", (2026, 4, 2)), ("nope", None)])
def test_day(spark, text, want):
    assert one(spark, text, coerce.day) == (want and datetime.date(*want))


def test_short_years(spark):
    assert one(spark, "22-APR-26", coerce.day_short_year) == datetime.date(2026, 4, 22)
    as_of = F.lit("2026-06-01").cast("date")
    assert one(spark, "84", lambda c: coerce.full_year(c, as_of)) == 1984
    assert one(spark, "25", lambda c: coerce.full_year(c, as_of)) == 2025


@pytest.mark.parametrize("text, want", [("1:05 PM", "13:05:00"), ("12:30 am", "00:30:00"), ("12:00PM sharp", "12:00:00"), ("09:00", "09:00:00"), ("25:10", None), ("9:75", None), ("noon", None), ("", None), (None, None)])
def test_clock(spark, text, want):
    assert one(spark, text, coerce.clock) == want


@pytest.mark.parametrize("name, owner, want", [("John Q Public", "PUBLIC, JOHN Q", True), ("John Q Public", "PUBLIC JOHN R", False), ("John Public", "PUBLICO, JOHN", False), ("Public", "PUBLIC", False)])
def test_same_person(spark, name, owner, want):
    r = spark.createDataFrame([(name, owner)], "a string, b string").select(notices.same_person(F.col("a"), F.col("b")).alias("r")).first()["r"]
    assert r is want


def test_verbatim_facts(spark):
    r = spark.createDataFrame([("26-0035 36", "no. 26-003536 here"), ("x", "y"), ("", "y")], "a string, b string").select(notices.appears(F.col("a"), F.col("b")).alias("r")).collect()
    assert [x["r"] for x in r] == [True, False, False]


def test_codes_of_numbered_suppliers(spark, tmp_path):
    """Suppliers from 45,000 on have codes of six digits in the query's SQL; a postal code has five."""
    import duckdb

    from groundwork import registry

    duckdb.sql(f"COPY (SELECT range AS s_suppkey FROM range(44990, 45012)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    got = registry.QUERIES["city_state_zip"](spark, str(tmp_path)).select("s_suppkey", "city", "state", "zip").collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
        want = con.execute(registry.ORACLES["city_state_zip"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    read = lambda line, **more: spark.range(1).select(addresses.city_state_zip(F.lit(line), **more)["zip"]).first()[0]
    assert (read("A MN 550001234"), read("A MN 550001"), read("A MN 550001-1234", most=6)) == ("55000", None, "550001")
