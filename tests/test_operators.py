"""Semantics that a join on test tables does not provoke: nulls, reruns, ambiguity, guards."""

import datetime
from dataclasses import replace

from pyspark.sql import functions as F

from groundwork.functions import addresses
from groundwork.operators import checks, derive, emit, merge, resolve, search
from groundwork.operators.aggregate import percentile_bands

D = datetime.date


def test_second_insert_adds_nothing(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", D(2026, 1, 1), 3)], "k string, day date, id int")
    first = merge.dedup_insert(rows.limit(0), rows, ["k", "day"], [F.col("id")])
    assert sorted(r["id"] for r in first.collect()) == [1, 3]
    assert merge.dedup_insert(first, rows, ["k", "day"], [F.col("id")]).count() == 0


def test_field_merge_modes(spark):
    old = spark.createDataFrame([(1, "kept", 0, ["b"]), (2, "", 5, None)], "id int, name string, n int, src array<string>")
    new = spark.createDataFrame([(1, "other", 7, ["a"]), (3, None, 9, None)], "id int, name string, n int, src array<string>")
    got = {r["id"]: (r["name"], r["n"], r["src"]) for r in merge.field_merge(old, new, ["id"], union=["src"]).collect()}
    assert got == {1: ("kept", 7, ["a", "b"]), 2: ("", 5, []), 3: (None, 9, [])}
    owned = {r["id"]: r["n"] for r in merge.field_merge(old, new.withColumn("n", F.lit(None).cast("int")), ["id"], owned=["n"]).collect()}
    assert owned == {1: None, 2: 5, 3: None}


def test_cosmetic_owner_change_is_none(spark):
    seen = spark.createDataFrame([(1, "SMITH, JOHN", D(2020, 1, 1)), (1, "Smith John", D(2021, 1, 1)), (1, "Doe", D(2022, 1, 1))], "p int, owner string, start date")
    got = sorted((r["owner"], r["end_date"], r["is_current"]) for r in merge.ownership_history(seen, ["p"], ["owner"], "start").collect())
    assert got == [("Doe", None, True), ("SMITH, JOHN", D(2022, 1, 1), False)]


def test_incomplete_snapshot_retires_nothing(spark):
    registry = spark.createDataFrame([("a", True, 2), (None, True, 2)], "k string, is_active boolean, consecutive_misses int")
    snap = spark.createDataFrame([(None,)], "k string")
    got = lambda c: {r["k"]: (r["is_active"], r["consecutive_misses"]) for r in merge.reconcile_snapshot(registry, snap, ["k"], c).collect()}
    assert got(True) == {"a": (False, 3), None: (True, 0)}
    assert got(False) == {"a": (True, 2), None: (True, 0)}


def test_retirement_guard(spark):
    stored = spark.createDataFrame([(1, "delinquent")], "id int, kind string")
    none = spark.createDataFrame([], "id int")
    assert merge.retire_stale(stored, none, none, "id").count() == 0


def test_ambiguous_is_no_match(spark):
    spine = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("y", 3), (None, 4)], "key string, target int")
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "id int, key string")
    got = {r["id"]: (r["target"], r["status"]) for r in resolve.resolve_unique(rows, spine, ["key"], "target").collect()}
    assert got == {1: (None, "ambiguous"), 2: (3, "match"), 3: (None, "none"), 4: (None, "none")}


def test_month_ends(spark):
    row = spark.createDataFrame([(D(2025, 8, 31), D(2024, 8, 31))], "a date, b date")
    e = lambda c: derive.expiry_of(F.col(c), F.lit(None).cast("date"), F.lit(None).cast("int"))["expiry"]
    assert tuple(row.select(e("a"), e("b")).first()) == (D(2026, 2, 28), D(2025, 2, 28))
    assert spark.range(1).select(derive.second_monday_of_may(F.lit(2026))).first()[0] == D(2026, 5, 11)


def test_degenerate_rings(spark):
    rows = spark.createDataFrame([([(1.0, 2.0)],), ([],)], "ring array<struct<x: double, y: double>>")
    got = [tuple(r["c"]) for r in rows.select(derive.centroid(F.col("ring")).alias("c")).collect()]
    assert got == [(1.0, 2.0), (None, None)]


def test_bearing_and_distance(spark):
    r = spark.range(1).select(resolve.haversine(F.lit(44.0), F.lit(-93.0), F.lit(45.0), F.lit(-93.0)).alias("d"), resolve.bearing(F.lit(44.0), F.lit(-93.0), F.lit(44.0), F.lit(-92.0)).alias("b")).first()
    assert abs(r["d"] - 111_195) < 10 and abs(r["b"] - 90) < 1


def test_bands_need_fifteen(spark):
    sales = spark.range(14).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("s"), F.col("id").alias("d"))
    assert percentile_bands(sales, ["k"], "s", "d").count() == 0


def test_gating_and_words():
    asked = search.Filters(category="vacant", county="anoka", status="active", multi_signal=3, ranges={"sqft": (1, None)}, equal={"property_type": "x"}, redemption="expired", absentee=True, outcomes=("foreclosed",), sort="equity", descending=True)
    assert search.allowed(asked, "standard") == search.Filters(category="vacant", county="anoka", status="active", descending=True)
    plain = replace(asked, outcomes=())
    assert all(search.allowed(plain, tier) == plain for tier in ("free", "basic", "premium", "admin", "unknown"))
    assert all(search.allowed(replace(asked, outcome="reo"), tier) == plain for tier in ("free", "basic", "unknown"))  # outcomes are for premium
    assert all(search.allowed(asked, tier) is asked for tier in ("premium", "admin"))
    assert search.Filters().sort == "event_date" and not search.Filters().descending
    asked = {"ranges": {"nope": (1, 2), "sqft": [None, 900], "year_built": ("x", 1), "emv_total": (1, 2.5)}, "equal": {"property_type": "House", "num_units": True}, "county": 5, "multi_signal": "2", "absentee": 1, "redeemed": False}
    assert search.from_words(asked) == search.Filters(ranges={"sqft": (None, 900), "emv_total": (1, 2.5)}, equal={"property_type": "House"}, redeemed=False)
    assert search.from_words({"category": "nope", "sort": "x", "limit": 900, "county": "Anoka", "odd": 1}) == search.Filters(county="Anoka")


def test_redaction_leaks_nothing(spark):
    """No value of a row that locates, names or prices it is anywhere in what a low tier gets."""
    rows = spark.createDataFrame(
        [("s", "tax_forfeit", "Anoka", "12 Elm St", "Jane Doe", 90_000.0, "Jane Doe owes 9", "text Jane Doe", '{"owner":"Jane Doe"}', "1923", ("p1", True), (True, "Jane Doe", 4), "Jane Doe", 5)],
        "source string, event_type string, county string, address string, owner string, market_value double, title string, description string, raw string, enrichment string, imagery struct<pano_id: string, available: boolean>, tax_status struct<redeemed_since_list: boolean, owner_name: string, years: int>, novel string, redemption_days_left int",
    )
    free, basic, standard = (search.redact(rows, t, F.lit(t != "free")).first() for t in ("free", "basic", "standard"))
    for row, secret in ((free, ("Jane", "Elm", "p1", "1923", "Anoka", "90000")), (basic, ("Jane", "Elm", "p1", "1923"))):
        assert not any(word in repr(row) for word in secret)
    assert free["equity_band"] is None and free["equity_band_locked"] and free["tax_status"].asDict() == {"redeemed_since_list": True, "locked": True}
    assert free["imagery"].asDict() == {"available": True, "locked": True} and free["raw_locked"] and free["enrichment_locked"] and free["novel_locked"]
    assert basic["title"] == "Tax-forfeit property — Anoka County" and basic["description"].startswith("Tax-forfeit property. Estimated equity band: moderate. Details locked")
    assert standard["address"] == "12 Elm St" and standard["raw"] is None and standard["raw_locked"] and standard["enrichment"] == "1923" and standard["imagery"]["pano_id"] == "p1"
    assert standard["tax_status"].asDict() == {"redeemed_since_list": True, "owner_name": None, "years": 4, "owner_locked": True} and standard["title"] == "Jane Doe owes 9"
    assert search.redact(rows, "premium").first() == rows.first() and search.redact(rows, None).columns == search.redact(rows, "free").columns


def test_alerts(spark):
    rows = spark.createDataFrame([("daily", "2026-01-01 00:00:00"), ("daily", "2026-01-01 05:00:00"), ("weekly", "2025-12-25 00:00:00"), ("weekly", None)], "c string, t string")
    now = F.lit("2026-01-01 21:00:00").cast("timestamp")
    got = [r["d"] for r in rows.select(search.alert_due(F.col("c"), F.col("t").cast("timestamp"), now).alias("d")).collect()]
    assert got == [True, False, True, True]


def test_run_status(spark):
    rows = spark.createDataFrame([(100, 100), (100, 6), (100, 5), (0, 0)], "p int, f int")
    assert [r["s"] for r in rows.select(checks.run_status(F.col("p"), F.col("f")).alias("s")).collect()] == ["failed", "partial", "success", "success"]


def test_promotion_of_packages(spark):
    n = spark.createDataFrame([("anoka", "n1", D(2026, 1, 1), 10.0, 6, ["1234567", "7654321"]), ("anoka", "n2", None, 5.0, None, [])], "county string, notice_id string, sale_date date, amount double, months int, p array<string>")
    events, sales, stubs = emit.promotion(n, F.col("p"))
    assert sorted((r["source_id"], r["event_value"] and float(r["event_value"])) for r in events.collect()) == [("n1#1234567", None), ("n1#7654321", None), ("n2", 5.0)]
    assert sales.count() == 3 and [r["parcel_id"] for r in stubs.collect()] == ["ANOKA-FC-n2"]


def test_counts_of_saved_searches_with_signals(spark):
    rows = spark.createDataFrame([(1, "p", "mpls_vbr", "x", 3), (2, "p", "mpls_vbr", "x", 3), (3, None, "mpls_vbr", "x", 2), (4, "q", "ramsey_tfl", "x", 1)], "id int, parcel_key string, source string, event_type string, signal_count int")
    asked = {"many": search.Filters(multi_signal=2), "vacant": search.Filters(category="vacant"), "all": search.Filters()}
    got = {r["search"]: r["n"] for r in search.saved_search_counts(rows, asked, F.current_date()).collect()}
    assert got == {"many": 2, "vacant": 3, "all": 4}
    assert search.saved_search_counts(rows, {}, F.current_date()).count() == 0


def test_radius_at_poles_and_the_date_line(spark):
    """Every pair of a brute-force search, wherever on the globe."""
    import math
    import random

    r = random.Random(1)
    places = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(40)] + [(90.0, 0.0), (89.999, 170.0), (-90.0, 5.0), (-89.9995, -60.0), (10.0, 180.0), (10.001, -179.9995), (10.0005, 179.999), (71.0, -180.0), (71.0005, 179.9999)]
    near = [(max(-90.0, min(90.0, a + r.uniform(-0.004, 0.004))), b + r.uniform(-0.004, 0.004) if abs(b) < 179 else b) for a, b in places]
    far = lambda p, q: 2 * 6_371_000 * math.asin(math.sqrt(min(1.0, math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2)))
    rows = places + near
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(rows)] + [(-1, None, 3.0)], "i int, lat double, lng double")
    b = a.selectExpr("i as j", "lat as lat2", "lng as lng2")
    for metres in (250.0, 40_000.0):
        got = sorted((x["i"], x["j"]) for x in resolve.within_radius(a, b, metres).collect())
        assert got == sorted((i, j) for i, p in enumerate(rows) for j, q in enumerate(rows) if far(p, q) <= metres)


def test_small_mends(spark):
    spine = spark.createDataFrame([("a", None), ("b", None), ("b", 3)], "k string, t int")
    assert [(r["k"], r["t"]) for r in resolve.unique_index(spine, ["k"], "t").collect()] == [("b", 3)]
    one = spark.createDataFrame([(1,)], "i int")
    many = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert [tuple(r) for r in resolve.scoped(one, [("metro", many, [])], "v").collect()] == [(1, 2.0, "metro")]
    assert one.select(addresses.title_case(F.lit("étang vert o'brien NORTH-oaks")).alias("t")).first()["t"] == "Étang Vert O'Brien North-Oaks"
    ids = spark.range(3_000).select("id", F.lit("delinquent").alias("kind"))
    none = ids.filter("id < 0")
    assert merge.retire_stale(ids, none, ids.filter("id < 200"), "id").count() == 0  # 2,800 to retire are too many
    assert merge.retire_stale(ids.filter("id < 1500"), none, ids.filter("id < 200"), "id").count() == 1_300
    assert merge.retire_stale(ids.filter("id < 1500"), none, ids.filter("id < 50"), "id").count() == 0  # 50 mined are too few
