import datetime

from pyspark.sql import functions as F

from groundwork.operators import parcels, portal


def test_pieces_are_the_text():
    text = "a" * 30 + "\nHEAD one " + "b c " * 50 + "\nHEAD two" + "x" * 500
    for least, most in ((1, 40), (100, 60), (1_000, 10_000)):
        pieces = parcels.split_text(text, r"\nHEAD", least, most)
        assert "".join(pieces) == text and all(0 < len(p) <= most for p in pieces)
    assert parcels.split_text(None, "x") == parcels.split_text("", "x") == []


def test_pieces_of_a_table(spark):
    rows = spark.createDataFrame([(1, "one\nHEAD two"), (2, None), (None, "x")], "id int, text string")
    got = sorted(((r["id"] or 0), r["piece_no"], r["piece"]) for r in parcels.notice_pieces(rows, "text", ["id"], r"\nHEAD", 1, 100).collect())
    assert got == [(0, 0, "x"), (1, 0, "one"), (1, 1, "\nHEAD two")]


def test_absentee(spark):
    rows = spark.createDataFrame([("Y", "1 Oak", "2 Oak"), (None, "1 Oak", "1 OAK "), ("N", "1 Oak", "2 Oak"), (None, None, "2 Oak")], "h string, a string, b string")
    got = [r["x"] for r in rows.select(parcels.absentee(F.col("h"), F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [False, False, True, None]
    assert rows.select(parcels.absentee(F.col("h"), F.col("a"), F.col("b"), False).alias("x")).collect()[3]["x"] is False


def test_notice_kinds(spark):
    rows = spark.createDataFrame([("Sheriff's sale: mortgagor Doe",), ("Notice of EXPIRATION OF REDEMPTION of delinquent tax",), ("hello",), (None,)], "t string")
    assert [r["k"] for r in rows.select(parcels.notice_kind(F.col("t")).alias("k")).collect()] == ["foreclosure", "tax_forfeit", "other", "other"]


def test_values_and_facts(spark):
    r = spark.createDataFrame([(0, 5, "scraped"), (None, 0, "county_stated"), (7, 5, None)], "a int, b int, p string")
    got = r.select(portal.market_value(F.col("a"), F.col("b")).alias("v"), portal.confidence(F.col("p")).alias("c"), portal.facts({"a": F.col("a"), "p": F.col("p")}).alias("f")).collect()
    assert [tuple(x) for x in got] == [(5, "stated", ["a: 0", "p: scraped"]), (None, "assumed", ["p: county_stated"]), (7, "assumed", ["a: 7"])]


def test_placeholder_with_an_undated_twin_goes(spark):
    d = datetime.date(2000, 1, 1)
    rows = spark.createDataFrame([("a", d), ("a", None), (None, d), ("b", datetime.date(2084, 1, 1))], "k string, d date")
    got = sorted(((r["k"] or ""), r["d"]) for r in parcels.without_placeholders(rows, ["k"], "d", F.col("d") == F.lit(d), F.lit("2026-01-01").cast("date")).collect())
    assert got == [("", None), ("a", None), ("b", datetime.date(1984, 1, 1))]
