"""The event view, listings and the ten checks over tables made of orders, customers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.operators import integrity, views
from groundwork.registry import query
from groundwork.session import table

COUNTIES = ["anoka", "scott", "wright"]
DAY = "1998-08-02"

# parcels: every fourth is a placeholder, every 40th stands there twice
PARCELS = f"""p0 AS (SELECT {COUNTIES}[c_custkey % 3 + 1] AS county, CASE WHEN c_custkey % 4 = 0 THEN 'X-FC-' || c_custkey ELSE 'P' || c_custkey END AS parcel_id, (c_custkey % 750) || ' Oak St' AS address, 's' || (c_custkey % 5) AS data_sources,
    CASE WHEN c_custkey % 2 = 0 THEN DATE '{DAY}' ELSE DATE '1998-01-01' END AS created_at, CAST(c_acctbal AS DECIMAL(18,2)) AS emv_total, 1900 + c_custkey % 100 AS year_built, c_custkey AS k FROM customer)"""
# events: parcels of the order's customer; some without a county, some published in the raw record
EVENTS = f"""e AS (SELECT o_orderkey AS id, 's' || (o_custkey % 9) AS source, CASE WHEN o_custkey % 4 = 0 THEN 'X-FC-' || o_custkey ELSE 'P' || o_custkey END AS parcel_id, CASE WHEN o_orderkey % 5 <> 0 THEN {COUNTIES}[o_custkey % 3 + 1] END AS county,
    CASE WHEN o_orderstatus = 'O' THEN 'vacant' ELSE 'sheriff_sale' END AS event_type, CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'completed' END AS event_subtype, CASE WHEN o_orderkey % 7 <> 0 THEN make_date(CAST(year(o_orderdate) AS INT), 1, 1) END AS event_date,
    CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS event_value, CAST(o_orderdate AS DATE) - CAST(o_custkey % 9 * 10 AS INT) AS observed_at, o_custkey AS k FROM orders)"""


def _pick(x):
    return F.get(F.array(*map(F.lit, COUNTIES)), (x % 3).cast("int"))


def _parcel(x):
    return F.when(x % 4 == 0, F.concat(F.lit("X-FC-"), x)).otherwise(F.concat(F.lit("P"), x))


def parcels(spark, sf_dir):
    k = F.col("c_custkey")
    made = F.when(k % 2 == 0, DAY).otherwise("1998-01-01").cast("date")
    return table(spark, sf_dir, "customer").select(_pick(k).alias("county"), _parcel(k).alias("parcel_id"), F.concat(k % 750, F.lit(" Oak Street")).alias("address"), F.concat(F.lit("s"), k % 5).alias("data_sources"), made.alias("created_at"), F.col("c_acctbal").cast("decimal(18,2)").alias("emv_total"), (1900 + k % 100).alias("year_built"))


def events(spark, sf_dir):
    i, k = F.col("o_orderkey"), F.col("o_custkey")
    raw = F.when(i % 5 == 0, F.to_json(F.struct(F.struct(F.when(i % 10 == 0, F.concat(F.lit("P"), k + 1)).alias("gis_pid"), F.when(k % 9 > 3, F.concat(F.initcap(_pick(k)), F.lit(" County"))).alias("county")).alias("detail"))))
    return table(spark, sf_dir, "orders").select(
        i.alias("id"),
        F.concat(F.lit("s"), k % 9).alias("source"),
        _parcel(k).alias("parcel_id"),
        F.when(i % 5 != 0, _pick(k)).alias("county"),
        F.when(F.col("o_orderstatus") == "O", "vacant").otherwise("sheriff_sale").alias("event_type"),
        F.when(i % 2 == 0, "pending").otherwise("completed").alias("event_subtype"),
        F.when(i % 7 != 0, F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1))).alias("event_date"),
        F.when(i % 6 != 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("event_value"),
        F.date_sub(F.to_date("o_orderdate"), (k % 9 * 10).cast("int")).alias("observed_at"),
        raw.alias("raw"),
    )


def sources(spark, sf_dir):
    """s0 to s3 serve one county each; s4 to s6 many, so theirs is null; s7 and s8 are not there."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter(k % 9 < 7).select(F.concat(F.lit("s"), k % 9).alias("source"), F.when(k % 9 < 4, F.get(F.array(*map(F.lit, COUNTIES)), (k % 9 % 3).cast("int"))).alias("county")).distinct()


def sales(spark, sf_dir):
    """Every order's sale day, with several windows of a day and parcel."""
    i, k = F.col("o_orderkey"), F.col("o_custkey")
    day = F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1))
    return table(spark, sf_dir, "orders").filter(i % 3 == 0).select(_pick(k).alias("county"), _parcel(k).alias("parcel_id"), day.alias("sale_date"), F.date_add(day, (180 + i % 400).cast("int")).alias("redemption_date"))


def _view(spark, sf_dir):
    p = parcels(spark, sf_dir)
    twice = p.unionByName(p.filter("parcel_id like '%0'"))  # a parcel that is there twice adds no rows
    return views.distress_with_parcel(events(spark, sf_dir), sources(spark, sf_dir), twice, sales(spark, sf_dir), F.lit(DAY).cast("date"), ("emv_total", "year_built"))


VIEW = f"""{PARCELS}, {EVENTS},
    v0 AS (SELECT e.*, CASE WHEN k % 4 = 0 AND id % 10 = 0 THEN 'P' || (k + 1) ELSE parcel_id END AS eff_parcel_id,
      coalesce(county, CASE WHEN k % 9 < 4 THEN {COUNTIES}[k % 9 % 3 + 1] END, CASE WHEN k % 9 > 3 THEN {COUNTIES}[k % 3 + 1] END) AS county_slug FROM e),
    sl AS (SELECT {COUNTIES}[o_custkey % 3 + 1] AS county_slug, CASE WHEN o_custkey % 4 = 0 THEN 'X-FC-' || o_custkey ELSE 'P' || o_custkey END AS eff_parcel_id, make_date(CAST(year(o_orderdate) AS INT), 1, 1) AS sale_date, make_date(CAST(year(o_orderdate) AS INT), 1, 1) + CAST(180 + o_orderkey % 400 AS INT) AS ends FROM orders WHERE o_orderkey % 3 = 0),
    ex AS (SELECT county_slug, eff_parcel_id, sale_date, max(ends) AS ends FROM sl GROUP BY ALL),
    la AS (SELECT county_slug, eff_parcel_id, arg_max(ends, (sale_date, ends)) AS ends FROM sl GROUP BY ALL),
    v AS (SELECT v0.id, v0.source, v0.event_type, v0.event_date, v0.event_value, v0.eff_parcel_id, v0.county_slug, p0.emv_total, p0.year_built, CAST(coalesce(ex.ends, la.ends) AS DATE) - DATE '{DAY}' AS redemption_days_left, p0.emv_total - v0.event_value AS equity_spread
      FROM v0 LEFT JOIN p0 ON p0.county = v0.county_slug AND p0.parcel_id = v0.eff_parcel_id
      LEFT JOIN ex ON ex.county_slug = v0.county_slug AND ex.eff_parcel_id = v0.eff_parcel_id AND ex.sale_date = v0.event_date LEFT JOIN la ON la.county_slug = v0.county_slug AND la.eff_parcel_id = v0.eff_parcel_id)"""


@query(
    "distress_with_parcel",
    f"WITH {VIEW} SELECT id, eff_parcel_id, county_slug, emv_total, CAST(year_built AS BIGINT) AS year_built, CAST(redemption_days_left AS BIGINT) AS redemption_days_left, CAST(CASE WHEN redemption_days_left IS NULL THEN 2 WHEN redemption_days_left >= 0 THEN 0 ELSE 1 END AS BIGINT) AS redemption_sort_bucket, equity_spread, (SELECT count(*) FROM orders) AS n_events FROM v",
)
def distress_with_parcel(spark, sf_dir):
    """``n_events`` is the count of the view's own rows: it equals that of the events."""
    view = _view(spark, sf_dir)
    names = ["redemption_days_left", "redemption_sort_bucket"]
    return view.select("id", "eff_parcel_id", "county_slug", "emv_total", F.col("year_built").cast("long").alias("year_built"), *[F.col(c).cast("long").alias(c) for c in names], "equity_spread", view.agg(F.count(F.lit(1))).scalar().alias("n_events"))


@query(
    "listing_browse",
    f"""WITH {VIEW},
    l AS (SELECT s_suppkey AS id, DATE '1998-01-01' + CAST(s_suppkey % 50 AS INT) AS created_at, {COUNTIES}[s_suppkey % 3 + 1] AS county, CASE WHEN s_suppkey % 4 = 0 THEN 'X-FC-' || s_suppkey ELSE 'P' || s_suppkey END AS parcel_id, CAST(s_acctbal * 20 AS DECIMAL(18,2)) AS assessed_value FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0),
    r AS (SELECT * FROM (SELECT k, county, parcel_id, CASE k % 6 WHEN 0 THEN 'redeemed_by_owner' WHEN 1 THEN NULL ELSE 'pending' END AS outcome, k % 90 AS days_remaining FROM p0) WHERE k % 2 = 0),
    a AS (SELECT l.*, r.outcome, r.days_remaining FROM l LEFT JOIN r USING (county, parcel_id) WHERE (outcome IS NULL OR outcome = 'pending')),
    c AS (SELECT p0.county, floor(p0.emv_total * 20 / 50000) AS b, count(*) AS n FROM v JOIN p0 ON p0.county = v.county_slug AND p0.parcel_id = v.eff_parcel_id WHERE event_type = 'sheriff_sale' AND p0.emv_total IS NOT NULL GROUP BY ALL),
    d AS (SELECT county_slug, eff_parcel_id, arg_max(event_value, (event_date IS NOT NULL, coalesce(event_date, DATE '1900-01-01'), event_value)) AS owed FROM v WHERE event_type = 'sheriff_sale' AND event_value IS NOT NULL GROUP BY ALL),
    o AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1)
    SELECT a.id, created_at, a.county, assessed_value, days_remaining, outcome, c.n AS comparable_parcels, owed AS amount_owed, coalesce(o.n, 0) AS offer_count, (SELECT count(*) FROM a) AS total
    FROM a LEFT JOIN c ON c.county = a.county AND c.b = floor(assessed_value / 50000) LEFT JOIN d ON d.county_slug = a.county AND d.eff_parcel_id = a.parcel_id LEFT JOIN o ON o.id = a.id ORDER BY created_at DESC, a.id LIMIT 20""",
)
def listing_browse(spark, sf_dir):
    s, k = F.col("s_suppkey"), F.col("c_custkey")
    admits = F.when(s % 7 == 0, F.array(F.lit("retail"))).when(s % 7 < 4, F.array(F.lit("retail"), F.lit("investor")))
    listings = table(spark, sf_dir, "supplier").select(s.alias("id"), F.date_add(F.lit("1998-01-01").cast("date"), (s % 50).cast("int")).alias("created_at"), _pick(s).alias("county"), _parcel(s).alias("parcel_id"), (F.col("s_acctbal") * 20).cast("decimal(18,2)").alias("assessed_value"), F.when(s % 5 == 0, "withdrawn").otherwise("active").alias("status"), admits.alias("buyer_types"))
    outcome = F.when(k % 6 == 0, "redeemed_by_owner").when(k % 6 != 1, "pending")
    tracker = table(spark, sf_dir, "customer").filter(k % 2 == 0).select(_pick(k).alias("county"), _parcel(k).alias("parcel_id"), F.lit(DAY).cast("date").alias("anchor"), outcome.alias("outcome"), (k % 90).alias("days_remaining"))
    older = tracker.withColumn("anchor", F.date_sub("anchor", 400)).withColumn("outcome", F.lit("redeemed_by_owner"))
    valued = parcels(spark, sf_dir).withColumn("market_value", F.col("emv_total") * 20)
    offers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("listing_id"))
    return views.browse(listings, valued, tracker.unionByName(older), _view(spark, sf_dir), offers, limit=20)


LEVEL = "CASE WHEN n >= {0} THEN 'alert' WHEN n >= {1} THEN 'warn' ELSE 'info' END"


@query(
    "integrity_checks",
    f"""WITH {PARCELS}, {EVENTS},
    f AS (
      SELECT 'stubs_minted_today' AS "check", {LEVEL.format(20, 5)} AS severity, county, n, data_sources AS about FROM (SELECT county, data_sources, count(*) AS n FROM p0 WHERE k % 4 = 0 AND k % 2 = 0 GROUP BY ALL)
      UNION ALL SELECT 'stubs_resolvable', {LEVEL.format(50, 10)}, county, n, NULL FROM (SELECT s.county, count(*) AS n FROM p0 s WHERE s.k % 4 = 0 AND (SELECT count(DISTINCT r.parcel_id) FROM p0 r WHERE r.k % 4 <> 0 AND r.county = s.county AND r.address = s.address) = 1 GROUP BY 1)
      UNION ALL SELECT 'duplicate_events_same_parcel', 'alert', county, count(*), parcel_id || ':' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM e WHERE event_type = 'sheriff_sale' GROUP BY county, parcel_id, event_date, event_subtype HAVING count(*) > 1
      UNION ALL SELECT 'sheriff_sales_without_event', {LEVEL.format(20, 0)}, county, n, NULL FROM (SELECT county, count(*) AS n FROM (SELECT {COUNTIES}[o_custkey % 3 + 1] AS county, CASE WHEN o_custkey % 4 = 0 THEN 'X-FC-' || o_custkey ELSE 'P' || o_custkey END AS parcel_id FROM orders WHERE o_orderkey % 3 = 0) s
        WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.county = s.county AND e.parcel_id = s.parcel_id AND event_type = 'sheriff_sale') GROUP BY 1)
      UNION ALL SELECT 'imagery_failures_on_stubs', 'info', county, count(*), CAST(count(*) FILTER (k % 3 = 0) AS VARCHAR) FROM p0 WHERE k % 4 = 0 GROUP BY county
      UNION ALL SELECT 'events_orphaned_from_parcels', 'alert', coalesce(county, '(no county)'), count(*), CAST(min(id) AS VARCHAR) FROM e WHERE county IS NULL OR NOT EXISTS (SELECT 1 FROM p0 WHERE p0.county = e.county AND p0.parcel_id = e.parcel_id AND k % 13 <> 0) GROUP BY 3
      UNION ALL SELECT 'approved_never_promoted', 'warn', NULL, count(*), CAST(min(s_suppkey) AS VARCHAR) FROM supplier WHERE s_suppkey % 4 = 1 AND s_suppkey % 3 = 0 HAVING count(*) > 0
      UNION ALL SELECT 'source_silent_days', CASE WHEN d > 30 THEN 'alert' ELSE 'warn' END, NULL, d, source FROM (SELECT source, DATE '{DAY}' - max(observed_at) AS d FROM e GROUP BY 1) WHERE d > 14
      UNION ALL SELECT 'tracker_labels_invalidated', 'warn', {COUNTIES}[o_custkey % 3 + 1], count(*), CAST(min(o_orderkey) AS VARCHAR) FROM orders WHERE o_orderkey % 3 <> 2 AND CASE o_orderkey % 2 WHEN 0 THEN o_orderkey % 100 > 50 ELSE o_orderkey % 100 <= 50 END GROUP BY 3
      UNION ALL SELECT 'source_missing_registration', {LEVEL.format(100, 10)}, NULL, n, source || ':' || bare FROM (SELECT source, count(*) AS n, count(*) FILTER (county IS NULL) AS bare FROM e WHERE source IN ('s7', 's8', 's0') GROUP BY 1))
    SELECT * FROM f""",
)
def integrity_checks(spark, sf_dir):
    p, k, s, i, c = parcels(spark, sf_dir), F.col("c_custkey"), F.col("s_suppkey"), F.col("o_orderkey"), F.col("o_custkey")
    day = F.lit(DAY).cast("date")
    pictures = table(spark, sf_dir, "customer").select(_pick(k).alias("county"), _parcel(k).alias("parcel_id"), F.when(k % 3 == 0, "x").alias("pano_id"), F.lit("no_location").alias("status"))
    extractions = table(spark, sf_dir, "supplier").select(s.alias("id"), F.when(s % 4 == 1, "approved").otherwise("pending").alias("review_status"), F.when(s % 3 != 0, day).alias("promoted_at"))
    tracker = table(spark, sf_dir, "orders").select(i.alias("id"), _pick(c).alias("county"), F.when(i % 3 == 2, "arcgis_sale").otherwise("ecrv_sale").alias("detection_source"), F.when(i % 2 == 0, "redeemed_by_owner").otherwise("foreclosed_sold").alias("outcome"), F.date_add(day, (i % 100).cast("int")).alias("sale_date"), F.date_add(day, 50).alias("expiry"))
    health = table(spark, sf_dir, "customer").filter(k % 9 != 0).select(F.concat(F.lit("s"), k % 9).alias("source")).distinct()
    # for the orphans, every 13th parcel is gone
    tables = {"events": events(spark, sf_dir), "sales": sales(spark, sf_dir), "imagery": pictures, "extractions": extractions, "tracker": tracker, "source_counties": sources(spark, sf_dir), "source_health": health}
    found = integrity.run({**tables, "parcels": p}, day).filter(F.col("check") != "events_orphaned_from_parcels")
    gone = table(spark, sf_dir, "customer").filter(k % 13 == 0).select(_pick(k).alias("county"), _parcel(k).alias("parcel_id"))
    found = found.unionByName(integrity.orphaned_events(tables["events"], p.join(gone, ["county", "parcel_id"], "left_anti")))
    d = lambda name: F.try_element_at("detail", F.lit(name))
    about = F.coalesce(d("writer"), F.concat(d("parcel_id"), F.lit(":"), d("ids")), d("with_real_pano"), F.when(F.col("check").isin("events_orphaned_from_parcels", "approved_never_promoted", "tracker_labels_invalidated"), d("sample")), F.when(F.col("check") == "source_missing_registration", F.concat(d("source"), F.lit(":"), d("county_null_events"))), d("source"))
    return found.select("check", "severity", "county", "n", about.alias("about"))
