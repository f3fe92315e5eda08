"""Repairs, run records, flags of pictures, counters and patches over tables made of orders, customers, events and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.functions.json_patch import set_path
from groundwork.operators import promote, repairs
from groundwork.plans import views
from groundwork.registry import query
from groundwork.session import table

DAY = "1998-08-02"


@query(
    "wrong_parcel_cleanup",
    """WITH e AS (SELECT o_orderkey AS id, o_custkey % 5 AS county, CAST(o_orderkey // 3 AS VARCHAR) AS sid, CASE WHEN (o_orderkey // 3) % 4 <> 0 THEN DATE '1997-01-01' END AS d, o_custkey AS k, o_orderkey % 3 = 0 AS wrong FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 1)
    SELECT id FROM e JOIN customer ON k = c_custkey WHERE wrong AND EXISTS (SELECT 1 FROM e y WHERE y.county = e.county AND y.sid = e.sid AND y.d IS NOT DISTINCT FROM e.d AND y.id <> e.id)""",
)
def wrong_parcel_cleanup(spark, sf_dir):
    i, k, c = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_custkey")
    case = F.expr("o_orderkey div 3")
    address = F.concat(k, F.lit(" Oak St."), F.when(i % 3 == 0, "x").otherwise(""))
    events = table(spark, sf_dir, "orders").select(i.alias("id"), (k % 5).alias("county"), F.when((i % 2 == 0) | (i % 3 == 1), "mpls_311").otherwise("other").alias("source"), case.cast("string").alias("source_id"), F.when(case % 4 != 0, "1997-01-01").cast("date").alias("event_date"), k.alias("parcel_id"), F.to_json(F.struct(address.alias("address"))).alias("raw"))
    parcels = table(spark, sf_dir, "customer").select((c % 5).alias("county"), c.alias("parcel_id"), F.concat(c, F.lit(" OAK ST")).alias("address"))
    return repairs.wrong_parcels(events, parcels, "mpls_311")


@query(
    "typed_backfill",
    """SELECT c_custkey AS parcel_id, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey * 10 AS DECIMAL(18,2)) END AS emv_total, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 4 WHEN c_custkey % 3 = 1 AND c_custkey % 60 > 0 THEN c_custkey % 60 * 43560 END AS DECIMAL(18,2)) AS lot_sqft,
      CAST(c_custkey % 4 AS BIGINT) AS num_units, CASE WHEN c_custkey % 2 = 0 THEN 'Residential single unit 1' END AS use_class, CASE WHEN c_custkey % 8 = 1 THEN 'farm' WHEN c_custkey % 2 = 0 THEN 'single_family' END AS property_type FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 6 <> 5""",
)
def typed_backfill(spark, sf_dir):
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    raw = F.to_json(F.struct(F.when(k % 5 == 0, "0").otherwise(text(k * 10)).alias("EMVTotal"), F.when(k % 3 == 0, text(k * 4)).otherwise("0").alias("DeededSqFt"), F.when(k % 3 == 1, text(k % 60)).alias("DeedAcres"), text(k % 4).alias("LivngUnits"), F.when(k % 2 == 0, "Residential single unit 1").otherwise("").alias("Class")))
    parcels = table(spark, sf_dir, "customer").select(F.when(k % 7 == 0, "dakota").otherwise("olmsted").alias("county"), k.alias("parcel_id"), F.when(k % 6 != 5, raw).alias("raw"), F.when(k % 8 == 1, "farm").alias("property_type"))
    return repairs.typed_backfill(parcels, "olmsted").select("parcel_id", "emv_total", "lot_sqft", F.col("num_units").cast("long").alias("num_units"), "use_class", "property_type")


@query("value_backfill", "SELECT c_custkey AS parcel_id, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1 ELSE c_custkey END AS BIGINT) AS emv FROM customer WHERE c_custkey % 5 <> 0 AND (c_custkey % 3 = 0 OR c_custkey % 4 = 0)")
def value_backfill(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    stored, found = c.select(k.alias("parcel_id"), F.when(k % 4 != 0, k).alias("emv")), c.select(k.alias("parcel_id"), F.when(k % 5 != 0, F.when(k % 3 == 0, k + 1).otherwise(k)).alias("emv"))
    return repairs.changed_only(stored, found, ["parcel_id"], "emv")


@query("cadence_table", "SELECT DISTINCT ['dakota_parcels', 'ramsey_parcels', 'ramsey_tax_roll', 'olmsted_tax_detail'][c_custkey % 6 + 1] AS source_name, CASE c_custkey % 6 WHEN 3 THEN 7 ELSE 31 END AS expected_interval_days FROM customer WHERE c_custkey % 6 < 4")
def cadence_table(spark, sf_dir):
    names = F.array(*map(F.lit, [*repairs.CADENCE, "other_a", "other_b"]))
    health = table(spark, sf_dir, "customer").select(F.get(names, (F.col("c_custkey") % 6).cast("int")).alias("source_name")).distinct()
    return repairs.cadence(health, F.lit(DAY).cast("date")).select("source_name", "expected_interval_days")


@query(
    "rekey_first_hit",
    f"""WITH {views.PARCELS}, {views.EVENTS},
    r AS (SELECT county, address, min(parcel_id) AS new FROM p0 WHERE k % 4 <> 0 AND k % 9 <> 0 GROUP BY ALL)
    SELECT e.id, r.new AS parcel_id FROM e JOIN p0 s ON s.county = e.county AND s.parcel_id = e.parcel_id JOIN r ON r.county = s.county AND r.address = s.address WHERE e.source = 's4' AND e.parcel_id LIKE 'X-FC-%'""",
)
def rekey_first_hit(spark, sf_dir):
    k = F.expr("CAST(regexp_replace(parcel_id, '[^0-9]', '') AS BIGINT)")
    parcels = views.parcels(spark, sf_dir).withColumn("emv_total", F.when(k % 9 != 0, F.col("emv_total")))
    return repairs.rekey_first(views.events(spark, sf_dir), parcels, "s4")


@query(
    "run_records",
    f"""SELECT o_orderkey AS id, 's' || (o_custkey % 9) AS scraper, CASE WHEN o_orderkey % 10 = 0 THEN 'failed' WHEN o_orderkey % 4 = 0 THEN 'failed' WHEN o_orderkey % 4 = 1 THEN 'partial' ELSE 'success' END AS status, (DATE '{DAY}' - CAST(o_orderdate AS DATE)) * 86400 AS duration_seconds
    FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 <> 0""",
)
def run_records(spark, sf_dir):
    i = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    names = o.select(i, F.concat(F.lit("s"), F.col("o_custkey") % 9).alias("scraper"), F.to_date("o_orderdate").cast("timestamp").alias("began"), F.col("o_orderstatus").alias("s"))
    runs = repairs.open_runs(names.filter("s = 'O'"), F.col("began"), i).unionByName(repairs.open_runs(names.filter("s <> 'O'"), F.col("began"), i).withColumn("status", F.lit("success")))
    failed = F.when(i % 4 == 0, 100).when(i % 4 == 1, 20).otherwise(i % 5)
    results = o.filter(i % 3 != 0).select(i.alias("id"), F.lit(100).alias("fetched"), F.lit(1).alias("new"), F.lit(2).alias("updated"), failed.alias("failed"), F.when(i % 10 == 0, "timed out").alias("error"))
    return repairs.close_runs(runs, results, F.lit(DAY).cast("timestamp")).select("id", "scraper", "status", "duration_seconds")


@query("imagery_flag", "SELECT o_orderkey, o_custkey % 6 IN (0, 3) AND o_custkey % 10 < 5 AND o_orderkey % 2 = 0 AS imagery_available FROM orders")
def imagery_flag(spark, sf_dir):
    i, k, c = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_custkey")
    rows = table(spark, sf_dir, "orders").select(i, F.when(i % 2 == 0, "anoka").when(i % 4 == 1, "scott").alias("county"), k.alias("parcel_id"))
    shots = table(spark, sf_dir, "customer").select(F.lit("anoka").alias("county"), c.alias("parcel_id"), F.when(c % 3 == 0, "ok").otherwise("too_far").alias("status")).filter(c % 10 < 5)
    return repairs.with_imagery_flag(rows, shots.unionByName(shots)).select("o_orderkey", "imagery_available")


@query("digest_counters", "SELECT count(*) AS due, count(*) FILTER (o_custkey % 4 = 0) AS empty, count(*) FILTER (o_custkey % 4 = 1) AS failed, count(*) FILTER (o_custkey % 4 > 1) AS sent FROM orders")
def digest_counters(spark, sf_dir):
    """Every due search has one outcome; the counters are metrics of the run itself, and one that does not add up fails."""
    tally = promote.Tally(["empty", "failed", "sent"])
    due = tally.due(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    k = F.col("o_custkey") % 4
    ended = tally.ended(due.withColumn("outcome", F.when(k == 0, "empty").when(k == 1, "failed").otherwise("sent")), "outcome")
    ended.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tally.counts()], "due long, empty long, failed long, sent long")


@query("provenance_patch", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'user ' || user_id AS moved_from, event_id % 2 = 0 AS had_more FROM events")
def provenance_patch(spark, sf_dir):
    e = F.col("event_id")
    raw = F.when(e % 2 == 0, set_path(F.col("props"), ["more", "deep"], F.lit("[1]"))).otherwise(F.col("props"))
    note = F.to_json(F.struct(F.concat(F.lit("user "), F.col("user_id")).alias("from")))
    out = table(spark, sf_dir, "events").select(e, set_path(raw, ["_rekey"], note).alias("raw"))
    at = lambda path: F.get_json_object("raw", path)
    return out.select("event_id", at("$.k").cast("long").alias("k"), at("$._rekey.from").alias("moved_from"), (at("$.more.deep[0]") == "1").isNotNull().alias("had_more"))
