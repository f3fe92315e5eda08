"""Repairs and bookkeeping over the test tables: orders stand for runs, trackers and events, customers for parcels."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.operators import upkeep
from groundwork.registry import query
from groundwork.session import table

DAY = "1997-06-01"


def _day():
    return F.lit(DAY).cast("date")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "i", "o_custkey": "c"}).withColumn("d", F.to_date("o_orderdate"))


@query(
    "run_orphan_sweep",
    """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 21 < 20 THEN 's' || (o_custkey % 21) END AS scraper, o_orderstatus = 'O' AS running, CAST(o_orderdate AS DATE) AS d FROM orders),
    l AS (SELECT scraper, arg_max(id, (d, id)) AS latest FROM r WHERE scraper IS NOT NULL GROUP BY 1)
    SELECT id, r.scraper, 'interrupted' AS status, DATE '1997-06-01' AS finished_at, coalesce(id = latest, false) AS unhealthy, error_tail FROM (SELECT *, 'started_at=' || d AS error_tail FROM r WHERE running) r LEFT JOIN l ON l.scraper = r.scraper""",
)
def run_orphan_sweep(spark, sf_dir):
    c = F.col("c")
    runs = _orders(spark, sf_dir).select(F.col("i").alias("id"), F.when(c % 21 < 20, F.concat(F.lit("s"), c % 21)).alias("scraper"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("success").alias("status"), F.col("d").alias("started_at"))
    return upkeep.close_orphans(runs, _day()).select("id", "scraper", "status", "finished_at", "unhealthy", F.regexp_extract("error_message", r"(started_at=.*)$", 1).alias("error_tail"))


@query(
    "scraper_health_summary",
    """SELECT count(*) AS total, count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 3 = 0) AS healthy, count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 3 = 1) AS unhealthy, count(*) FILTER (c_custkey % 5 = 0) AS disabled,
    count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 3 = 2) AS never_run FROM customer""",
)
def scraper_health_summary(spark, sf_dir):
    i = F.col("c_custkey")
    return upkeep.health_summary(table(spark, sf_dir, "customer").select((i % 5 != 0).alias("enabled"), F.when(i % 3 != 2, i % 3 == 0).alias("is_healthy")))


@query(
    "due_checks",
    f"""WITH t AS (SELECT o_orderkey AS id, ['hennepin', 'ramsey', 'anoka'][o_custkey % 3 + 1] AS county, CASE WHEN o_custkey % 7 = 0 THEN '12-' || o_custkey ELSE CAST(1000000000000 + o_custkey AS VARCHAR) END AS pid, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s FROM orders)
    SELECT id, county, d AS redemption_date FROM t WHERE s = 'O' AND d + 30 <= DATE '{DAY}' AND county IN ('hennepin', 'ramsey') AND NOT pid LIKE '12-%'""",
)
def due_checks(spark, sf_dir):
    c = F.col("c")
    t = _orders(spark, sf_dir).select(
        F.col("i").alias("id"),
        F.get(F.array(*map(F.lit, ("hennepin", "ramsey", "anoka"))), (c % 3).cast("int")).alias("county"),
        F.when(c % 7 == 0, F.concat(F.lit("12-"), c)).otherwise((c + 1_000_000_000_000).cast("string")).alias("parcel_id"),
        F.when(F.col("o_orderstatus") == "O", "pending").otherwise("redeemed_by_owner").alias("outcome"),
        F.date_add("d", 30).alias("next_check_date"),
        F.col("d").alias("redemption_date"),
    )
    return upkeep.due(t, ["hennepin", "ramsey"], _day()).select("id", "county", "redemption_date")


@query(
    "first_check_day",
    f"""WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 THEN DATE '{DAY}' - CAST(o_orderkey % 230 AS INT) END AS e FROM orders)
    SELECT id, CAST(CASE WHEN e + 30 > DATE '{DAY}' THEN e + 30 WHEN e + 60 > DATE '{DAY}' THEN e + 60 WHEN e + 90 > DATE '{DAY}' THEN e + 90 WHEN e + 180 > DATE '{DAY}' THEN e + 180 ELSE DATE '{DAY}' END AS DATE) AS day FROM t""",
)
def first_check_day(spark, sf_dir):
    i = F.col("i")
    return _orders(spark, sf_dir).select(i.alias("id"), upkeep.check_day(F.when(i % 9 != 0, F.date_sub(_day(), (i % 230).cast("int"))), _day()).alias("day"))


@query(
    "rekey_unique_address",
    """WITH ev AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'ANOKA-FC-' || o_orderkey ELSE 'P' || o_custkey END AS parcel_id, CASE WHEN o_orderkey % 11 <> 0 THEN 'K' || o_custkey END AS key,
      o_orderstatus AS event_type, CASE WHEN o_orderkey % 7 <> 0 THEN year(o_orderdate) END AS event_date, o_orderkey % 2 AS source FROM orders),
    sp AS (SELECT 'P' || c_custkey AS parcel_id, 'K' || CASE WHEN c_custkey % 5 = 0 THEN c_custkey - 1 ELSE c_custkey END AS key FROM customer),
    m AS (SELECT ev.id, event_type, event_date, source, min(sp.parcel_id) AS new_id FROM ev JOIN sp ON sp.key = ev.key WHERE ev.parcel_id LIKE '%-FC-%' GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT sp.parcel_id) = 1)
    SELECT id, new_id AS parcel_id FROM m WHERE NOT EXISTS (SELECT 1 FROM ev x WHERE x.parcel_id = m.new_id AND x.event_type = m.event_type AND x.event_date = m.event_date AND x.source = m.source AND x.id <> m.id)
      AND NOT EXISTS (SELECT 1 FROM m n WHERE n.id <> m.id AND n.new_id = m.new_id AND n.event_type = m.event_type AND n.event_date = m.event_date AND n.source = m.source)""",
)
def rekey_unique_address(spark, sf_dir):
    i, c, k = F.col("i"), F.col("c"), F.col("c_custkey")
    ev = _orders(spark, sf_dir).select(
        i.alias("id"),
        F.lit("anoka").alias("county"),
        F.when(i % 3 == 0, F.concat(F.lit("ANOKA-FC-"), i)).otherwise(F.concat(F.lit("P"), c)).alias("parcel_id"),
        F.when(i % 11 != 0, F.concat(F.lit("K"), c)).alias("key"),
        F.col("o_orderstatus").alias("event_type"),
        F.when(i % 7 != 0, F.year("d")).alias("event_date"),
        (i % 2).alias("source"),
    )
    spine = table(spark, sf_dir, "customer").select(F.lit("anoka").alias("county"), F.concat(F.lit("P"), k).alias("parcel_id"), F.concat(F.lit("K"), F.when(k % 5 == 0, k - 1).otherwise(k)).alias("key"))
    return upkeep.unique_rekey(ev, spine)


@query(
    "republication_guard",
    """WITH ev AS (SELECT ['anoka', 'scott'][o_custkey % 2 + 1] AS county, CASE WHEN o_orderkey % 2 = 0 THEN 'STUB-FC-' || o_orderkey ELSE 'P' || o_custkey END AS parcel_id, CAST(o_custkey * 100 AS VARCHAR) AS pub, o_orderkey % 4 = 2 AS resolved FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 3 <> 0)
    SELECT 'anoka' AS county, 'P' || c_custkey AS parcel_id FROM customer c WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.county = 'anoka' AND ev.parcel_id = 'P' || c_custkey)
      AND (c_custkey % 10 = 0 OR NOT EXISTS (SELECT 1 FROM ev WHERE ev.county = 'anoka' AND NOT resolved AND pub = CAST(c_custkey * 100 AS VARCHAR)))""",
)
def republication_guard(spark, sf_dir):
    i, c, k = F.col("i"), F.col("c"), F.col("c_custkey")
    ev = _orders(spark, sf_dir).select(
        F.get(F.array(F.lit("anoka"), F.lit("scott")), (c % 2).cast("int")).alias("county"),
        F.when(i % 2 == 0, F.concat(F.lit("STUB-FC-"), i)).otherwise(F.concat(F.lit("P"), c)).alias("parcel_id"),
        F.concat(c, F.lit("-0.0")).alias("published"),
        F.when(i % 4 == 2, _day()).alias("resolved_at"),
        F.when(F.col("o_orderstatus") != "F", "sheriff_sale").otherwise("probate_filing").alias("event_type"),
        F.when(i % 3 != 0, "anoka_sheriff").otherwise("mpls_vbr").alias("source"),
    )
    notices = table(spark, sf_dir, "customer").select(F.lit("anoka").alias("county"), F.concat(F.lit("P"), k).alias("parcel_id"), F.when(k % 10 != 0, F.concat(k, F.lit(".00"))).otherwise("none").alias("pin"))
    return upkeep.not_promoted(notices, ev, ["anoka_sheriff", "mnpublicnotice"]).select("county", "parcel_id")


@query("mined_parcels", "SELECT 'P' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS parcel_id FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey % 3 = 1 AND c_custkey > 20 ORDER BY c_custkey LIMIT 50")
def mined_parcels(spark, sf_dir):
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") % 2 == 0, "hennepin").otherwise("ramsey").alias("county"), F.format_string("P%09d", k).alias("parcel_id"), F.array(F.lit("assessor"), F.concat(F.lit("roll"), k % 3)).alias("data_sources"))
    return upkeep.mined(p, "hennepin", "roll1", F.lit("P000000020"), 50).select("parcel_id")
