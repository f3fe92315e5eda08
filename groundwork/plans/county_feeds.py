"""Events of the counties' sales and rolls, made of orders and customers; four rules of absence; five address keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import absence, addresses
from groundwork.operators import county_feeds, emit
from groundwork.registry import query
from groundwork.session import table

DAY = "1997-03-01"
O = "WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders)"
OUT = ("source", "source_id", "county", "parcel_id", "event_type", "event_subtype", "event_date", "event_value", "severity", "title")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("observed_at", F.lit(None).cast("timestamp")).withColumn("d", F.to_date("o_orderdate"))


def _iso(c):
    return F.date_format(c, "yyyy-MM-dd")


@query(
    "county_sales",
    f"""{O}
    SELECT 'hennepin_sheriff' AS source, CAST(o_orderkey AS VARCHAR) AS source_id, 'hennepin' AS county, CASE WHEN o_orderkey % 3 = 0 THEN 'P' || o_custkey ELSE 'HENNEPIN-FC-' || o_orderkey END AS parcel_id, 'sheriff_sale' AS event_type, 'completed_sale' AS event_subtype, d AS event_date, v AS event_value,
      CASE WHEN o_orderkey % 5 = 0 THEN 'medium' WHEN d + 180 >= DATE '{DAY}' THEN 'high' ELSE 'low' END AS severity, 'Completed sale: ' || CASE WHEN o_orderkey % 7 = 0 THEN 'address unknown' ELSE o_custkey || ' Oak St' END AS title FROM o WHERE o_orderkey % 11 <> 0
    UNION ALL SELECT 'anoka_sheriff', p || '-' || d || '-' || s, 'anoka', p, 'sheriff_sale', s, d, v, CASE WHEN s = 'completed_sale' THEN 'low' WHEN d >= DATE '{DAY}' AND o_orderkey % 4 > 1 THEN 'high' ELSE 'medium' END, CASE s WHEN 'pending_sale' THEN 'Scheduled' ELSE 'Completed' END || ' sale: ' || o_custkey || ' Elm St'
      FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'pending_sale' ELSE 'completed_sale' END AS s, CASE WHEN o_orderkey % 3 = 0 THEN 'G' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'T' || o_custkey ELSE 'ANOKA-FC-' || o_orderkey END AS p FROM o WHERE o_orderkey % 13 <> 0)
    UNION ALL SELECT 'dakota_sheriff', CAST(o_orderkey AS VARCHAR), 'dakota', 'DAKOTA-FC-' || year(d) || '-' || o_orderkey, 'sheriff_sale', 'completed_sale', d, v, CASE WHEN o_orderkey % 4 = 0 THEN 'high' WHEN year(d) >= 1997 THEN 'medium' ELSE 'low' END, 'Completed sale: ' || o_custkey || ' Ash St Eagan' FROM o
    UNION ALL SELECT 'washington_sheriff', pid || '-' || o_custkey, 'washington', CASE WHEN length(pid) = 13 THEN pid ELSE 'WASHINGTON-FC-' || pid END, 'sheriff_sale', CASE o_orderkey % 3 WHEN 0 THEN 'mortgage_foreclosure' WHEN 1 THEN 'assessment_lien' ELSE 'other_lien' END, d, v, CASE WHEN o_orderkey % 3 = 0 THEN 'medium' ELSE 'low' END, 'Completed sale' || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE ' of A' || o_custkey END
      FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE CAST(1000000000000 + o_orderkey AS VARCHAR) END AS pid FROM o)""",
)
def county_sales(spark, sf_dir):
    o, i, c = _orders(spark, sf_dir), F.col("o_orderkey"), F.col("o_custkey")
    day, money = F.lit(DAY).cast("date"), F.concat(F.lit("$"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2))
    none = F.lit(None).cast("string")
    seen = F.col("observed_at")
    hennepin = o.select(F.when(i % 11 == 0, " ").otherwise(i.cast("string")).alias("saleRecordNumber"), F.concat(_iso("d"), F.lit("T05:00:00Z")).alias("dateOfSale"), F.when(i % 5 != 0, F.concat(_iso(F.date_add("d", 180)), F.lit("T00:00:00Z"))).alias("redemptionExpirationDate"), money.alias("finalBidAmount"), F.when(i % 3 == 0, F.concat(F.lit("P"), c)).alias("resolved_parcel"), F.when(i % 7 == 0, "").otherwise(F.concat(c, F.lit(" Oak St"))).alias("address"), seen)
    anoka = o.select(i.cast("string").alias("detail_id"), F.when(i % 2 == 0, "Pending Sales").otherwise("Completed").alias("mode"), F.when(i % 13 != 0, F.date_format("d", "MM/dd/yyyy")).alias("scheduled_date"), none.alias("recorded_date"), F.when(i % 4 == 0, "Postponed to fall").otherwise("Active").alias("status"), F.when(i % 3 == 0, F.concat(F.lit("G"), c)).otherwise(" ").alias("gis_pid"), F.when(i % 3 == 1, F.concat(F.lit("T"), c)).alias("tax_parcel_no"), none.alias("resolved_parcel"), F.concat(c, F.lit(" Elm St")).alias("address"), money.alias("amount_due"), seen)
    dakota = o.select(i.alias("OBJECTID"), F.year("d").alias("layer_year"), F.when(i % 4 == 0, "Y").otherwise("").alias("Recent"), none.alias("resolved_parcel"), (F.unix_timestamp(F.col("d")) * 1000).alias("SaleDate"), money.alias("SaleAmount"), F.concat(c, F.lit(" Ash St")).alias("GeoAddress"), F.lit("Eagan").alias("City"), seen)
    pid = F.when(i % 5 == 0, i.cast("string")).otherwise(F.concat(F.lit(" "), (i + 1_000_000_000_000).cast("string")))
    washington = o.select(pid.alias("pid"), c.alias("docnum"), F.when(i % 3 == 0, "Mortgage by advert.").when(i % 3 == 1, "ASSESSMENT lien").alias("instrument_desc"), _iso("d").alias("sale_date"), money.alias("sale_amount"), F.when(i % 6 == 0, "").otherwise(F.concat(F.lit("A"), c)).alias("owner"), seen)
    made = [county_feeds.hennepin_sales(hennepin, day), county_feeds.anoka_sales(anoka, day), county_feeds.dakota_sales(dakota, day), county_feeds.washington_sales(washington)]
    return reduce(DataFrame.unionByName, made).select(*OUT)


@query(
    "county_rolls",
    f"""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN 't' WHEN c_custkey % 6 = 1 THEN 'N' END AS f, CASE WHEN c_custkey % 4 <> 0 THEN 80 + c_custkey % 20 END AS y, CAST(c_custkey % 150 * 100 AS DECIMAL(18,2)) AS a FROM customer),
    r AS (SELECT *, CASE WHEN f = 't' THEN 'tax_forfeit' WHEN y IS NOT NULL THEN 'tax_delinquent' END AS kind, CASE WHEN y > 97 THEN 1800 + y + 100 ELSE 1900 + y END AS year FROM c)
    SELECT 'hennepin_tax_roll' AS source, 'P' || k AS source_id, 'hennepin' AS county, 'P' || k AS parcel_id, kind AS event_type, CASE kind WHEN 'tax_forfeit' THEN 'state_forfeited_land' ELSE 'property_tax_delinquent' END AS event_subtype, CASE WHEN kind = 'tax_delinquent' THEN make_date(CAST(year AS INT), 1, 1) END AS event_date,
      CAST(NULL AS DECIMAL(18,2)) AS event_value, CASE WHEN kind = 'tax_forfeit' THEN 'medium' WHEN 1997 - year >= 3 THEN 'high' WHEN 1997 - year >= 1 THEN 'medium' ELSE 'low' END AS severity, CASE kind WHEN 'tax_forfeit' THEN 'Forfeited to the state' ELSE 'Taxes unpaid since ' || year END AS title FROM r WHERE kind IS NOT NULL
    UNION ALL SELECT 'ramsey_tax_roll', 'P' || k, 'ramsey', 'P' || k, 'tax_assessment', 'special_assessment_burden', NULL, a, CASE WHEN a >= 10000 THEN 'high' WHEN a >= 5000 THEN 'medium' ELSE 'low' END, 'Special assessment of $' || format('{{:,}}', CAST(a AS BIGINT)) FROM c WHERE a >= 2000 AND k % 3 = 1 AND k % 5 <> 0
    UNION ALL SELECT 'mnpn_redemption_notice', 'n' || k, 'pine', 'P' || k, 'tax_forfeiture_redemption', 'expiration_of_redemption', DATE '{DAY}' + CAST(k % 90 AS INT), a, 'high', 'Right of redemption ends' FROM c WHERE k % 7 NOT IN (0, 1) AND NOT (k % 10 = 3)""",
)
def county_rolls(spark, sf_dir):
    k, day = F.col("c_custkey"), F.lit(DAY).cast("date")
    base = table(spark, sf_dir, "customer").select(k, F.concat(F.lit("P"), k).alias("parcel_id"), F.lit(None).cast("timestamp").alias("observed_at"))
    roll = base.select("parcel_id", F.lit("hennepin").alias("county"), F.when(k % 6 == 0, "t").when(k % 6 == 1, "N").alias("forfeit_flag"), F.when(k % 4 != 0, (80 + k % 20).cast("string")).alias("delq_year"), "observed_at")
    amount = (k % 150 * 100).cast("string")
    ramsey = base.select("parcel_id", F.lit("ramsey").alias("county"), amount.alias("assessment"), F.lit("1 OAK  ST").alias("site"), F.when(k % 3 == 0, " 1 oak st ").when(k % 3 == 1, "PO Box 5").alias("mailing"), F.when(k % 5 == 0, "999").otherwise("510").alias("land_use"), "observed_at")
    staged = base.select("parcel_id", F.concat(F.lit("n"), k).alias("notice_id"), F.lit("pine").alias("county"), F.date_add(day, (k % 90).cast("int")).alias("expiry"), F.when(k % 7 != 0, (k % 150 * 100).cast("decimal(18,2)")).alias("amount"), F.when(k % 7 == 1, "rejected").alias("review_status"), "observed_at", k)
    there = staged.filter(k % 10 == 3).select("county", "parcel_id", F.col("expiry").alias("event_date"), F.lit("mnpn_redemption_notice").alias("source"))
    good = emit.promotable(F.col("parcel_id"), F.col("expiry"), F.col("amount"), F.col("review_status"))
    made = [county_feeds.tax_roll_events(roll, day), county_feeds.assessment_events(ramsey), county_feeds.redemption_notices(staged, there, good)]
    return reduce(DataFrame.unionByName, made).select(*OUT)


FLAGS = ["Y", "Yes", "no", "NON HOMESTEAD", "Full homestead", "", "P", "x"]


@query(
    "absence_rules",
    f"""WITH c AS (SELECT c_custkey, {FLAGS}[c_custkey % 8 + 1] AS h, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'same' ELSE 'other' END AS m FROM customer)
    SELECT c_custkey, coalesce(m = 'other', false) AS by_mailing, CASE h WHEN 'NON HOMESTEAD' THEN true WHEN 'Full homestead' THEN false END AS by_free_text,
      CASE WHEN h IN ('no', 'NON HOMESTEAD') THEN true WHEN h IN ('Y', 'Yes', 'Full homestead', 'P') THEN false END AS by_assessor, CASE WHEN h = 'Y' THEN false WHEN m IS NOT NULL THEN m = 'other' WHEN h <> '' THEN true END AS by_flag_or_street FROM c""",
)
def absence_rules(spark, sf_dir):
    k = F.col("c_custkey")
    flag = F.get(F.array(*map(F.lit, FLAGS)), (k % 8).cast("int"))
    mailing, site = F.when(k % 3 == 1, " 12  oak st").when(k % 3 == 2, "PO BOX 1"), F.lit("12 Oak St")
    return table(spark, sf_dir, "customer").select(k, absence.by_mailing(site, mailing).alias("by_mailing"), absence.by_free_text(flag).alias("by_free_text"), absence.by_assessor(flag).alias("by_assessor"), absence.by_flag_or_street(flag, mailing, site).alias("by_flag_or_street"))


RAW = ["Cornell Trail", "122nd St E #B-1", "18th Avenue South", "Oak St Apt 4", "Elm Lane unit", "Main Street NW  # 7"]
KEYS = {"two_layer": ["CORNELL TRL", "122ND ST E", "18TH AVE S", "OAK ST APT 4", "ELM LN UNIT", "MAIN ST NW"], "street": ["CORNELL TRAIL", "122ND ST E", "18TH AVENUE SOUTH", "OAK ST", "ELM LANE UNIT", "MAIN STREET NW"], "rekey": ["CORNELL", "122NDEB-1", "18TH", "OAK", "ELM", "MAINNW7"]}


@query("address_keys", "WITH p AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS n FROM part) SELECT p_partkey, " + ", ".join(f"n || {sep!r} || {[k.replace('-', '') if name == 'rekey' else k for k in keys]}[p_partkey % 6 + 1] AS {name}" for name, keys, sep in (("two_layer", KEYS["two_layer"], " "), ("street", KEYS["street"], " "), ("rekey", KEYS["rekey"], ""))) + " FROM p")
def address_keys(spark, sf_dir):
    i = F.col("p_partkey")
    raw = F.concat_ws(" ", i, F.get(F.array(*map(F.lit, RAW)), (i % 6).cast("int")))
    return table(spark, sf_dir, "part").select(i, addresses.two_layer_key(raw).alias("two_layer"), addresses.street_line(raw).alias("street"), addresses.rekey_key(raw).alias("rekey"))
