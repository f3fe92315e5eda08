"""Owners, geocoder look-ups, forfeited parcels, details, bands and moves over tables made of customers, orders, parts, suppliers and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.operators import aggregate, enrich
from groundwork.registry import query
from groundwork.session import table
from groundwork.sources import readers

NAMES = ["JOHN DOE", "ACME LLC", "FIRST BANK", "CITY OF EDINA"]
KINDS = ["individual", "llc_business", "bank_lender", "government"]


def _pick(names, x):
    return F.get(F.array(*map(F.lit, names)), x.cast("int"))


@query(
    "owner_rows",
    f"""SELECT c_custkey AS parcel_id, {NAMES}[c_custkey % 4 + 1] AS owner_name, {KINDS}[c_custkey % 4 + 1] AS owner_type, CASE WHEN c_custkey % 3 < 2 THEN c_custkey || ' Oak St' || CASE WHEN c_custkey % 2 = 0 THEN ' #4' ELSE '' END END AS mailing_address,
      CASE WHEN c_custkey % 3 < 2 THEN 'EDINA' END AS mailing_city, CASE WHEN c_custkey % 3 = 0 THEN 'MN' WHEN c_custkey % 3 = 1 THEN 'WI' END AS mailing_state, CASE WHEN c_custkey % 3 < 2 THEN c_custkey % 5 = 0 END AS is_absentee, CASE WHEN c_custkey % 3 < 2 THEN c_custkey % 3 = 1 END AS is_out_of_state
    FROM customer WHERE c_custkey % 7 <> 0""",
)
def owner_rows(spark, sf_dir):
    k = F.col("c_custkey")
    street = F.concat(k, F.lit(" Oak St"), F.when(k % 2 == 0, " #4").otherwise(""))
    name = _pick(NAMES, k % 4)
    features = table(spark, sf_dir, "customer").select(
        F.lit("hennepin").alias("county"), k.alias("parcel_id"), F.when(k % 5 == 0, "1 ELM ST").otherwise(F.concat(k, F.lit("  OAK ST"))).alias("site"), F.when(k % 7 == 0, " ").when(k % 2 == 0, name).alias("owner"), F.when(k % 7 != 0, name).alias("taxpayer"),
        F.when(k % 3 == 1, street).otherwise("C/O X").alias("line1"), F.when(k % 3 == 0, street).when(k % 3 == 1, "EDINA WI 54001").otherwise("PO BOX").alias("line2"), F.when(k % 3 == 0, "EDINA MN 55424-1000").otherwise("ATTN").alias("line3"),
    )
    return enrich.owner_rows(features).select("parcel_id", "owner_name", "owner_type", "mailing_address", "mailing_city", "mailing_state", "is_absentee", "is_out_of_state")


@query(
    "geocode_queries",
    """SELECT p_partkey AS parcel_id, CASE WHEN p_partkey % 5 = 0 THEN p_partkey || ' Oak St, Minneapolis, mn' ELSE p_partkey || ' Oak St, Edina, MN' || CASE WHEN p_partkey % 2 = 0 THEN ' 55424' ELSE '' END END AS query
    FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0""",
)
def geocode_queries(spark, sf_dir):
    k = F.col("p_partkey")
    address = F.when(k % 7 == 0, "Oak Street").when(k % 5 == 0, F.concat(k, F.lit(" Oak St, Minneapolis, mn"))).otherwise(F.concat(k, F.lit(" Oak St, rear")))
    parcels = table(spark, sf_dir, "part").select(F.lit("a").alias("county"), k.alias("parcel_id"), F.when(k % 3 == 0, 45.0).alias("lat"), address.alias("address"), F.when(k % 11 == 0, "").otherwise("Edina").alias("city"), F.when(k % 2 == 0, " 55424").otherwise(" ").alias("zip"))
    return enrich.geocode_queries(parcels).select("parcel_id", "query")


@query(
    "forfeit_pages",
    """WITH p AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS links FROM pages), e AS (SELECT page_id, unnest(range(1, len(links) + 1)) AS n FROM p)
    SELECT page_id, '12-' || lpad(CAST(page_id * 10 + n AS VARCHAR), 6, '0') AS parcel_id FROM e WHERE n % 2 = 0""",
)
def forfeit_pages(spark, sf_dir):
    """Menus of pages as tables, every second row with a parcel number in front; the others have a word, too few cells or too short a number."""
    html = F.regexp_replace(F.regexp_replace("html", "<ul>", "<table>"), "</ul>", "</table>")
    items = F.regexp_extract_all("html", F.lit(r'<li><a href="[^"]*">([^<]*)</a></li>'), F.lit(1))
    number = lambda n: F.concat(F.lit("12-"), F.lpad((F.col("page_id") * 10 + n).cast("string"), 6, "0"))
    row = lambda x, n: F.concat(F.lit("<tr><td>"), F.when(n % 2 == 0, number(n)).when(n % 4 == 1, "12-1").otherwise("Parcel number"), F.lit("</td><td>"), x, F.lit("</td><td>2</td></tr>"))
    rows = F.array_join(F.transform(items, lambda x, i: row(x, i + 1)), "")
    page = F.concat(F.substring_index(html, "<table>", 1), F.lit("<table><tr><td>12-00000000</td><td>x</td></tr>"), rows, F.lit("</table>"), F.substring_index(html, "</table>", -1))
    cells = readers.html_tables(table(spark, sf_dir, "pages").select("page_id", page.alias("html")), "html", ["page_id"])
    return enrich.forfeited(cells, ["page_id"]).select("page_id", "parcel_id")


@query(
    "list_with_details",
    """WITH d AS (SELECT l_orderkey, min(l_linenumber) AS n FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1)
    SELECT o_orderkey, CASE WHEN n IS NOT NULL THEN 'S' || n END AS status, CASE WHEN n IS NOT NULL THEN 'P' || o_orderkey END AS parcel FROM orders LEFT JOIN d ON l_orderkey = o_orderkey""",
)
def list_with_details(spark, sf_dir):
    key = F.col("l_orderkey")
    lines = table(spark, sf_dir, "lineitem").filter(key % 4 != 0)
    status = lines.select(key.alias("o_orderkey"), F.lit("status").alias("label"), F.concat(F.lit("S"), "l_linenumber").alias("value"), F.col("l_linenumber").alias("row_no"))
    parcel = lines.select(key.alias("o_orderkey"), F.lit("tax parcel").alias("label"), F.concat(F.lit("P"), key).alias("value"), F.lit(9).alias("row_no"))
    blank = parcel.withColumn("label", F.lit(""))
    out = enrich.with_details(table(spark, sf_dir, "orders").select("o_orderkey"), status.unionByName(parcel).unionByName(blank), "o_orderkey")
    said = lambda name: F.try_element_at("detail", F.lit(name))
    return out.select("o_orderkey", said("status").alias("status"), said("tax parcel").alias("parcel"))


@query(
    "band_scope",
    """WITH b AS (SELECT CASE WHEN c % 10 < 8 THEN c % 10 END AS county, ['direct_standard', 'reo_resale', 'seller_financed', 'auction'][k % 4 + 1] AS channel, count(*) AS n, quantile_cont(v, 0.5) AS median FROM (SELECT o_custkey AS c, o_orderkey // 7 AS k, o_totalprice AS v FROM orders) GROUP BY 1, 2),
    u AS (SELECT * FROM b WHERE channel <> 'seller_financed' AND n >= 15), w AS (SELECT county FROM u GROUP BY county HAVING count(*) FILTER (channel IN ('direct_standard', 'reo_resale')) = 2), a AS (SELECT DISTINCT c_custkey % 12 AS county FROM customer)
    SELECT u.county, CAST(u.county AS VARCHAR) AS scope, channel, n, median FROM u JOIN a USING (county) WHERE county IN (SELECT county FROM w WHERE county IS NOT NULL)
    UNION ALL SELECT a.county, 'minnesota', channel, n, median FROM a, (SELECT * FROM u WHERE county IS NULL) s WHERE a.county NOT IN (SELECT county FROM w WHERE county IS NOT NULL) AND EXISTS (SELECT 1 FROM w WHERE county IS NULL)""",
)
def band_scope(spark, sf_dir):
    c, k = F.col("o_custkey"), F.expr("o_orderkey div 7")
    sales = table(spark, sf_dir, "orders").select(F.when(c % 10 < 8, c % 10).alias("county"), _pick(["direct_standard", "reo_resale", "seller_financed", "auction"], k % 4).alias("channel"), F.col("o_totalprice").alias("share"), c.alias("days"))
    bands = aggregate.percentile_bands(sales, ["county", "channel"], "share", "days", least=1).select("county", "channel", "n", "median")
    asked = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 12).alias("county"))
    return enrich.shown_bands(bands, asked).select("county", F.col("scope").cast("string").alias("scope"), "channel", "n", "median")


@query(
    "normalised_rekey",
    """WITH p AS (SELECT c_custkey % 3 AS county, CASE WHEN c_custkey % 10 = 0 THEN 'X-FC-' || c_custkey ELSE CAST(1000000 + c_custkey % 1000 AS VARCHAR) END AS parcel_id FROM customer),
    u AS (SELECT county, parcel_id, count(DISTINCT parcel_id) AS n FROM p WHERE parcel_id NOT LIKE '%-FC-%' GROUP BY 1, 2)
    SELECT o_orderkey AS id, u.parcel_id FROM orders JOIN u ON u.county = o_orderkey % 3 AND u.parcel_id = CAST(1000000 + o_custkey % 1000 AS VARCHAR) WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0""",
)
def normalised_rekey(spark, sf_dir):
    i, c, k = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_custkey")
    number = (1_000_000 + c % 1000).cast("string")
    written = F.when(i % 5 == 0, number).otherwise(F.concat(F.substring(number, 1, 2), F.lit("-"), F.substring(number, 3, 9), F.lit(".")))
    events = table(spark, sf_dir, "orders").select(i.alias("id"), (i % 3).alias("county"), F.when(i % 2 == 0, "mnpublicnotice").otherwise("other").alias("source"), written.alias("parcel_id"))
    parcels = table(spark, sf_dir, "customer").select((k % 3).alias("county"), F.when(k % 10 == 0, F.concat(F.lit("X-FC-"), k)).otherwise((1_000_000 + k % 1000).cast("string")).alias("parcel_id"))
    return enrich.normalised_rekey(events, parcels.distinct(), "mnpublicnotice")


@query(
    "near_house_rekey",
    """WITH a AS (SELECT s_suppkey AS stub, 44 + s_suppkey * 0.0005 AS lat, -93 + (s_suppkey % 7) * 0.001 AS lng, s_suppkey % 20 AS h FROM supplier WHERE s_suppkey % 6 <> 0), b AS (SELECT p_partkey AS parcel_id, 44 + p_partkey * 0.0001 AS lat2, -93 + (p_partkey % 5) * 0.001 AS lng2, p_partkey % 20 AS h, p_partkey % 3 = 0 AS oak FROM part),
    d AS (SELECT stub, parcel_id FROM a JOIN b USING (h) WHERE oak AND 2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng) / 2), 2), 1.0))) <= 250)
    SELECT stub, min(parcel_id) AS parcel_id FROM d GROUP BY 1 HAVING count(*) = 1""",
)
def near_house_rekey(spark, sf_dir):
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    stubs = table(spark, sf_dir, "supplier").select(s.alias("stub"), (44 + s * 0.0005).alias("lat"), (-93 + s % 7 * 0.001).alias("lng"), F.when(s % 6 == 0, "Oak Street").otherwise(F.concat(s % 20, F.lit(" N Oak Street"))).alias("address"))
    parcels = table(spark, sf_dir, "part").select(p.alias("parcel_id"), (44 + p * 0.0001).alias("lat2"), (-93 + p % 5 * 0.001).alias("lng2"), F.concat(p % 20, F.when(p % 3 == 0, " OAK ST").otherwise(" ELM ST")).alias("address"))
    return enrich.near_house(stubs, parcels)
