"""Landed pages and files: portal pages of all parcels, certificates of sale, links of web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.operators import aggregate
from groundwork.registry import query
from groundwork.session import table
from groundwork.sources import certificates, portal, readers
from groundwork.sources import county_parcels as county_layers

# --- portal pages: one of each customer, with all of their orders as tax lines ---------------

# what the pages say, in the terms of the tables
LINES = """SELECT o_custkey AS parcel, CASE WHEN o_orderstatus = 'F' THEN 'delinquent' ELSE 'current' END AS kind, CAST(year(o_orderdate) AS INT) AS pay_year, CASE WHEN o_orderkey % 2 = 0 THEN '1NAN' ELSE '2NAN' END AS cycle,
  CAST(o_totalprice AS DECIMAL(18,2)) AS base_taxes, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 500 AS DECIMAL(18,2)) END AS penalty_due, CAST(0 AS DECIMAL(18,2)) AS fees_due, CAST(o_orderkey % 7 AS DECIMAL(18,2)) AS total_paid,
  CAST(o_orderkey % 1000 + 1 AS DECIMAL(18,2)) AS total_due, CASE WHEN o_orderkey % 5 <> 0 THEN make_date(CAST(2000 + year(o_orderdate) % 100 AS INT), CAST(month(o_orderdate) AS INT), CAST(day(o_orderdate) AS INT)) END AS date_last_paid
FROM orders WHERE o_custkey % 11 <> 3"""


def _cells(*cells):
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td> "), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))


def _pages(spark, sf_dir):
    """One page a customer, as a portal writes it: layout tables around tables, headings in cells and outside, a total line."""
    o, i = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    amount = lambda c: F.concat(F.lit("$"), F.format_number(c.cast("decimal(18,2)"), 2))
    paid = F.when(i % 5 != 0, F.upper(F.date_format("o_orderdate", "dd-MMM-yy"))).otherwise("&nbsp;")
    penalty = F.when(i % 3 != 0, amount(i % 500)).otherwise("")
    cycle = F.when(i % 2 == 0, "1NAN").otherwise("2NAN")
    line = _cells(F.year("o_orderdate").cast("string"), cycle, amount(F.col("o_totalprice")), penalty, F.lit("$.00"), amount(i % 7), paid, amount(i % 1000 + 1))
    lines = o.groupBy("o_custkey").agg(*[F.array_join(F.collect_list(F.when(late, line)), "").alias(k) for k, late in (("late", F.col("o_orderstatus") == "F"), ("now", F.col("o_orderstatus") != "F"))])
    names = ["Pay Year", "Cycle", "Base Taxes", "Penalty Due", "Fees", "Total Amnt Paid", "Date Last Paid", "Total Due"]
    head = F.lit("<tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>")
    total = F.lit("<tr><td>Total:</td><td></td><td>$1.00</td></tr>")
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").join(lines, k == F.col("o_custkey"), "left")
    asked = F.when(k % 11 == 3, k + 1).otherwise(k)
    page = F.concat(
        F.lit("<html><body><table>"),
        _cells(F.lit("PARID:"), asked.cast("string")),
        _cells(F.lit("In Forfeiture:"), F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "no").otherwise("&nbsp;")),
        F.lit("<tr><td><b>Delinquent Taxes</b></td></tr><tr><td><table>"),
        head,
        F.coalesce("late", F.lit("")),
        total,
        F.lit("</table></td></tr></table><h2>Current Taxes Due&nbsp;</h2><table>"),
        head,
        F.coalesce("now", F.lit("")),
        total,
        F.lit("</table><table>"),
        _cells(F.lit("Name:"), F.regexp_replace("c_name", "#", " &amp; ")),
        _cells(F.when(k % 3 == 0, "&nbsp;").otherwise("Note:"), F.lit("SECOND <i>OWNER</i>")),
        _cells(F.lit("Owner Address:"), F.concat(k.cast("string"), F.lit(" MAIN ST"))),
        _cells(F.lit("City State Zip:"), F.concat(F.lit("ROCHESTER MN 559"), F.lpad((k % 100).cast("string"), 2, "0"))),
        F.lit("</table></body></html>"),
    )
    return c.select(k.alias("parcel"), page.alias("html"))


def _answered(spark, sf_dir):
    return portal.answered(portal.parsed(_pages(spark, sf_dir), "html", ["parcel"]), "parcel")


@query("portal_tax_lines", LINES)
def portal_tax_lines(spark, sf_dir):
    lines = portal.tax_lines(_answered(spark, sf_dir)[0], ["parcel"])
    return lines.select("parcel", "kind", "pay_year", "cycle", "base_taxes", "penalty_due", "fees_due", "total_paid", "total_due", "date_last_paid")


@query(
    "portal_tax_years",
    f"SELECT parcel, kind, pay_year, CAST(sum(base_taxes) AS DECIMAL(18,2)) AS base_taxes, CAST(sum(total_due) AS DECIMAL(18,2)) AS total_due, max(date_last_paid) AS date_last_paid, count(*) AS cycles FROM ({LINES}) GROUP BY 1, 2, 3",
)
def portal_tax_years(spark, sf_dir):
    years = portal.tax_years(portal.tax_lines(_answered(spark, sf_dir)[0], ["parcel"]), ["parcel"])
    return years.select("parcel", "kind", "pay_year", "base_taxes", "total_due", "date_last_paid", F.size("cycles").cast("long").alias("cycles"))


@query(
    "portal_delinquency",
    f"""WITH y AS (SELECT parcel, pay_year, sum(total_due) AS due, sum(total_paid) AS paid, max(date_last_paid) AS last FROM ({LINES}) GROUP BY 1, 2)
    SELECT parcel, min(pay_year) FILTER (due > paid) AS first_unpaid_year, count(*) FILTER (due > paid) AS unpaid_years, CAST(coalesce(sum(due - paid) FILTER (due > paid), 0) AS DECIMAL(18,2)) AS total_owed, max(last) AS last_payment,
      CAST(coalesce(sum(due) FILTER (pay_year = 1996), 0) AS DECIMAL(18,2)) AS current_due FROM y GROUP BY 1""",
)
def portal_delinquency(spark, sf_dir):
    lines = portal.tax_lines(_answered(spark, sf_dir)[0], ["parcel"])
    out = aggregate.delinquency(lines, ["parcel"], "pay_year", "total_due", "total_paid", "date_last_paid", F.lit(1996))
    return out.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("total_owed", "current_due")})


@query(
    "portal_owners",
    """SELECT c_custkey AS parcel, replace(c_name, '#', ' & ') AS owner_name, CASE WHEN c_custkey % 3 = 0 THEN 'SECOND OWNER' END AS owner_name_2, c_custkey || ' MAIN ST' AS mailing_address, 'ROCHESTER' AS city, 'MN' AS state,
      '559' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS zip, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS in_forfeiture, CAST(NULL AS BOOLEAN) AS in_bankruptcy
    FROM customer WHERE c_custkey % 11 <> 3""",
)
def portal_owners(spark, sf_dir):
    pages = _answered(spark, sf_dir)[0]
    # both are columns of the same parsed rows, so one scan gives them
    flags = [portal.flag(portal.labelled(name)).alias(out) for out, name in portal.FLAGS.items() if out in ("in_forfeiture", "in_bankruptcy")]
    return portal.owners(pages.select("parcel", "rows", *flags), ["parcel", "in_forfeiture", "in_bankruptcy"])


@query("portal_rejects", "SELECT c_custkey AS parcel, 'another parcel' AS reason FROM customer WHERE c_custkey % 11 = 3")
def portal_rejects(spark, sf_dir):
    return _answered(spark, sf_dir)[1].select("parcel", "reason")


# --- certificates of sale: one of each order, its lines are the parcels ------------------------


@query(
    "certificate_parcels",
    """WITH l AS (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) || '-' || l_orderkey AS pin, min(l_linenumber) AS place, min(CASE WHEN l_linenumber = 2 THEN 0 ELSE 1 END) AS marked FROM lineitem GROUP BY 1, 2),
    f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY place, pin) AS k FROM l), m AS (SELECT l_orderkey, max(CASE WHEN place = 2 THEN 1 ELSE 0 END) AS marked_one FROM f GROUP BY 1)
    SELECT o_orderkey AS crv_id, pin AS parcel_id_raw, replace(pin, '-', '') AS parcel_norm, CASE WHEN marked_one = 1 THEN place = 2 ELSE k = 1 END AS primary_parcel, CAST(o_orderdate AS DATE) AS deed_date,
      CAST(o_totalprice AS DECIMAL(18,2)) AS purchase_amount, 'C' || o_custkey || ' Q Public|ACME & CO ' || o_orderkey || ' LLC' AS buyers, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS government
    FROM f JOIN m USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 13 <> 5 AND o_orderkey % 17 <> 4""",
)
def certificate_parcels(spark, sf_dir):
    rows, _ = certificates.certificates(_certificates(spark, sf_dir), ["member"])
    return rows.select("crv_id", "parcel_id_raw", "parcel_norm", "primary_parcel", "deed_date", "purchase_amount", F.array_join("buyers", "|").alias("buyers"), "government")


@query("certificate_rejects", "SELECT 'no xml' AS reason, count(*) AS n FROM orders WHERE o_orderkey % 17 = 4 AND o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'no certificate number', count(*) FROM orders WHERE o_orderkey % 13 = 5 AND o_orderkey % 17 <> 4 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def certificate_rejects(spark, sf_dir):
    return certificates.certificates(_certificates(spark, sf_dir), ["member"])[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _certificates(spark, sf_dir):
    element = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))
    i = F.col("o_orderkey")
    pin = F.concat_ws("-", "l_partkey", "l_orderkey")
    parcel = element("parcels", element("parcelId", pin), F.when(F.col("l_linenumber") == 2, F.lit("<primary>true</primary>")).otherwise(F.lit("")))
    # every parcel stands there twice
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", parcel.alias("p")))), lambda x: F.concat(x.p, x.p)), "").alias("parcels"))
    o = table(spark, sf_dir, "orders").join(listed, i == F.col("l_orderkey"))
    text = F.concat(
        F.lit("<?xml version='1.0' encoding='UTF-8'?>\n<certificate>"),
        element("headerForm", element("crvNumberId", F.when(i % 13 == 5, "none").otherwise(i.cast("string"))), F.lit("<countyCde>55</countyCde>")),
        element("propertyForm", F.col("parcels")),
        element("salesAgreementForm", element("deedContractDate", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00-05:00")), element("totPurchaseAmt", F.col("o_totalprice").cast("decimal(18,2)").cast("string"))),
        element("buyersForm", element("individuals", element("firstName", F.lit("C"), F.col("o_custkey").cast("string")), F.lit("<middleName>Q</middleName><lastName>Public</lastName><daytimePhone>1</daytimePhone>")), element("organizations", element("organizationName", F.lit("ACME &amp; CO "), i.cast("string"), F.lit(" LLC")))),
        F.when(i % 3 == 2, F.lit("<supplementaryForm/>")).otherwise(element("supplementaryForm", element("governmentInd", (i % 3 == 0).cast("string")))),
        F.when(i % 17 == 4, F.lit("</broken>")).otherwise(F.lit("</certificate>")),
    )
    return o.select(F.concat(F.lit("c"), i.cast("string")).alias("member"), text.alias("text"))


# --- web pages ---------------------------------------------------------------------------------


@query(
    "html_tables",
    r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS names, regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1) AS links FROM pages),
    e AS (SELECT page_id, unnest(names) AS name, unnest(links) AS link, unnest(range(1, len(names) + 1)) AS n FROM p)
    SELECT page_id, n, trim(replace(name, '&amp;', '&')) AS name, trim(replace(link, '&amp;', '&')) AS link FROM e""",
)
def html_tables(spark, sf_dir):
    """The menu of every page as a table: its list items become rows, everything else on the page stays around them."""
    html = F.col("html")
    for old, new in ((r"<ul>", "<table><tr><th>Name</th><th>Link to</th></tr>"), (r"</ul>", "</table>"), (r'<li><a href="([^"]*)">([^<]*)</a></li>', "<tr><td>$2</td><td><b>$1</b></td></tr>")):
        html = F.regexp_replace(html, old, new)
    cells = readers.html_tables(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "html", ["page_id"])
    return readers.listing_rows(cells, {"name": "name", "link": "link"}, ["page_id"]).select("page_id", F.col("row_no").cast("long").alias("n"), "name", "link")


# --- parcels of eight counties: every part is a feature, with the field names of its county -------

FEED = ["hennepin", "ramsey", "dakota", "washington", "olmsted", "fillmore", "wabasha", "koochiching", "nowhere"]


@query(
    "county_parcels",
    f"""WITH f AS (SELECT p_partkey AS k, {FEED}[p_partkey % 9 + 1] AS county, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_partkey * 100 END AS v, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_partkey % 700 + 1500 END AS y, p_partkey % 60 AS a FROM part WHERE p_partkey % 9 <> 8 AND p_partkey % 31 <> 0)
    SELECT k, county, CASE county WHEN 'hennepin' THEN '0' || (100000000000 + k) WHEN 'ramsey' THEN CAST(100000000000 + k AS VARCHAR) WHEN 'fillmore' THEN CAST(100000000 + k AS VARCHAR) ELSE CAST(100000000 + k AS VARCHAR) END AS digits,
      CASE WHEN v > 0 THEN CAST(v AS DECIMAL(18,2)) WHEN county = 'koochiching' THEN CAST(7000 AS DECIMAL(18,2)) END AS emv_total, CAST(CASE WHEN county IN ('olmsted', 'fillmore') OR y < 1800 OR y > 2027 THEN NULL ELSE y END AS BIGINT) AS year_built,
      CASE WHEN county IN ('hennepin', 'wabasha', 'koochiching') THEN k || ' Oak' WHEN county = 'olmsted' THEN NULL ELSE k || ' OAK ST' END AS address, CASE WHEN county <> 'olmsted' THEN 'Lake City' END AS city,
      CAST(CASE WHEN county IN ('hennepin', 'ramsey', 'olmsted') OR a = 0 THEN NULL ELSE a * 43560 END AS BIGINT) AS lot_sqft, CASE WHEN county = 'dakota' THEN DATE '2020-01-01' + CAST(k % 100 AS INT) END AS last_sale_date
    FROM f""",
)
def county_parcels(spark, sf_dir):
    k = F.col("p_partkey")
    value, year, acres = F.when(k % 10 == 0, 0).otherwise(k * 100), F.when(k % 4 == 0, 0).otherwise(k % 700 + 1500), k % 60
    sold = (F.unix_timestamp(F.lit("2020-01-01").cast("date")) + k % 100 * 86_400) * 1000
    twelve, nine, street = (100_000_000_000 + k).cast("string"), (100_000_000 + k).cast("string"), F.concat(k, F.lit(" OAK ST"))
    shared = {"county_pin": nine, "anumber": k, "anumbersuf": F.lit(" "), "st_name": F.lit("Oak"), "postcomm": F.lit(None), "ctu_name": F.lit("LAKE CITY"), "year_built": year, "emv_total": value, "emv_land": F.lit(7000), "emv_bldg": F.lit(0), "acres_poly": F.lit("0"), "acres_deed": acres}
    layers = [
        {"PID": twelve, "HOUSE_NO": k, "STREET_NM": F.lit("Oak"), "MUNIC_NM": F.lit("LAKE CITY"), "BUILD_YR": year, "MKT_VAL_TOT": value},
        {"ParcelID": twelve, "SiteAddress": street, "SiteCityName": F.lit("lake city"), "YearBuilt": year, "EMVTotal": value},
        {"PIN": nine, "SITEADDRESS": street, "MUNICIPALITY": F.lit("Lake City"), "YEAR_BUILT": year, "TOTALVAL": value, "LANDVAL": F.lit(0), "TOTAL_ACRES": acres, "SALE_DATE": sold},
        {"PIN": nine, "SITUS_ADDRESS": street, "CITY": F.lit("LAKE CITY"), "YEAR_BUILT": year, "EMV_TOTAL": value, "ACRES_DEED": acres},
        {"PARID": nine, "EMVTotal": value, "SiteCity": F.lit("n/a")},
        {"PIN": nine, "PROPERTYAD": street, "PROPERTYCI": F.lit("LAKE CITY"), "ESTIMATEDT": value, "DEEDEDACRE": acres, "Acres": F.lit("")},
        {**shared, "emv_land": F.lit(None), "acres_poly": acres},
        {**shared, "acres_poly": acres},
        {"PIN": nine},
    ]
    pins = ("PID", "ParcelID", "PIN", "PARID", "county_pin")
    maps = [F.create_map(*[x for n, v in layer.items() for x in (F.lit(n), (F.when(k % 31 != 0, v) if n in pins else v).cast("string"))]) for layer in layers]
    picked = F.lit(None)
    for i, m in enumerate(maps):
        picked = F.when(k % 9 == i, m).otherwise(picked) if i else F.when(k % 9 == 0, m)
    ring = F.lit(None).cast("array<struct<x:double,y:double>>")
    features = table(spark, sf_dir, "part").select(k, F.get(F.array(*map(F.lit, FEED)), (k % 9).cast("int")).alias("county"), picked.alias("attributes"), ring.alias("ring"))
    rows, _ = county_layers.parcels(features, F.lit("2026-06-01").cast("date"))
    digits = F.regexp_replace("parcel_id", "[^0-9]", "")
    return rows.select((F.substring(digits, -8, 8).cast("long")).alias("k"), "county", digits.alias("digits"), "emv_total", F.col("year_built").cast("long").alias("year_built"), "address", "city", "lot_sqft", "last_sale_date")


@query("county_parcel_rejects", f"SELECT CASE WHEN p_partkey % 9 = 8 THEN 'unknown county' ELSE 'no parcel number' END AS reason, {FEED}[p_partkey % 9 + 1] AS county, count(*) AS n FROM part WHERE p_partkey % 9 = 8 OR p_partkey % 31 = 0 GROUP BY ALL")
def county_parcel_rejects(spark, sf_dir):
    k = F.col("p_partkey")
    pin = F.when(k % 31 != 0, k.cast("string"))
    attributes = F.create_map(*[x for n in ("PID", "ParcelID", "PIN", "PARID", "county_pin") for x in (F.lit(n), pin)])
    features = table(spark, sf_dir, "part").select(F.get(F.array(*map(F.lit, FEED)), (k % 9).cast("int")).alias("county"), attributes.alias("attributes"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("ring"))
    return county_layers.parcels(features, F.lit("2026-06-01").cast("date"))[1].groupBy("reason", "county").agg(F.count(F.lit(1)).alias("n"))
