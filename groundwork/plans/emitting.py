"""Typed signals as feed rows; orders, parts, customers, suppliers and lines stand for the landed signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.functions import coerce, ids, notices
from groundwork.operators import derive, emit, merge
from groundwork.registry import query
from groundwork.session import table
from groundwork.sources import display

SHOWN = ("source", "source_id", "county", "parcel_id", "event_type", "event_subtype", "event_date", "event_value", "severity", "title", "description")
SEEN = "2024-03-01 12:00:00"


def _shown(rows):
    return rows.select(*SHOWN).withColumn("event_value", F.col("event_value").cast("double"))


def _seen(rows, **columns):
    return rows.select(*[c.alias(n) for n, c in columns.items()], F.lit(None).cast("string").alias("raw"), F.lit(SEEN).cast("timestamp").alias("observed_at"))


@query(
    "emit_sheriff_sales",
    """WITH s AS (SELECT o_orderkey AS i, CASE WHEN o_orderkey % 3 <> 0 THEN 'Bank ' || (o_orderkey % 9) END AS p, CASE WHEN o_orderkey % 4 > 1 THEN 'Owner ' || (o_orderkey % 8) WHEN o_orderkey % 4 = 1 THEN '' END AS d,
      CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 > 1 THEN o_orderkey || ' Elm St' END AS a, * FROM orders)
    SELECT 'hennepin_sheriff' AS source, 'C' || i AS source_id, 'hennepin' AS county, CAST(o_custkey AS VARCHAR) AS parcel_id, 'sheriff_sale' AS event_type, CAST(NULL AS VARCHAR) AS event_subtype, CAST(o_orderdate AS DATE) AS event_date,
      CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS event_value, 'high' AS severity, 'Sheriff sale: ' || coalesce(nullif(a, ''), 'unknown address') AS title,
      CASE WHEN p <> '' OR d <> '' THEN 'Plaintiff: ' || coalesce(p, 'None') || '; Defendant: ' || coalesce(d, 'None') END AS description FROM s""",
)
def emit_sheriff_sales(spark, sf_dir):
    i = F.col("o_orderkey")
    s = _seen(
        table(spark, sf_dir, "orders"),
        source=F.lit("hennepin_sheriff"),
        county=F.lit("hennepin"),
        case_number=F.concat(F.lit("C"), i),
        parcel_id=F.col("o_custkey").cast("string"),
        sale_date=F.to_date("o_orderdate"),
        sale_amount=F.col("o_totalprice"),
        plaintiff=F.when(i % 3 != 0, F.concat(F.lit("Bank "), i % 9)),
        defendant=F.when(i % 4 > 1, F.concat(F.lit("Owner "), i % 8)).when(i % 4 == 1, ""),
        property_address=F.when(i % 5 == 0, "").when(i % 5 > 1, F.concat(i, F.lit(" Elm St"))),
    )
    return _shown(emit.sale_events(s))


@query(
    "emit_vacant_buildings",
    """WITH b AS (SELECT p_partkey AS i, p_size % 4 = 0 AS con, CASE WHEN p_size % 3 <> 0 THEN p_size % 3 = 1 END AS brd, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 > 1 THEN p_brand END AS reg,
      CASE WHEN p_partkey % 6 <> 0 THEN DATE '2020-01-01' + CAST(p_partkey % 900 AS INT) END AS ent, CASE WHEN p_partkey % 2 = 0 THEN DATE '2023-05-05' END AS cd, p_retailprice FROM part)
    SELECT 'mpls_vbr' AS source, 'R' || i AS source_id, CAST(NULL AS VARCHAR) AS county, CAST(i AS VARCHAR) AS parcel_id, CASE WHEN con THEN 'condemned_building' WHEN brd THEN 'boarded_building' ELSE 'vbr_listing' END AS event_type, reg AS event_subtype,
      CASE WHEN con THEN coalesce(cd, ent) ELSE ent END AS event_date, CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS DOUBLE) AS event_value, CASE WHEN con THEN 'critical' WHEN brd THEN 'high' ELSE 'medium' END AS severity,
      CASE WHEN con THEN 'Condemned building' WHEN brd THEN 'Boarded building' ELSE 'Vacant building registry: ' || coalesce(nullif(reg, ''), 'registered') END AS title, CAST(NULL AS VARCHAR) AS description FROM b""",
)
def emit_vacant_buildings(spark, sf_dir):
    i, size = F.col("p_partkey"), F.col("p_size")
    b = _seen(
        table(spark, sf_dir, "part"),
        source=F.lit("mpls_vbr"),
        county=F.lit(None).cast("string"),
        registration_number=F.concat(F.lit("R"), i),
        parcel_id=i.cast("string"),
        condemned=size % 4 == 0,
        boarded=F.when(size % 3 != 0, size % 3 == 1),
        registry_type=F.when(size % 5 == 0, "").when(size % 5 > 1, F.col("p_brand")),
        date_entered=F.when(i % 6 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (i % 900).cast("int"))),
        condemned_date=F.when(i % 2 == 0, F.lit("2023-05-05").cast("date")),
        annual_fee=F.col("p_retailprice"),
    )
    return _shown(emit.building_events(b))


@query(
    "emit_probate",
    """WITH p AS (SELECT c_custkey AS i, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'P' || c_custkey END AS pid, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS kind, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS dec,
      CASE WHEN c_custkey % 2 = 0 THEN DATE '2023-01-01' + CAST(c_custkey % 300 AS INT) END AS dod FROM customer)
    SELECT 'mcro_probate' AS source, 'E' || i AS source_id, 'olmsted' AS county, pid AS parcel_id, 'probate_filing' AS event_type, kind AS event_subtype, DATE '2024-01-01' AS event_date, CAST(NULL AS DOUBLE) AS event_value, 'medium' AS severity,
      'Probate: estate of ' || coalesce(dec, 'unknown') AS title, coalesce(kind, 'Probate case') || coalesce(', died ' || strftime(dod, '%Y-%m-%d'), '') AS description FROM p WHERE pid <> ''""",
)
def emit_probate(spark, sf_dir):
    i = F.col("c_custkey")
    p = _seen(
        table(spark, sf_dir, "customer"),
        source=F.lit("mcro_probate"),
        county=F.lit("olmsted"),
        case_number=F.concat(F.lit("E"), i),
        parcel_id=F.when(i % 3 == 0, "").when(i % 3 == 1, F.concat(F.lit("P"), i)),
        case_type=F.when(i % 4 != 0, F.col("c_mktsegment")),
        decedent_name=F.when(i % 5 != 0, F.col("c_name")),
        date_of_death=F.when(i % 2 == 0, F.date_add(F.lit("2023-01-01").cast("date"), (i % 300).cast("int"))),
        filing_date=F.lit("2024-01-01").cast("date"),
    )
    return _shown(emit.probate_events(p))


@query(
    "emit_tax_forfeit",
    """SELECT 'mn_dor_red_book' AS source, CAST(NULL AS VARCHAR) AS source_id, 'anoka' AS county, CAST(s_suppkey AS VARCHAR) AS parcel_id, 'tax_forfeit' AS event_type, CAST(NULL AS VARCHAR) AS event_subtype,
      CASE WHEN s_suppkey % 3 = 0 THEN DATE '2024-03-01' ELSE DATE '2021-01-01' + CAST(s_suppkey % 800 AS INT) END AS event_date, CAST(CAST(abs(s_acctbal) AS DECIMAL(18, 2)) AS DOUBLE) AS event_value, CASE WHEN s_suppkey % 2 = 0 THEN 'critical' ELSE 'high' END AS severity,
      'Tax-forfeit property — Anoka' || CASE WHEN s_suppkey % 2 = 0 THEN ' (pre-2024 forfeiture — forced liquidation window)' ELSE '' END AS title, CAST(NULL AS VARCHAR) AS description FROM supplier""",
)
def emit_tax_forfeit(spark, sf_dir):
    i = F.col("s_suppkey")
    day = F.when(i % 3 != 0, F.date_add(F.lit("2021-01-01").cast("date"), (i % 800).cast("int")))
    f = _seen(table(spark, sf_dir, "supplier"), source=F.lit("mn_dor_red_book"), county=F.lit("anoka"), county_name=F.lit("Anoka"), parcel_id=i.cast("string"), forfeit_date=day, pre_2024=F.when(i % 2 == 0, True), minimum_bid=F.abs("s_acctbal"))
    return _shown(emit.forfeit_events(f, dated_by_sight=True))


@query(
    "emit_violations",
    """WITH v AS (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'mpls_311' WHEN 1 THEN 'saint_paul_dsi' ELSE 'other' END AS source, CASE WHEN l_linenumber % 4 = 0 THEN '' WHEN l_linenumber % 4 > 1 THEN l_returnflag END AS kind FROM lineitem)
    SELECT source, l_orderkey || '-' || l_linenumber AS source_id, CASE WHEN l_suppkey % 5 = 0 THEN 'stored' WHEN source = 'mpls_311' THEN 'hennepin' WHEN source = 'saint_paul_dsi' THEN 'ramsey' WHEN l_suppkey % 2 = 0 THEN 'scott' END AS county,
      CAST(l_partkey AS VARCHAR) AS parcel_id, 'code_violation' AS event_type, kind AS event_subtype, CAST(l_shipdate AS DATE) AS event_date, CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS DOUBLE) AS event_value,
      CASE WHEN l_linestatus = 'F' THEN 'low' ELSE 'medium' END AS severity, 'Code violation: ' || coalesce(nullif(kind, ''), 'unspecified') AS title, l_linestatus AS description FROM v""",
)
def emit_violations(spark, sf_dir):
    n = F.col("l_linenumber")
    v = _seen(
        table(spark, sf_dir, "lineitem"),
        source=F.when(n % 3 == 0, "mpls_311").when(n % 3 == 1, "saint_paul_dsi").otherwise("other"),
        source_id=F.concat_ws("-", "l_orderkey", n),
        county=F.when(F.col("l_suppkey") % 5 == 0, "stored"),
        slug=F.when(F.col("l_suppkey") % 2 == 0, "scott"),
        parcel_id=F.col("l_partkey").cast("string"),
        violation_type=F.when(n % 4 == 0, "").when(n % 4 > 1, F.col("l_returnflag")),
        violation_date=F.to_date("l_shipdate"),
        violation_description=F.col("l_linestatus"),
        fine=F.col("l_extendedprice"),
        severity=F.when(F.col("l_linestatus") == "F", "low"),
    )
    known = {"mpls_311": "hennepin", "saint_paul_dsi": "ramsey"}
    return _shown(emit.violation_events(emit.fill_county(v, known, F.col("slug"))))


@query(
    "lifecycle_scalars",
    """WITH s AS (SELECT o_orderkey AS i, o_custkey AS c, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT i, CASE WHEN i % 3 <> 0 THEN (i % 900) * 1000 END AS price, CASE WHEN i % 3 <> 0 THEN d END AS sold, d AS written, CASE WHEN i % 7 <> 0 THEN (i % 7 * 100) / (i % 7 * 1000.0) END AS dropped,
      CAST(greatest(1, round_even(date_diff('day', d, d + CAST(i % 700 AS INT)) / 30.44, 0)) AS BIGINT) AS months,
      CASE WHEN i % 4 = 0 THEN '0' || (1000000 + c) WHEN i % 4 = 1 THEN 'ANOKA-FC-' || i WHEN i % 4 = 2 THEN 'ANOKA-FC-' || i ELSE 'P' || i END AS pid, CASE WHEN length(CAST(i AS VARCHAR)) >= 3 THEN '777' || i END AS bare,
      i % 3 <> 0 AND i % 100 > 0 AND (i % 100) - (i % 8) >= 0.95 * (i % 100) AS complete, CASE WHEN i % 5 = 0 THEN 'medium' WHEN d >= DATE '1995-01-01' THEN 'high' ELSE 'low' END AS severity,
      CASE WHEN i % 2 = 0 THEN 'own' WHEN i % 3 = 0 THEN 'tax' ELSE 'stub' END AS chosen FROM s""",
)
def lifecycle_scalars(spark, sf_dir):
    i, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    day = F.date_format(d, "yyyy-MM-dd")
    sold = notices.resale(F.when(i % 3 != 0, F.concat(F.lit("resold for $"), F.format_number((i % 900) * 1000, 0), F.lit(" on "), day)))
    stub = F.when(i % 4 == 3, F.concat(F.lit("P"), i)).otherwise(F.concat(F.lit("ANOKA-FC-"), i))
    return table(spark, sf_dir, "orders").select(
        i.alias("i"),
        sold["price"].alias("price"),
        sold["date"].alias("sold"),
        coerce.day_as_written(F.concat(day, F.lit("T23:30:00-06:00"))).alias("written"),
        coerce.dropped_share(F.concat(i % 7 * 100, F.lit(" of "), F.format_number(i % 7 * 1000, 0), F.lit(" rows dropped"))).alias("dropped"),
        derive.months_between_days(d, F.date_add(d, (i % 700).cast("int"))).cast("long").alias("months"),
        ids.effective_pid(stub, F.when(i % 2 == 0, F.concat(F.lit("0-"), 1_000_000 + F.col("o_custkey"))), i % 4 == 0).alias("pid"),
        ids.pid_digits(F.concat(F.lit("77-7."), i)).alias("bare"),
        merge.snapshot_complete(i % 100, i % 100 - i % 8, i % 3 == 0).alias("complete"),
        emit.sheriff_severity(F.when(i % 5 != 0, d), F.lit("1995-01-01").cast("date")).alias("severity"),
        emit.parcel_precedence(F.when(i % 2 == 0, " own "), F.when(i % 3 == 0, "tax").otherwise(""), F.lit("stub")).alias("chosen"),
    )


#: JSON with the keys of every source, each with a value of its own, and the row's own columns.
RAW = {
    "address": "'a' || i", "property_address": "'p' || i", "owner_name": "'o' || i", "matched_owner_name": "'m' || i", "market_value": "CASE WHEN i % 3 <> 0 THEN CAST(i % 50 AS STRING) END", "amount_due": "CASE WHEN i % 4 = 0 THEN 'none' ELSE CAST(i % 60 AS STRING) END", "finalBidAmount": "i % 5", "appraised_value": "i % 70", "total_tax_penalties": "i % 80",
    "condemned_date": "CASE WHEN i % 2 = 0 THEN 'c' || i END", "list_date": "'l' || i", "published": "'u' || i", "published_date": "CASE WHEN i % 2 = 0 THEN '' ELSE 'd' || i END", "postponed": "i % 2 = 0", "sale_status": "CASE WHEN i % 2 = 0 THEN 'otc_available' END", "decedent": "CASE WHEN i % 2 = 0 THEN 'D' || i END",
    "list": "named_struct('address', CASE WHEN i % 2 = 0 THEN 'x' || i END)", "sale": "named_struct('owner', 's' || i, 'pid', 't' || i)", "mortgagors": "array(named_struct('display', ' J' || i), named_struct('display', ' '), named_struct('display', 'K'))",
    "detail": "named_struct('detail_address', 'e' || i, 'gis_owner', CASE WHEN i % 2 = 0 THEN 'g' || i END, 'owner_name', 'n' || i, 'gis_site_address', 'w' || i, 'gis_pid', CASE WHEN i % 3 = 0 THEN 'q' || i END, 'tax_parcel_no', 'r' || i, 'status', CASE WHEN i % 4 = 0 THEN 'Open' END)",
    "attributes": "named_struct('Address', 'v' || i, 'ADDRESS', 'V' || i, 'Display', 'y' || i, 'GeoAddress', 'z' || i, 'Mortgagor', ' h' || i || ' ', 'SaleAmount', i % 6, 'APN', CASE WHEN i % 3 = 0 THEN 'b' || i END, 'APN_Txt', 'f' || i, 'PIN', 'j' || i, 'Property_s', 'k' || i, 'Inspection_Result', 'I' || i, 'VACANT_AS_OF', CASE i % 3 WHEN 0 THEN '3/7/2021' WHEN 1 THEN 'a/b/c' ELSE 'long ago' END, 'VB_CATEGORY', ' ' || (i % 5))",
}
NAMED = (*display.DISPLAY, "unknown")


@query(
    "display_columns",
    f"""WITH r AS (SELECT o_orderkey AS i, [{", ".join(f"'{s}'" for s in NAMED)}][o_orderkey % {len(NAMED)} + 1] AS source, o_custkey % 9 AS ev, CAST(o_orderdate AS DATE)::VARCHAR AS d, 'P' || o_custkey AS pid, o_custkey % 3 AS t FROM orders)
    SELECT i, source,
      CASE WHEN source = 'anoka_sheriff' THEN CASE WHEN i % 2 = 0 THEN 'x' || i ELSE 'e' || i END WHEN source IN ('hennepin_sheriff', 'startribune_legal', 'mnpublicnotice', 'mpls_311', 'unknown') THEN 'a' || i WHEN source = 'dakota_sheriff' THEN 'z' || i WHEN source = 'washington_sheriff' THEN 'w' || i
        WHEN source = 'mpls_vbr' THEN 'v' || i WHEN source LIKE 'saint_paul%' THEN 'V' || i WHEN source <> 'olmsted_delq_list' THEN 'p' || i END AS address,
      CASE WHEN source IN ('anoka_sheriff', 'hennepin_sheriff', 'dakota_sheriff', 'washington_sheriff') AND i % 2 = 0 THEN 'g' || i WHEN source = 'anoka_sheriff' THEN 'n' || i WHEN source IN ('hennepin_sheriff', 'startribune_legal') THEN 'J' || i || '; K' WHEN source = 'dakota_sheriff' THEN 'h' || i
        WHEN source = 'washington_sheriff' THEN 's' || i WHEN source = 'mnpublicnotice' THEN 'J' || i || ' & K' WHEN source LIKE '%tax_roll' OR source = 'unknown' THEN 'o' || i WHEN source LIKE '%probate' THEN 'm' || i END AS owner,
      CAST(CASE WHEN source IN ('anoka_sheriff', 'washington_sheriff', 'mpls_vbr', 'saint_paul_vacant', 'saint_paul_dsi', 'unknown') THEN ev WHEN source = 'hennepin_sheriff' THEN CASE WHEN i % 5 <> 0 THEN i % 5 ELSE ev END WHEN source = 'dakota_sheriff' THEN CASE WHEN i % 6 <> 0 THEN i % 6 ELSE ev END
        WHEN source IN ('startribune_legal', 'mnpublicnotice') THEN CASE WHEN i % 4 = 0 THEN NULL WHEN i % 60 = 0 THEN ev ELSE i % 60 END WHEN source LIKE '%tax_roll' THEN CASE WHEN i % 3 <> 0 THEN i % 50 ELSE ev END WHEN source = 'ramsey_tfl' THEN i % 70
        WHEN source IN ('postbulletin_legal', 'fillmore_legal') THEN CASE WHEN i % 4 <> 0 THEN i % 60 END WHEN source = 'olmsted_delq_list' THEN i % 80 END AS DOUBLE) AS amount,
      CASE WHEN source = 'anoka_sheriff' THEN CASE WHEN i % 4 = 0 THEN 'Open' ELSE 'Active' END WHEN source IN ('hennepin_sheriff', 'dakota_sheriff', 'washington_sheriff') THEN 'Sold' WHEN source = 'startribune_legal' THEN 'Scheduled sale' WHEN source = 'mpls_vbr' THEN 'k' || i WHEN source = 'mpls_311' THEN 'I' || i
        WHEN source LIKE 'saint_paul%' THEN CASE i % 5 WHEN 1 THEN 'Category 1 (sound)' WHEN 2 THEN 'Category 2 (boarded)' WHEN 3 THEN 'Category 3 (nuisance)' ELSE 'title' END WHEN source LIKE '%tax_roll' THEN CASE t WHEN 0 THEN 'Tax-forfeited' WHEN 1 THEN 'Special assessment' ELSE 'Tax-delinquent' END
        WHEN source = 'ramsey_tfl' THEN CASE WHEN i % 2 = 0 THEN 'Available over the counter' ELSE 'On auction list' END WHEN source IN ('postbulletin_legal', 'fillmore_legal') THEN CASE WHEN i % 2 = 0 THEN 'Scheduled sale (postponed)' ELSE 'Scheduled sale' END
        WHEN source = 'olmsted_delq_list' THEN 'On the delinquent tax list' WHEN source LIKE '%probate' THEN CASE WHEN i % 2 = 0 THEN 'Estate of D' || i || ' in probate' ELSE 'Owner of record is a decedent in probate' END END AS status,
      CASE WHEN source = 'anoka_sheriff' THEN 'r' || i WHEN source = 'hennepin_sheriff' THEN NULL WHEN source IN ('dakota_sheriff', 'startribune_legal') THEN CASE WHEN i % 3 = 0 THEN 'q' || i END WHEN source = 'washington_sheriff' THEN CASE WHEN i % 3 = 0 THEN 'q' || i ELSE 't' || i END WHEN source = 'mnpublicnotice' AND i % 3 = 0 THEN 'q' || i
        WHEN source = 'mpls_vbr' THEN 'f' || i WHEN source = 'mpls_311' AND i % 3 = 0 THEN 'b' || i WHEN source LIKE 'saint_paul%' THEN 'j' || i ELSE pid END AS tax_parcel_no,
      CASE WHEN source IN ('mnpublicnotice', 'mpls_311', 'unknown') THEN d WHEN source = 'mpls_vbr' THEN CASE WHEN i % 2 = 0 THEN 'c' || i ELSE d END WHEN source LIKE 'saint_paul%' THEN CASE i % 3 WHEN 0 THEN '2021-03-07' WHEN 1 THEN 'a/b/c' ELSE d END
        WHEN source = 'ramsey_tfl' THEN 'l' || i WHEN source = 'olmsted_delq_list' THEN 'u' || i WHEN source LIKE '%probate' THEN CASE WHEN i % 2 = 0 THEN d ELSE 'd' || i END END AS registered_date FROM r""",
)
def display_columns(spark, sf_dir):
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        i.alias("i"),
        F.get(F.array(*map(F.lit, NAMED)), (i % len(NAMED)).cast("int")).alias("source"),
        F.get(F.array(*map(F.lit, ("tax_forfeit", "tax_assessment", "tax_delinquent"))), (c % 3).cast("int")).alias("event_type"),
        F.to_date("o_orderdate").alias("event_date"),
        (c % 9).cast("decimal(18,2)").alias("event_value"),
        F.concat(F.lit("P"), c).alias("parcel_id"),
        F.lit("title").alias("title"),
    )
    rows = rows.withColumn("raw", F.to_json(F.expr("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in RAW.items()) + ")")))
    shown = ("address", "owner", "amount", "status", "tax_parcel_no", "registered_date")
    return display.display(rows, shown).select("i", "source", *shown)
