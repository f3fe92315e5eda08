"""Notices inside documents: their facts, and documents of many notices in pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.functions import notice_fields
from groundwork.operators import documents
from groundwork.registry import query
from groundwork.session import table

# --- facts: every document holds a notice between its own lines ---------------------------------

NOTICE = [
    "MORTGAGOR(S): Ann B. Lee {i} and\nJohn Roe\nMORTGAGEE: First Bank, N.A.\nPROPERTY ADDRESS: {i} Oak Street,\nWinona, MN 55987\nTAX PARCEL NO.: R32.{d}.0120\nTHE AMOUNT CLAIMED TO BE DUE ON THE MORTGAGE: $1,{d}.50 plus interest.\nDATE AND TIME OF SALE: July 2{m},\n2026, 10:0{m} AM\nThe time allowed by law for redemption is twelve (12) months from the sale. file no. 26-{d}\n",
    "Sheriff of Otter Tail County will sell at public auction to the highest bidder, at the county\noffice, on Thursday, June 1{m}, 2025 at 9:1{m} a.m. the land located at {i} Kirkwood Street East, Lanesboro and legally described as lot 1. Property Tax ID No. 19{d}0 ORIGINAL PRINCIPAL AMOUNT OF MORTGAGE: $20{m},000\nThe redemption period is five (5) weeks. All is said.\n",
    "This sale has been postponed until Monday, August 3,\n2026. AMOUNT DUE is not stated. PID # 45-1{m}\nThe party must vacate the property on or before 11:59 p.m. on Friday, December 1{m}, 2026.\n",
]


def filled(template, i, pad, last):
    parts, rest = [], template
    while rest:
        at = min((p for p in (rest.find(x) for x in ("{i}", "{d}", "{m}")) if p >= 0), default=len(rest))
        parts.append(F.lit(rest[:at]))
        if at < len(rest):
            parts.append({"i": i.cast("string"), "d": pad, "m": last}[rest[at + 1]])
            at += 3
        rest = rest[at:]
    return F.concat(*parts)


D, M = "lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0')", "(doc_id % 10)"


@query(
    "notice_facts",
    f"""WITH n AS (SELECT doc_id, doc_id % 3 AS v, {D} AS d, CAST({M} AS VARCHAR) AS m FROM documents),
    f AS (
      SELECT doc_id, 'mortgagor' AS field, 'Ann B. Lee ' || doc_id || ' and John Roe' AS fact, CAST(NULL AS DATE) AS day, CAST(NULL AS DECIMAL(18,2)) AS amount, CAST(NULL AS BIGINT) AS months FROM n WHERE v = 0
      UNION ALL SELECT doc_id, 'property_address', doc_id || ' Oak Street, Winona, MN 55987', NULL, NULL, NULL FROM n WHERE v = 0
      UNION ALL SELECT doc_id, 'parcel_id', 'R32.' || d || '.0120', NULL, NULL, NULL FROM n WHERE v = 0
      UNION ALL SELECT doc_id, 'amount_due', '1,' || d || '.50', NULL, CAST('1' || d || '.50' AS DECIMAL(18,2)), NULL FROM n WHERE v = 0
      UNION ALL SELECT doc_id, 'sale_day', 'July 2' || m || ', 2026', make_date(2026, 7, 20 + CAST(m AS INT)), NULL, NULL FROM n WHERE v = 0
      UNION ALL SELECT doc_id, 'sale_time', '10:0' || m || ' AM', NULL, NULL, NULL FROM n WHERE v = 0
      UNION ALL SELECT doc_id, 'redemption', 'twelve (12) months', NULL, NULL, 12 FROM n WHERE v = 0
      UNION ALL SELECT doc_id, 'attorney_file', '26-' || d, NULL, NULL, NULL FROM n WHERE v = 0
      UNION ALL SELECT doc_id, 'county', 'Otter Tail', NULL, NULL, NULL FROM n WHERE v = 1
      UNION ALL SELECT doc_id, 'sale_day', 'June 1' || m || ', 2025', make_date(2025, 6, 10 + CAST(m AS INT)), NULL, NULL FROM n WHERE v = 1
      UNION ALL SELECT doc_id, 'sale_time', '9:1' || m || ' a.m.', NULL, NULL, NULL FROM n WHERE v = 1
      UNION ALL SELECT doc_id, 'property_address', doc_id || ' Kirkwood Street East, Lanesboro', NULL, NULL, NULL FROM n WHERE v = 1
      UNION ALL SELECT doc_id, 'parcel_id', '19' || d || '0', NULL, NULL, NULL FROM n WHERE v = 1 AND length('19' || d || '0') >= 7
      UNION ALL SELECT doc_id, 'original_principal', '20' || m || ',000', NULL, CAST('20' || m || '000' AS DECIMAL(18,2)), NULL FROM n WHERE v = 1
      UNION ALL SELECT doc_id, 'postponed_to', 'August 3, 2026', DATE '2026-08-03', NULL, NULL FROM n WHERE v = 2
      UNION ALL SELECT doc_id, 'vacate_by', 'December 1' || m || ', 2026', make_date(2026, 12, 10 + CAST(m AS INT)), NULL, NULL FROM n WHERE v = 2)
    SELECT * FROM f""",
)
def notice_facts(spark, sf_dir):
    i = F.col("doc_id")
    pad, last = F.lpad((i % 1000).cast("string"), 3, "0"), (i % 10).cast("string")
    notice = [filled(t, i, pad, last) for t in NOTICE]
    own = F.coalesce("text", F.lit(""))
    text = F.concat(own, F.lit(".\n"), F.when(i % 3 == 0, notice[0]).when(i % 3 == 1, notice[1]).otherwise(notice[2]), F.lit("\n"), own)
    out = notice_fields.facts(table(spark, sf_dir, "documents").select("doc_id", text.alias("notice")), "notice", ["doc_id"])
    return out.select("doc_id", "field", F.regexp_replace("fact", r"\s+", " ").alias("fact"), "day", "amount", F.col("months").cast("long").alias("months"))


# --- pieces: one document of each customer, one record of each order, six parcels a piece --------


@query(
    "document_pieces",
    """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders),
    p AS (SELECT o_custkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 6 THEN k // 6 ELSE 0 END AS piece, o_orderkey FROM o)
    SELECT o_custkey AS customer, piece, count(*) AS parcels, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order, count(*) AS owners, (SELECT count(*) FROM orders x WHERE x.o_custkey = p.o_custkey) > 6 AS has_closing FROM p GROUP BY 1, 2""",
)
def document_pieces(spark, sf_dir):
    i = F.col("o_orderkey")
    # an owner over the parcel, every third with a second line; a year and an amount are no parcels
    record = F.concat(F.lit("\nOWNER "), i.cast("string"), F.lit(" & SON\n"), F.when(i % 3 == 0, F.lit("REV TRST 10-31-05\n")).otherwise(""), F.lit("RP 41."), F.lpad(i.cast("string"), 9, "0"), F.lit(" in 2019, $2,988.11\n"))
    listed = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", record.alias("r")))), lambda x: x.r), "").alias("records"))
    text = F.concat(F.lit("County of A\nNotice of expiration of\nredemption. Bid in 2019.\n"), "records", F.lit("\nFAILURE TO REDEEM by May 1 ends all rights.\n"))
    rows = documents.split_documents(listed.select("o_custkey", text.alias("text")), "text", ["o_custkey"], documents.Cut(least=20, most=100_000, parcels=6))
    orders = F.transform(F.regexp_extract_all("body", F.lit(r"RP 41\.([0-9]{9})"), F.lit(1)), lambda x: x.cast("long"))
    owners = F.size(F.regexp_extract_all("body", F.lit("OWNER"), F.lit(0)))
    return rows.select(F.col("o_custkey").alias("customer"), F.col("piece").cast("long").alias("piece"), F.col("parcels").cast("long").alias("parcels"), F.array_min(orders).alias("first_order"), F.array_max(orders).alias("last_order"), owners.cast("long").alias("owners"), F.col("context").contains("\n...\nFAILURE TO REDEEM").alias("has_closing"))
