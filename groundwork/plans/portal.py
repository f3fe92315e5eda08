"""Parcel rows, listings and look-ups over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.operators import parcels, portal
from groundwork.registry import query
from groundwork.session import table


@query(
    "assessor_rows",
    """WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN o_orderkey % 1000 END AS total, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 500 END AS land, CASE WHEN o_orderkey % 5 = 0 THEN 7 END AS building,
      CASE o_orderkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 50000.0 ELSE -1.0 END AS acres, o_orderkey % 400 + 1700 AS y, 43 + o_orderkey % 9 AS lat FROM orders)
    SELECT id, CAST(coalesce(CASE WHEN total > 0 THEN total END, CASE WHEN (land IS NOT NULL OR building IS NOT NULL) AND coalesce(land, 0) + coalesce(building, 0) > 0 THEN coalesce(land, 0) + coalesce(building, 0) END) AS BIGINT) AS emv_total,
      CAST(CASE WHEN acres > 0 AND acres <= 49000 THEN 21780 END AS BIGINT) AS lot_sqft, CAST(CASE WHEN y >= 1800 AND y <= 2025 THEN y END AS BIGINT) AS year_built, CAST(CASE WHEN lat <= 49 THEN lat END AS DOUBLE) AS lat FROM s""",
)
def assessor_rows(spark, sf_dir):
    i = F.col("o_orderkey")
    total = F.when(i % 3 == 0, F.lit(0).cast("long")).when(i % 3 == 1, i % 1000)
    acres = F.when(i % 3 == 0, 0.5).when(i % 3 == 1, 50000.0).otherwise(-1.0)
    row = parcels.assessor_row(F.when(i % 4 != 0, i % 500), F.when(i % 5 == 0, F.lit(7)), total, acres, i % 400 + 1700, (43 + i % 9).cast("double"), F.lit(-93.0), F.lit("2024-06-01").cast("date"))
    return table(spark, sf_dir, "orders").select(i.alias("id"), row.alias("r")).select("id", "r.emv_total", "r.lot_sqft", "r.year_built", "r.lat")


@query(
    "enrichment_fill",
    """SELECT o_orderkey, o_custkey, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END, c_mktsegment) AS seg, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS st FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def enrichment_fill(spark, sf_dir):
    i = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(i, "o_custkey", F.when(i % 3 != 0, F.col("o_orderpriority")).alias("seg"), F.when(i % 4 != 0, F.col("o_orderstatus")).alias("st"))
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("seg"))
    return parcels.fill_only(rows, found, ["o_custkey"], ["seg"])


@query(
    "raw_cleanup",
    """SELECT c_custkey, '{' || array_to_string(list_filter([CASE WHEN c_custkey % 3 <> 0 THEN '"seg":"' || c_mktsegment || '"' END, '"key":"' || c_custkey || '"', CASE WHEN c_custkey % 4 = 1 THEN '"flag":"N/A"' END], lambda x: x IS NOT NULL), ',') || '}' AS raw FROM customer""",
)
def raw_cleanup(spark, sf_dir):
    i = F.col("c_custkey")
    flag = F.when(i % 4 == 1, "N/A").when(i % 4 == 2, "  ")
    return table(spark, sf_dir, "customer").select(i, parcels.cleaned_raw({"seg": F.when(i % 3 != 0, F.col("c_mktsegment")), "key": i, "flag": flag}).alias("raw"))


@query(
    "imagery_states",
    """WITH s AS (SELECT o_orderkey AS id, o_orderkey % 5 <> 0 AS located, CASE o_orderkey % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'zero' WHEN 2 THEN NULL ELSE 'found' END AS answer, CAST(o_orderkey % 250 AS DOUBLE) AS m, o_orderkey % 3 = 0 AS built, 50000 + o_orderkey % 2 * 50000 AS lot, o_orderkey % 13 = 0 AS blocked FROM orders)
    SELECT id, CASE WHEN NOT located THEN 'no_location' WHEN blocked THEN 'policy_blocked' WHEN answer = 'error' THEN 'error' WHEN answer IS NULL OR answer = 'zero' THEN 'none' WHEN m > CASE WHEN NOT built AND lot >= 87120 THEN 200 ELSE 60 END THEN 'too_far' ELSE 'ok' END AS status FROM s""",
)
def imagery_states(spark, sf_dir):
    i = F.col("o_orderkey")
    near = parcels.near_camera((i % 250).cast("double"), 50000 + i % 2 * 50000, i % 3 == 0)
    answer = F.when(i % 7 == 0, "error").when(i % 7 == 1, "zero").when(i % 7 != 2, "found")
    return table(spark, sf_dir, "orders").select(i.alias("id"), parcels.imagery_status(i % 5 != 0, answer, near, i % 13 == 0).alias("status"))


@query(
    "imagery_worklist",
    "SELECT c_custkey FROM customer WHERE NOT (c_custkey % 2 = 0 AND c_custkey % 6 <> 0)",
)
def imagery_worklist(spark, sf_dir):
    i = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(i)
    done = c.filter(i % 2 == 0).withColumn("policy", F.when(i % 12 == 0, "old").when(i % 6 != 0, "now"))
    return parcels.to_resolve(c, done, ["c_custkey"], "now")


@query(
    "honest_dates",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN DATE '2000-01-01' ELSE CAST(l_shipdate AS DATE) END AS d FROM lineitem),
    u AS (SELECT DISTINCT l_orderkey FROM s WHERE d IS NULL)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN d = DATE '2000-01-01' THEN NULL WHEN d > DATE '1999-01-01' THEN CAST(d - INTERVAL 1200 MONTH AS DATE) ELSE d END AS d FROM s
    WHERE NOT (d IS NOT DISTINCT FROM DATE '2000-01-01' AND l_orderkey IN (SELECT l_orderkey FROM u))""",
)
def honest_dates(spark, sf_dir):
    n = F.col("l_linenumber")
    first = F.lit("2000-01-01").cast("date")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", n, "l_partkey", F.when(n % 3 == 1, first).when(n % 3 == 2, F.to_date("l_shipdate")).alias("d"))
    return parcels.without_placeholders(rows, ["l_orderkey"], "d", F.col("d") == first, F.lit("1999-01-01").cast("date"))


@query("notice_pieces", "SELECT doc_id, length(text) AS chars, sha256(text) AS digest FROM documents WHERE text <> ''")
def notice_pieces(spark, sf_dir):
    pieces = parcels.notice_pieces(table(spark, sf_dir, "documents"), "text", ["doc_id"], r"\n[A-Z]", least=50, most=300)
    whole = pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "piece"))), lambda p: p["piece"]), "").alias("t"))
    return whole.select("doc_id", F.char_length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"))


@query(
    "listing_upsert",
    """WITH s AS (SELECT o_orderkey AS listing_id, o_orderkey AS parcel, o_custkey AS user_id, CASE WHEN o_orderkey % 4 = 0 THEN 'withdrawn' ELSE 'active' END AS status, o_totalprice AS price, o_orderpriority AS note FROM orders WHERE o_orderkey % 3 <> 0),
    n AS (SELECT o_orderkey AS parcel, o_custkey AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 END AS price FROM orders WHERE o_orderkey % 5 <> 0),
    a AS (SELECT * FROM s WHERE status = 'active')
    SELECT a.listing_id, coalesce(n.parcel, a.parcel) AS parcel, coalesce(n.user_id, a.user_id) AS user_id, 'active' AS status, coalesce(n.price, a.price) AS price, a.note FROM a FULL JOIN n ON a.parcel = n.parcel AND a.user_id = n.user_id
    UNION ALL SELECT * FROM s WHERE status <> 'active'""",
)
def listing_upsert(spark, sf_dir):
    i = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    stored = o.filter(i % 3 != 0).select(i.alias("listing_id"), i.alias("parcel"), F.col("o_custkey").alias("user_id"), F.when(i % 4 == 0, "withdrawn").otherwise("active").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("note"))
    incoming = o.filter(i % 5 != 0).select(i.alias("parcel"), F.col("o_custkey").alias("user_id"), F.when(i % 2 == 0, F.col("o_totalprice") + 1).alias("price"))
    return portal.upsert_listings(stored, incoming, ["parcel", "user_id"])


@query(
    "owner_dashboard",
    """SELECT o_orderkey AS listing_id, o_custkey AS user_id, c_nationkey, c_mktsegment, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_offers, CAST(o_orderdate AS DATE) AS created_at FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey % 2 = o_custkey % 2 WHERE o_custkey = 7""",
)
def owner_dashboard(spark, sf_dir):
    listings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("listing_id"), F.col("o_custkey").alias("user_id"), F.col("o_custkey").alias("parcel"), (F.col("o_custkey") % 2).alias("half"), F.to_date("o_orderdate").alias("created_at"))
    spine = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("parcel"), (F.col("c_nationkey") % 2).alias("half"), "c_nationkey", "c_mktsegment")
    offers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("listing_id"))
    return portal.dashboard(listings, spine, offers, F.lit(7), ["parcel", "half"]).drop("parcel", "half")


@query(
    "offer_answers",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN 'withdrawn' WHEN l_orderkey % 5 = 0 AND l_partkey % 3 = 0 THEN 'accepted' ELSE 'submitted' END AS status FROM lineitem""",
)
def offer_answers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("offer_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    n = F.col("l_linenumber")
    offers = li.select("offer_id", F.col("l_orderkey").alias("listing_id"), F.when(n % 2 == 0, "withdrawn").otherwise("submitted").alias("status"), "l_orderkey", n, "l_partkey", "l_suppkey")
    listings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("listing_id"), (F.col("o_orderkey") % 5).alias("user_id"))
    answers = li.dropDuplicates(["offer_id"]).select("offer_id", (F.col("l_partkey") % 3).alias("user_id"), F.lit("accepted").alias("answer")).filter("user_id = 0")
    return portal.answer_offers(offers, listings, answers).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "status")


@query(
    "offer_guards",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 100 < 72 THEN 'expires_too_soon' WHEN o_orderkey % 3 = 0 THEN 'not_active' WHEN o_orderkey % 5 = 0 THEN 'buyer_type' END AS problem FROM orders""",
)
def offer_guards(spark, sf_dir):
    i = F.col("o_orderkey")
    now = F.lit("2024-06-01").cast("timestamp")
    types = F.when(i % 5 == 0, F.array(F.lit("agent"))).when(i % 5 == 1, F.array(F.lit("agent"), F.lit("investor"))).when(i % 5 == 2, F.array().cast("array<string>"))
    problem = portal.offer_problem(F.timestamp_add("HOUR", (i % 100).cast("int"), now), now, F.when(i % 3 != 0, "active"), types, F.lit("investor"))
    return table(spark, sf_dir, "orders").select(i, problem.alias("problem"))


@query(
    "owner_lookup",
    """WITH s AS (SELECT s_suppkey, (100 + s_suppkey % 30) || ' OAK ' || CASE s_suppkey % 4 WHEN 0 THEN 'ST' WHEN 1 THEN 'ST N' WHEN 2 THEN 'AVE' ELSE 'STATION RD' END AS a, s_suppkey % 7 = 0 AS stub FROM supplier),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY stub, s_suppkey) = 1), q AS (SELECT n_nationkey, (100 + n_nationkey) || ' OAK ST' AS t FROM nation)
    SELECT n_nationkey, s_suppkey, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY a) AS BIGINT) AS place, substr(a, 1, 1) || 'XX' || substr(a, 4) AS shown FROM q JOIN b ON (starts_with(a, t) OR starts_with(t, a)) AND split_part(a, ' ', 1) = split_part(t, ' ', 1)""",
)
def owner_lookup(spark, sf_dir):
    i = F.col("s_suppkey")
    street = F.when(i % 4 == 0, "Street").when(i % 4 == 1, "St. North").when(i % 4 == 2, "Avenue").otherwise("Station Road")
    spine = table(spark, sf_dir, "supplier").select(i, F.concat((100 + i % 30).cast("string"), F.lit(" Oak "), street).alias("address"))
    asked = table(spark, sf_dir, "nation").select("n_nationkey", F.concat((100 + F.col("n_nationkey")).cast("string"), F.lit(" oak st")).alias("typed"))
    out = portal.lookup(asked, "typed", spine, "address", i % 7 == 0)
    return out.select("n_nationkey", "s_suppkey", F.col("place").cast("long").alias("place"), "shown")


@query(
    "open_windows",
    """SELECT CAST(c_nationkey AS VARCHAR) AS county, count(*) FILTER (o_orderstatus = 'P' AND CAST(o_orderdate AS DATE) >= DATE '1997-01-01') AS open FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def open_windows(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    tracker = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("string").alias("county"), F.when(F.col("o_orderstatus") == "P", "pending").alias("outcome"), F.to_date("o_orderdate").alias("expiry"))
    return portal.open_windows(tracker, F.lit("1997-01-01").cast("date"))


@query("report_rows", "SELECT o_orderpriority AS \"check\", o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders QUALIFY place <= 12")
def report_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("check", F.col("o_orderpriority"))
    return portal.top_findings(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("check", "o_orderkey", F.col("place").cast("long").alias("place"))
