"""Joins that resolve rows to a spine, and look-ups with fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.functions import addresses, ids, notices
from groundwork.operators import checks, resolve
from groundwork.registry import query
from groundwork.session import table

# a spine whose digits repeat for some rows and whose names repeat for others
SPINE = "SELECT c_custkey, substr(regexp_replace(c_name, '[^0-9]', '', 'g'), 3) AS digits, c_mktsegment || (c_custkey % 400) AS addr FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey + 100000, substr(regexp_replace(c_name, '[^0-9]', '', 'g'), 3), 'x' || c_custkey FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 5 <> 0"
ROWS = "SELECT o_orderkey, '0' || substr(CAST(10000000 + o_custkey AS VARCHAR), 3) AS digits, o_custkey FROM orders"


def _spine(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    d = F.substring(ids.digits(F.col("c_name")), 3, 20)
    base = c.filter("c_custkey % 5 <> 0")
    one = base.select("c_custkey", d.alias("digits"), F.concat("c_mktsegment", F.col("c_custkey") % 400).alias("addr"))
    return one.unionByName(base.filter("c_custkey % 7 = 0").select((F.col("c_custkey") + 100000).alias("c_custkey"), d.alias("digits"), F.concat(F.lit("x"), "c_custkey").alias("addr")))


def _rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.concat(F.lit("0"), F.substring((F.col("o_custkey") + 10000000).cast("string"), 3, 20)).alias("digits"), "o_custkey")


@query(
    "resolve_digits",
    f"""WITH s AS ({SPINE}), r AS ({ROWS}), u AS (SELECT digits, count(DISTINCT c_custkey) AS n, min(c_custkey) AS k FROM s GROUP BY 1)
    SELECT r.o_orderkey, CASE WHEN n = 1 THEN k END AS c_custkey, CASE WHEN n = 1 THEN 'match' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status FROM r LEFT JOIN u USING (digits)""",
)
def resolve_digits(spark, sf_dir):
    return resolve.resolve_unique(_rows(spark, sf_dir), _spine(spark, sf_dir), ["digits"], "c_custkey").select("o_orderkey", "c_custkey", "status")


@query(
    "resolve_ladder",
    f"""WITH s AS ({SPINE}), r AS (SELECT *, 'BUILDING' || (o_custkey % 400) AS addr FROM ({ROWS})), u AS (SELECT digits, count(DISTINCT c_custkey) AS n, min(c_custkey) AS k FROM s GROUP BY 1), v AS (SELECT addr, count(DISTINCT c_custkey) AS n, min(c_custkey) AS k FROM s GROUP BY 1)
    SELECT o_orderkey, CASE WHEN u.n = 1 THEN u.k WHEN u.n > 1 THEN NULL WHEN v.n = 1 THEN v.k END AS c_custkey,
      CASE WHEN u.n = 1 THEN 'match' WHEN u.n > 1 THEN 'ambiguous' WHEN v.n = 1 THEN 'match' WHEN v.n > 1 THEN 'ambiguous' ELSE 'none' END AS status,
      CAST(CASE WHEN u.n IS NOT NULL THEN 1 WHEN v.n IS NOT NULL THEN 2 END AS BIGINT) AS how
    FROM r LEFT JOIN u ON r.digits = u.digits LEFT JOIN v ON r.addr = v.addr""",
)
def resolve_ladder(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("addr", F.concat(F.lit("BUILDING"), F.col("o_custkey") % 400))
    out = resolve.resolve_ladder(rows, _spine(spark, sf_dir), [["digits"], ["addr"]], "c_custkey")
    return out.select("o_orderkey", F.col("c_custkey").cast("long").alias("c_custkey"), "status", F.col("how").cast("long").alias("how"))


STREETS = ["Main Street N", "Main St. North", "OAK AVENUE", "Oak Ave", "1st Street Northeast", "1ST ST NE", "Onigum Road Northwest, Walker MN", "Glacial Valley RD"]


@query(
    "resolve_address",
    f"""WITH a AS (SELECT s_suppkey, (s_suppkey % 40) || ' ' || list_extract({STREETS}, CAST(s_suppkey % 8 + 1 AS INT)) AS addr FROM supplier),
    w AS (SELECT *, list_filter(string_split_regex(upper(regexp_replace(split_part(addr, ',', 1), '[^A-Za-z0-9]', ' ', 'g')), '\\s+'), lambda x: x <> '' AND NOT list_contains({addresses.STREET_TYPES}, x)) AS ws FROM a),
    k AS (SELECT s_suppkey, array_to_string(list_transform(ws, lambda x: CASE x WHEN 'NORTHEAST' THEN 'NE' WHEN 'NORTHWEST' THEN 'NW' WHEN 'SOUTHEAST' THEN 'SE' WHEN 'SOUTHWEST' THEN 'SW' WHEN 'NORTH' THEN 'N' WHEN 'SOUTH' THEN 'S' WHEN 'EAST' THEN 'E' WHEN 'WEST' THEN 'W' ELSE x END), '') AS key FROM w),
    u AS (SELECT key, count(*) AS n, min(s_suppkey) AS m FROM k GROUP BY 1)
    SELECT s_suppkey, key, CASE WHEN n = 1 THEN 'match' ELSE 'ambiguous' END AS status FROM k JOIN u USING (key)""",
)
def resolve_address(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    street = F.get(F.array(*map(F.lit, STREETS)), (F.col("s_suppkey") % 8).cast("int"))
    keyed = s.select("s_suppkey", addresses.addr_key(F.concat((F.col("s_suppkey") % 40).cast("string"), F.lit(" "), street)).alias("key"))
    return resolve.resolve_unique(keyed, keyed.select("key", F.col("s_suppkey").alias("target")), ["key"], "target").select("s_suppkey", "key", "status")


@query(
    "radius_join",
    """WITH a AS (SELECT s_suppkey, 44 + s_suppkey * 0.0005 AS lat, -93 + (s_suppkey % 7) * 0.001 AS lng FROM supplier), b AS (SELECT p_partkey, 44 + p_partkey * 0.0001 AS lat2, -93 + (p_partkey % 5) * 0.001 AS lng2 FROM part),
    d AS (SELECT s_suppkey, p_partkey, 2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng) / 2), 2), 1.0))) AS m FROM a, b)
    SELECT s_suppkey, p_partkey, CAST(round(m) AS BIGINT) AS metres FROM d WHERE m <= 250""",
)
def radius_join(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select("s_suppkey", (44 + F.col("s_suppkey") * 0.0005).alias("lat"), (-93 + (F.col("s_suppkey") % 7) * 0.001).alias("lng"))
    b = table(spark, sf_dir, "part").select("p_partkey", (44 + F.col("p_partkey") * 0.0001).alias("lat2"), (-93 + (F.col("p_partkey") % 5) * 0.001).alias("lng2"))
    return resolve.within_radius(a, b, 250).select("s_suppkey", "p_partkey", F.round("metres_apart").cast("long").alias("metres"))


@query(
    "package_explode",
    """WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN [] WHEN o_orderkey % 4 = 1 THEN [CAST(1000000 + o_orderkey AS VARCHAR)]
      ELSE [CAST(1000000 + o_orderkey AS VARCHAR), CAST(2000000 + o_orderkey AS VARCHAR)] END AS l FROM orders)
    SELECT o_orderkey, unnest(l) AS pid, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS place FROM p WHERE len(l) > 0 UNION ALL SELECT o_orderkey, NULL, NULL FROM p WHERE len(l) = 0""",
)
def package_explode(spark, sf_dir):
    i = F.col("o_orderkey")
    a, b = (i + 1000000).cast("string"), (i + 2000000).cast("string")
    text = F.when(i % 4 == 0, F.lit("12-34")).when(i % 4 == 1, a).when(i % 4 == 2, F.concat(a, F.lit("; "), b, F.lit(" COT# 77608"))).otherwise(F.concat(a, F.lit(" and "), b, F.lit(", "), a))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return resolve.package_members(rows, notices.split_pids(F.col("text"))).select("o_orderkey", "pid", F.col("place").cast("long").alias("place"))


@query(
    "name_match",
    """WITH p AS (SELECT s_suppkey, 'l' || translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'abcdefghij') || 'son' AS surname FROM supplier),
    o AS (SELECT p_partkey, 'l' || translate(CAST(p_partkey // 20 AS VARCHAR), '0123456789', 'abcdefghij') || 'son' AS surname FROM part)
    SELECT s_suppkey, p_partkey FROM p JOIN o USING (surname) WHERE p_partkey % 4 <> 0 AND NOT (s_suppkey % 3 = 0 AND p_partkey % 5 = 0)""",
)
def name_match(spark, sf_dir):
    letters = lambda x: F.translate(x.cast("string"), "0123456789", "abcdefghij")
    i, j = F.col("s_suppkey"), F.col("p_partkey")
    people = table(spark, sf_dir, "supplier").select(i, F.concat(F.lit("Ann "), F.when(i % 3 == 0, "Q ").otherwise(""), F.lit("L"), letters(i), F.lit("son")).alias("person"))
    owners = table(spark, sf_dir, "part").select(j, F.concat(F.lit("L"), F.upper(letters(F.expr("p_partkey div 20"))), F.lit("SON, "), F.when(j % 4 == 0, "BOB").otherwise("ANN"), F.when(j % 5 == 0, " R").otherwise("")).alias("owner"))
    return resolve.name_candidates(people, owners, "person", "owner", notices.same_person(F.col("person"), F.col("owner"))).select("s_suppkey", "p_partkey")


TRACKER = "SELECT o_custkey, CAST(o_orderdate AS DATE) AS anchor, max(o_orderkey) AS v FROM orders GROUP BY 1, 2"


@query(
    "tracker_lookup_fallback",
    f"""WITH t AS ({TRACKER}), r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) + 1 END AS d FROM orders),
    l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY anchor DESC) = 1)
    SELECT o_orderkey, CASE WHEN t.v IS NOT NULL THEN 'exact' WHEN l.v IS NOT NULL THEN 'latest' ELSE 'none' END AS found, coalesce(t.v, l.v) AS v
    FROM r LEFT JOIN t ON r.o_custkey = t.o_custkey AND r.d = t.anchor LEFT JOIN l ON r.o_custkey = l.o_custkey""",
)
def tracker_lookup_fallback(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day, i = F.to_date("o_orderdate"), F.col("o_orderkey")
    tracker = o.select("o_custkey", day.alias("anchor"), i.alias("v"))
    rows = o.select(i, "o_custkey", F.when(i % 3 == 1, day).when(i % 3 == 2, F.date_add(day, 1)).alias("d"))
    return resolve.exact_or_latest(rows, tracker, ["o_custkey"], "d", "anchor", "v").select("o_orderkey", "found", "v")


CENTS = "CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*)"


@query(
    "calibration_hierarchy",
    f"""WITH a AS (SELECT c_nationkey, c_mktsegment, {CENTS} AS r FROM customer GROUP BY 1, 2 HAVING count(*) >= 13), b AS (SELECT c_nationkey, {CENTS} AS r FROM customer GROUP BY 1 HAVING count(*) >= 60)
    SELECT c_custkey, CASE WHEN a.r IS NOT NULL THEN 'city' WHEN b.r IS NOT NULL THEN 'county' ELSE 'metro' END AS scope, coalesce(a.r, b.r, (SELECT {CENTS} FROM customer)) AS r
    FROM customer c LEFT JOIN a ON c.c_nationkey = a.c_nationkey AND c.c_mktsegment = a.c_mktsegment LEFT JOIN b ON c.c_nationkey = b.c_nationkey""",
)
def calibration_hierarchy(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    ratio = (F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).cast("double") / F.count(F.lit(1))).alias("r")
    level = lambda keys, least: c.groupBy(*keys).agg(ratio, F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("n")  # noqa: E731  groups with too few sales have no value
    out = resolve.scoped(c, [("city", level(["c_nationkey", "c_mktsegment"], 13), ["c_nationkey", "c_mktsegment"]), ("county", level(["c_nationkey"], 60), ["c_nationkey"]), ("metro", c.agg(ratio), [])], "r")
    return out.select("c_custkey", "scope", "r")


@query(
    "assessor_patch",
    """SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN o_orderpriority END, ''), c_mktsegment) AS seg, coalesce(nullif(CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_totalprice END, 0.0), c_acctbal) AS emv FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def assessor_patch(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    i = F.col("o_orderkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    seg = F.when(i % 3 == 0, "").when(i % 3 == 1, F.col("o_orderpriority"))
    emv = F.when(i % 5 == 0, 0.0).otherwise(F.col("o_totalprice"))
    return rows.select("o_orderkey", F.coalesce(F.nullif(seg, F.lit("")), "c_mktsegment").alias("seg"), F.coalesce(F.nullif(emv, F.lit(0.0)), "c_acctbal").alias("emv"))


@query("semi_exists", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def semi_exists(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_custkey")
    c = table(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("anti_orphans", "SELECT o_orderkey, k FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN o_custkey + 1000000 ELSE o_custkey END AS k FROM orders) r WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = k)")
def anti_orphans(spark, sf_dir):
    i = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(i, F.when(i % 10 == 1, F.col("o_custkey") + 1000000).when(i % 10 != 0, F.col("o_custkey")).alias("k"))
    return checks.orphans(rows, table(spark, sf_dir, "customer"), [("k", "c_custkey")])
