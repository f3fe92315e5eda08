"""Writers over the test tables: what is stored and what comes in are two cuts of a table that overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.operators import merge
from groundwork.registry import query
from groundwork.session import table

KEYS = ["event_type", "user_id", "day"]
EVENT_KEYS = "event_type, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day, event_id, value"


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_type", F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 7 != 0, F.to_date("ts")).alias("day"), "event_id", "value")


@query(
    "dedup_insert_nullsafe",
    f"""WITH e AS (SELECT {EVENT_KEYS} FROM events), o AS (SELECT * FROM e WHERE event_id % 3 = 0), n AS (SELECT * FROM e WHERE event_id % 3 <> 0)
    SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.event_type IS NOT DISTINCT FROM n.event_type AND o.user_id IS NOT DISTINCT FROM n.user_id AND o.day IS NOT DISTINCT FROM n.day)
    QUALIFY row_number() OVER (PARTITION BY event_type, user_id, day ORDER BY event_id) = 1""",
)
def dedup_insert_nullsafe(spark, sf_dir):
    e = _events(spark, sf_dir)
    return merge.dedup_insert(e.filter("event_id % 3 = 0"), e.filter("event_id % 3 <> 0"), KEYS, [F.col("event_id")])


@query(
    "upsert_latest",
    f"""WITH e AS (SELECT {EVENT_KEYS}, event_id % 3 <> 0 AS fresh FROM events)
    SELECT event_type, user_id, day, event_id, value FROM e QUALIFY row_number() OVER (PARTITION BY event_type, user_id, day ORDER BY fresh DESC, event_id DESC) = 1""",
)
def upsert_latest(spark, sf_dir):
    e = _events(spark, sf_dir)
    return merge.upsert(e.filter("event_id % 3 = 0"), e.filter("event_id % 3 <> 0"), KEYS, [F.col("event_id").desc()])


OLD = "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS bal, c_nationkey AS est, ['assessor', 'b' || (c_custkey % 2)] AS src FROM customer WHERE c_custkey % 3 <> 1"
NEW = "SELECT c_custkey AS id, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 'N' || c_mktsegment END AS seg, c_acctbal + 1 AS bal, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_nationkey + 100 END AS est, ['a' || (c_custkey % 3)] AS src FROM customer WHERE c_custkey % 3 <> 2"


@query(
    "field_merge",
    f"""WITH o AS ({OLD}), n AS ({NEW})
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.seg IS NULL OR o.seg = '' THEN coalesce(n.seg, o.seg) ELSE o.seg END AS seg,
      CASE WHEN o.bal IS NULL OR o.bal = 0 THEN coalesce(n.bal, o.bal) ELSE o.bal END AS bal, CAST(coalesce(n.est, o.est) AS BIGINT) AS est,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(o.src, []), coalesce(n.src, [])))), ',') AS src
    FROM o FULL JOIN n ON o.id = n.id""",
)
def field_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    i = F.col("c_custkey")
    old = c.filter(i % 3 != 1).select(i.alias("id"), F.when(i % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("seg"), F.when(i % 5 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("bal"), F.col("c_nationkey").cast("long").alias("est"), F.array(F.lit("assessor"), F.concat(F.lit("b"), i % 2)).alias("src"))
    new = c.filter(i % 3 != 2).select(i.alias("id"), F.when(i % 8 != 0, F.concat(F.lit("N"), "c_mktsegment")).alias("seg"), (F.col("c_acctbal") + 1).alias("bal"), F.when(i % 6 != 0, F.col("c_nationkey").cast("long") + 100).alias("est"), F.array(F.concat(F.lit("a"), i % 3)).alias("src"))
    return merge.field_merge(old, new, ["id"], overwrite=["est"], union=["src"]).withColumn("src", F.array_join("src", ","))


@query(
    "field_refresh",
    f"""WITH o AS ({OLD}), n AS ({NEW}) SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.seg ELSE o.seg END AS seg, CAST(CASE WHEN n.id IS NOT NULL THEN n.est ELSE o.est END AS BIGINT) AS est
    FROM o FULL JOIN n ON o.id = n.id""",
)
def field_refresh(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    i = F.col("c_custkey")
    old = c.filter(i % 3 != 1).select(i.alias("id"), F.when(i % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("seg"), F.col("c_nationkey").cast("long").alias("est"))
    new = c.filter(i % 3 != 2).select(i.alias("id"), F.when(i % 8 != 0, F.concat(F.lit("N"), "c_mktsegment")).alias("seg"), F.when(i % 6 != 0, F.col("c_nationkey").cast("long") + 100).alias("est"))
    return merge.field_merge(old, new, ["id"], owned=["seg", "est"])


@query(
    "owner_scd2",
    r"""WITH s AS (SELECT o_custkey AS parcel, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE lower(o_orderpriority) || '.' END AS owner, CAST(o_orderdate AS DATE) AS start_date, o_orderkey FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) = 1),
    k AS (SELECT *, regexp_replace(lower(owner), '[^a-z0-9|]', '', 'g') AS key FROM s),
    c AS (SELECT * FROM k QUALIFY key IS DISTINCT FROM lag(key) OVER (PARTITION BY parcel ORDER BY start_date, key)),
    e AS (SELECT parcel, owner, start_date, lead(start_date) OVER (PARTITION BY parcel ORDER BY start_date, key) AS end_date FROM c)
    SELECT parcel, owner, start_date, end_date, end_date IS NULL AS is_current FROM e""",
)
def owner_scd2(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    owner = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lower("o_orderpriority"), F.lit(".")))
    seen = o.select(F.col("o_custkey").alias("parcel"), owner.alias("owner"), F.to_date("o_orderdate").alias("start_date"), "o_orderkey")
    seen = merge.newest(seen, ["parcel", "start_date"], [F.col("o_orderkey")])
    return merge.ownership_history(seen, ["parcel"], ["owner"], "start_date").drop("o_orderkey")


REGISTRY = "SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS seg, c_custkey % 4 <> 0 AS is_active, CAST(c_custkey % 4 AS INT) AS consecutive_misses FROM customer"


@query(
    "snapshot_reconcile",
    f"""WITH r AS ({REGISTRY}), s AS (SELECT DISTINCT id, seg FROM r WHERE id % 3 = 0)
    SELECT r.id, r.seg, CASE WHEN s.id IS NOT NULL THEN true WHEN r.consecutive_misses + 1 >= 3 THEN false ELSE r.is_active END AS is_active,
      CAST(CASE WHEN s.id IS NOT NULL THEN 0 ELSE r.consecutive_misses + 1 END AS BIGINT) AS consecutive_misses
    FROM r LEFT JOIN s ON r.id = s.id AND r.seg IS NOT DISTINCT FROM s.seg""",
)
def snapshot_reconcile(spark, sf_dir):
    i = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select(i.alias("id"), F.when(i % 13 != 0, F.col("c_mktsegment")).alias("seg"), (i % 4 != 0).alias("is_active"), (i % 4).alias("consecutive_misses"))
    return merge.reconcile_snapshot(r, r.filter("id % 3 = 0").select("id", "seg"), ["id", "seg"], complete=True)


@query(
    "stale_retirement",
    """WITH s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'delinquent' ELSE 'forfeit' END AS kind FROM customer)
    SELECT id, kind, CASE WHEN kind = 'delinquent' AND id % 3 = 0 THEN 'forfeited' WHEN kind = 'delinquent' THEN 'cured' ELSE 'source_removed' END AS retired_as FROM s
    WHERE (kind = 'delinquent' AND (id % 3 = 0 OR id % 5 <> 0)) OR (kind = 'forfeit' AND id % 3 <> 0 AND id % 5 <> 0)""",
)
def stale_retirement(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    stored = c.withColumn("kind", F.when(F.col("id") % 2 == 0, "delinquent").otherwise("forfeit"))
    return merge.retire_stale(stored, c.filter("id % 3 = 0"), c.filter("id % 5 = 0"), "id", least_mined=10, most_retired=10**12)


@query(
    "case_collapse",
    """SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS r FROM orders)
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY d DESC NULLS LAST, r DESC NULLS LAST, o_orderkey) = 1""",
)
def case_collapse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("d", F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate")))
    out = merge.collapse_cases(o, "o_custkey", "d", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")), "o_orderkey")
    return out.select("o_custkey", "o_orderkey", "o_orderpriority")


@query(
    "dup_merge",
    """WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_id % 4 = 0 AS stub, CASE WHEN event_id % 4 = 0 THEN value WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events),
    w AS (SELECT *, max(CASE WHEN stub THEN v END) OVER (PARTITION BY user_id, day) AS lent, max(CASE WHEN NOT stub THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day) = 1 AS real FROM e),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY stub, event_id) AS rn FROM w)
    SELECT event_id, user_id, day, CASE WHEN NOT stub AND rn = 1 THEN coalesce(v, lent) ELSE v END AS v FROM k WHERE NOT (stub AND real)""",
)
def dup_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    rows = e.select("event_id", "user_id", F.to_date("ts").alias("day"), F.when(i % 4 == 0, F.col("value")).when(i % 3 != 0, F.col("value")).alias("v"))
    stub = F.col("event_id") % 4 == 0
    return merge.merge_duplicates(rows, ["user_id", "day"], stub, "v", [stub, F.col("event_id")])


@query(
    "tracker_upsert",
    """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'scraped' ELSE 'default_6mo' END AS period_source, CAST(o_orderdate AS DATE) AS expiry, CAST(o_orderdate AS DATE) + 30 AS next_check FROM orders WHERE o_orderkey % 5 <> 0),
    n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'scraped' ELSE 'default_6mo' END AS period_source, CAST(o_orderdate AS DATE) + 10 AS expiry, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 20 END AS next_check FROM orders WHERE o_orderkey % 4 <> 0),
    j AS (SELECT o.id AS oid, n.id AS nid, o.period_source AS op, n.period_source AS np, o.expiry AS oe, n.expiry AS ne, o.next_check AS oc, n.next_check AS nc, n.id IS NOT NULL AND NOT coalesce(o.period_source = 'scraped' AND n.period_source = 'default_6mo', false) AS fresh FROM o FULL JOIN n ON o.id = n.id)
    SELECT coalesce(oid, nid) AS id, CASE WHEN fresh THEN np ELSE op END AS period_source, CASE WHEN fresh THEN ne ELSE oe END AS expiry, greatest(oc, nc) AS next_check FROM j""",
)
def tracker_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    i, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    old = o.filter(i % 5 != 0).select(i.alias("id"), F.when(i % 2 == 0, "scraped").otherwise("default_6mo").alias("period_source"), d.alias("expiry"), F.date_add(d, 30).alias("next_check"))
    new = o.filter(i % 4 != 0).select(i.alias("id"), F.when(i % 3 == 0, "scraped").otherwise("default_6mo").alias("period_source"), F.date_add(d, 10).alias("expiry"), F.when(i % 7 != 0, F.date_add(d, 20)).alias("next_check"))
    return merge.upsert_tracker(old, new, ["id"])


@query(
    "postponement",
    """WITH s AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS sale_date, 0 AS postponement_count FROM orders), n AS (SELECT l_orderkey AS id, max(CAST(l_shipdate AS DATE)) AS d FROM lineitem GROUP BY 1)
    SELECT s.id, CASE WHEN d > sale_date THEN d ELSE sale_date END AS sale_date, CAST(CASE WHEN d > sale_date THEN 1 ELSE 0 END AS BIGINT) AS postponement_count FROM s LEFT JOIN n ON s.id = n.id""",
)
def postponement(spark, sf_dir):
    sales = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("sale_date"), F.lit(0).cast("long").alias("postponement_count"))
    notices = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.to_date("l_shipdate").alias("sale_date"))
    return merge.postpone(sales, notices, ["id"])


@query(
    "absentee_flags",
    """SELECT c_custkey, CASE WHEN mc IS NOT NULL THEN mc <> lower(c_mktsegment) WHEN ms <> 'S' || (c_nationkey % 2) THEN true END AS away, ms <> 'S' || (c_nationkey % 2) AS out_of_state FROM
    (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment) ELSE 'elsewhere' END AS mc, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'S' || (c_custkey % 2) END AS ms FROM customer)""",
)
def absentee_flags(spark, sf_dir):
    i = F.col("c_custkey")
    city = F.when(i % 3 == 0, None).when(i % 3 == 1, F.concat(F.lit(" "), "c_mktsegment")).otherwise("Elsewhere")
    state = F.when(i % 4 != 0, F.concat(F.lit("s"), i % 2))
    away, out = merge.absentee_flags(city, state, F.col("c_mktsegment"), F.concat(F.lit("S"), F.col("c_nationkey") % 2))
    return table(spark, sf_dir, "customer").select("c_custkey", away.alias("away"), out.alias("out_of_state"))
