"""Statistics, checks and scans over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.operators import aggregate, checks, search
from groundwork.plans.feed import AS_OF, FEED, as_of, feed
from groundwork.registry import query
from groundwork.session import table
from groundwork.sources import readers


@query("source_counts", f"WITH {FEED} SELECT source, event_type, count(*) AS n, CAST(max(observed_at) AS DATE) AS newest FROM feed GROUP BY 1, 2")
def source_counts(spark, sf_dir):
    return aggregate.source_counts(feed(spark, sf_dir)).withColumn("newest", F.to_date("newest"))


@query(
    "category_stats",
    f"""WITH {FEED} SELECT 'foreclosure' AS category, count(*) AS n, CAST(max(observed_at) AS DATE) AS newest FROM feed WHERE source IN ('hennepin_sheriff', 'mnpublicnotice')
    UNION ALL SELECT 'tax_forfeit', count(*), CAST(max(observed_at) AS DATE) FROM feed WHERE source LIKE '%tax_roll' AND event_type = 'tax_forfeit' OR source IN ('ramsey_tfl', 'mnpn_redemption_notice')
    UNION ALL SELECT 'vacant', count(*), CAST(max(observed_at) AS DATE) FROM feed WHERE source = 'mpls_vbr' UNION ALL SELECT 'tax_delinquent', count(*), CAST(max(observed_at) AS DATE) FROM feed WHERE source LIKE '%tax_roll' AND event_type = 'tax_delinquent'
    UNION ALL SELECT 'tax_assessment', count(*), CAST(max(observed_at) AS DATE) FROM feed WHERE source = 'ramsey_tax_roll' AND event_type = 'tax_assessment' UNION ALL SELECT 'probate', count(*), CAST(max(observed_at) AS DATE) FROM feed WHERE source = 'olmsted_probate'""",
)
def category_stats(spark, sf_dir):
    return aggregate.category_totals(aggregate.source_counts(feed(spark, sf_dir)), search.CATEGORIES).withColumn("newest", F.to_date("newest"))


@query(
    "county_pivot",
    f"WITH {FEED} SELECT county, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'tax_forfeit') AS tax_forfeit FROM feed GROUP BY 1",
)
def county_pivot(spark, sf_dir):
    return aggregate.county_pivot(feed(spark, sf_dir), "county", "event_type", ["click", "view", "tax_forfeit"])


SIGNALS = f"""{FEED}, o AS (SELECT parcel_key, count(*) AS n_events, count(DISTINCT event_type) AS signal_count, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS families,
    max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) AS r FROM feed GROUP BY 1)"""


@query("overlay_signals", f"WITH {SIGNALS} SELECT parcel_key, n_events, signal_count, families, CASE r WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS max_severity, regexp_matches(families, '(^|,)(tax_forfeit|tax_delinquent|tax_assessment)(,|$)') AS has_tax, regexp_matches(families, '(^|,)(click|view)(,|$)') AS has_visit FROM o")
def overlay_signals(spark, sf_dir):
    flags = {"has_tax": aggregate.OVERLAY_FLAGS["has_tax"], "has_visit": ("click", "view")}
    out = aggregate.overlay(feed(spark, sf_dir), ["parcel_key"], "event_type", "severity", flags)
    return out.withColumns({"families": F.array_join("families", ","), "signal_count": F.col("signal_count").cast("long")})


@query(
    "owner_portfolio",
    f"""WITH {FEED} SELECT upper('  grp ' || (k % 40)) AS x, upper(trim('  grp ' || (k % 40))) AS owner_norm, count(DISTINCT parcel_key) AS parcel_count, count(*) AS event_count, coalesce(bool_or(is_absentee), false) AS any_absentee,
    array_to_string(list_sort(list(DISTINCT source)), ',') AS families FROM feed WHERE k % 41 <> 0 GROUP BY 1, 2""",
)
def owner_portfolio(spark, sf_dir):
    rows = feed(spark, sf_dir).withColumn("grp", F.when(F.col("k") % 41 != 0, F.concat(F.lit("  grp "), F.col("k") % 40)).otherwise(" "))
    out = aggregate.owner_portfolios(rows, "grp", "parcel_key", "is_absentee", "source")
    return out.select(F.concat(F.lit("  "), "owner_norm").alias("x"), "owner_norm", "parcel_count", "event_count", "any_absentee", F.array_join("families", ",").alias("families"))


@query(
    "differentiators",
    f"WITH {SIGNALS}, p AS (SELECT upper(owner) AS w, count(DISTINCT parcel_key) AS c FROM feed WHERE owner <> '' GROUP BY 1) SELECT (SELECT count(*) FROM o WHERE signal_count >= 2) AS multi_signal, (SELECT count(*) FROM o WHERE signal_count >= 3) AS triple_signal, (SELECT count(*) FROM p WHERE c >= 2) AS multi_parcel_owners",
)
def differentiators(spark, sf_dir):
    rows = feed(spark, sf_dir)
    return aggregate.differentiators(aggregate.overlay(rows, ["parcel_key"], "event_type", "severity"), aggregate.owner_portfolios(rows, "owner", "parcel_key", "is_absentee", "source"))


@query(
    "percentile_bands",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS p25, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS p75, avg(o_orderkey) AS avg_days FROM orders GROUP BY 1, 2 HAVING count(*) >= 15""",
)
def percentile_bands(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return aggregate.percentile_bands(o, ["o_orderpriority", "o_orderstatus"], "o_totalprice", "o_orderkey")


@query("value_density", "SELECT o_orderstatus, CAST(floor(o_totalprice / 50000) AS BIGINT) AS bucket, count(*) AS n, count(*) >= 5 AS dense FROM orders WHERE o_totalprice > 0 GROUP BY 1, 2")
def value_density(spark, sf_dir):
    return aggregate.value_density(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice")


@query(
    "latest_debt",
    f"""WITH {FEED}, l AS (SELECT parcel_key, event_value FROM feed QUALIFY row_number() OVER (PARTITION BY parcel_key ORDER BY event_date DESC NULLS LAST, id) = 1)
    SELECT parcel_key, event_value, (SELECT max(event_date) FROM feed f WHERE f.parcel_key IS NOT DISTINCT FROM l.parcel_key) AS event_date FROM l""",
)
def latest_debt(spark, sf_dir):
    return aggregate.latest_value(feed(spark, sf_dir), ["parcel_key"], "event_date", "event_value", "id")


@query(
    "delinquency_rollup",
    """WITH d AS (SELECT l_suppkey, l_linenumber AS y, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS due, sum(CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END) AS paid, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem GROUP BY 1, 2),
    o AS (SELECT *, due - coalesce(paid, 0) AS owed FROM d)
    SELECT l_suppkey, CAST(min(CASE WHEN owed > 0 THEN y END) AS BIGINT) AS first_unpaid_year, count(*) FILTER (owed > 0) AS unpaid_years, CAST(coalesce(sum(CASE WHEN owed > 0 THEN owed END), 0) AS DOUBLE) AS total_owed, max(last) AS last_payment,
      CAST(coalesce(sum(CASE WHEN y = 3 THEN due END), 0) AS DOUBLE) AS current_due FROM o GROUP BY 1""",
)
def delinquency_rollup(spark, sf_dir):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").cast("long").alias("y"), price.alias("due"), F.when(F.col("l_returnflag") != "R", price).alias("paid"), F.to_date("l_shipdate").alias("last"))
    out = aggregate.delinquency(d, ["l_suppkey"], "y", "due", "paid", "last", F.lit(3))
    return out.withColumns({"total_owed": F.col("total_owed").cast("double"), "current_due": F.col("current_due").cast("double")})


@query(
    "redemption_stats",
    f"""WITH {FEED}, s AS (SELECT CASE WHEN k % 5 = 0 THEN 'resolved' WHEN days_left < 0 THEN 'outcome_pending' WHEN days_left <= 90 THEN 'expiring_soon' WHEN days_left > 90 THEN 'in_redemption' END AS st, outcome FROM feed)
    SELECT count(*) AS total, count(*) FILTER (st = 'in_redemption') AS in_redemption, count(*) FILTER (st = 'expiring_soon') AS expiring_soon, count(*) FILTER (st = 'outcome_pending') AS outcome_pending, count(*) FILTER (st = 'resolved') AS resolved,
      count(*) FILTER (outcome IN ('redeemed_by_owner', 'redeemed_by_junior')) AS redeemed, count(*) FILTER (outcome = 'foreclosed') AS foreclosed, count(*) FILTER (outcome = 'foreclosed_sold') AS sold, round_even(count(*) FILTER (st = 'resolved') * 100.0 / count(*), 1) AS resolved_pct FROM s""",
)
def redemption_stats(spark, sf_dir):
    left = F.col("days_left")
    state = F.when(F.col("k") % 5 == 0, "resolved").when(left < 0, "outcome_pending").when(left <= 90, "expiring_soon").when(left > 90, "in_redemption")
    return aggregate.redemption_stats(feed(spark, sf_dir).withColumn("st", state), "st", "outcome").withColumn("resolved_pct", F.col("resolved_pct").cast("double"))


@query(
    "source_freshness",
    """WITH s AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN ' None ' WHEN 1 THEN 'published' END AS sem, CASE WHEN o_orderkey % 5 <> 0 THEN DATE '2024-03-01' - CAST(o_orderkey % 300 - 20 AS INT) END AS newest, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 4 * 20 AS INT) END AS every,
      CASE WHEN o_orderkey % 3 = 0 THEN DATE '2024-02-20' END AS ev FROM orders)
    SELECT id, CASE WHEN lower(trim(sem)) IN ('semantic', 'none') THEN 'exempt' WHEN newest IS NULL THEN 'unknown' WHEN newest > DATE '2024-03-01' THEN 'fresh' WHEN every IS NULL THEN 'unjudged'
      WHEN DATE '2024-03-01' - newest > greatest(60, every * 3) AND NOT coalesce(DATE '2024-03-01' - ev <= greatest(60, every * 3), false) THEN 'frozen' ELSE 'fresh' END AS state FROM s""",
)
def source_freshness(spark, sf_dir):
    i, day = F.col("o_orderkey"), F.lit("2024-03-01").cast("date")
    newest = F.when(i % 5 != 0, F.date_sub(day, (i % 300 - 20).cast("int")))
    state = checks.freshness(F.when(i % 7 == 0, " None ").when(i % 7 == 1, "published"), newest, F.when(i % 4 != 0, (i % 4 * 20).cast("int")), F.when(i % 3 == 0, F.lit("2024-02-20").cast("date")), day)
    return table(spark, sf_dir, "orders").select(i.alias("id"), state.alias("state"))


@query(
    "health_classify",
    """WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 <> 0 THEN TIMESTAMP '2024-03-01' - to_days(CAST(o_orderkey % 100 AS INT)) END AS ok, CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2024-02-28' END AS bad, CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 0 END AS f,
      CASE o_orderkey % 7 WHEN 0 THEN 'Shelved: no feed' WHEN 1 THEN '3 of 1,000 records failed' WHEN 2 THEN '300 of 1,000 records failed' WHEN 3 THEN 'All 20 records failed' END AS notes, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 5 * 7 END AS every FROM orders),
    t AS (SELECT *, lower(coalesce(notes, '')) AS low, coalesce(bad > ok, false) AS failed, epoch(TIMESTAMP '2024-03-01') / 86400 - epoch(ok) / 86400 AS age FROM s)
    SELECT id, CASE WHEN low LIKE 'shelved%' THEN 'shelved' WHEN ok IS NULL OR f > 0 THEN 'broken' WHEN failed THEN CASE WHEN low LIKE '3 of%' THEN 'check' ELSE 'broken' END WHEN low LIKE 'all %' OR low LIKE '300 of%' THEN 'check'
      WHEN every IS NULL THEN CASE WHEN age > 45 THEN 'unscheduled_review' ELSE 'unscheduled' END WHEN age > greatest(2, every * 1.5) THEN 'stale' ELSE 'healthy' END AS state FROM t""",
)
def health_classify(spark, sf_dir):
    i = F.col("o_orderkey")
    now = F.lit("2024-03-01").cast("timestamp")
    ok = F.when(i % 13 != 0, F.timestamp_add("DAY", -(i % 100).cast("int"), now))
    notes = F.when(i % 7 == 0, "Shelved: no feed").when(i % 7 == 1, "3 of 1,000 records failed").when(i % 7 == 2, "300 of 1,000 records failed").when(i % 7 == 3, "All 20 records failed")
    state = checks.health(ok, F.when(i % 3 == 0, F.lit("2024-02-28").cast("timestamp")), F.when(i % 11 == 0, 2).otherwise(0), notes, F.when(i % 5 != 0, i % 5 * 7), now)
    return table(spark, sf_dir, "orders").select(i.alias("id"), state.alias("state"))


@query("keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1234 ORDER BY o_orderkey LIMIT 500")
def keyset_page(spark, sf_dir):
    return aggregate.keyset_page(table(spark, sf_dir, "orders"), "o_orderkey", F.lit(1234), 500).select("o_orderkey", "o_totalprice")


@query("already_staged", "SELECT DISTINCT l_partkey AS url FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def already_staged(spark, sf_dir):
    staged = table(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("url"))
    return readers.not_staged(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("url")), staged, "url")


@query(
    "rejects",
    """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT coalesce(o_orderpriority <> '5-LOW', false) THEN 'priority' END, CASE WHEN NOT coalesce(p >= 50000, false) THEN 'total' END], lambda x: x IS NOT NULL), ',') AS errors
    FROM (SELECT *, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders) WHERE NOT coalesce(o_orderpriority <> '5-LOW', false) OR NOT coalesce(p >= 50000, false)""",
)
def rejects(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")))
    _, bad = readers.split_valid(o, {"total": F.col("p") >= 50000, "priority": F.col("o_orderpriority") != "5-LOW"})
    return bad.select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query("sample_per_county")
def sample_per_county(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return aggregate.sample_per_group(c, "c_nationkey", F.col("c_custkey"), 5, seed=1).select("c_nationkey", "c_custkey")
