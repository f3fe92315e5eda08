"""Derived states and figures over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.operators import derive, emit
from groundwork.plans.feed import AS_OF, FEED, as_of, feed
from groundwork.registry import query
from groundwork.session import table

D = f"DATE '{AS_OF}'"


@query(
    "redemption_state",
    f"""WITH {FEED}, s AS (SELECT id, k % 2 = 0 AS tracked, CASE WHEN k % 2 = 0 THEN redemption_date END AS td, CASE WHEN k % 5 = 0 THEN redemption_date END AS pd, event_date, coalesce(status = 'Sold', true) AS done, outcome FROM feed),
    e AS (SELECT *, coalesce(td, pd, CASE WHEN done THEN event_date + 182 END) AS ends FROM s)
    SELECT id, ends, td IS NULL AND pd IS NULL AND done AND event_date IS NOT NULL AS estimated,
      CASE WHEN tracked AND outcome IN ('redeemed_by_owner', 'foreclosed', 'foreclosed_sold') THEN 'resolved' WHEN ends IS NULL THEN NULL WHEN ends < {D} THEN CASE WHEN tracked THEN 'outcome_pending' ELSE 'expired' END
        WHEN date_diff('day', {D}, ends) <= 90 THEN 'expiring_soon' ELSE 'in_redemption' END AS state FROM e""",
)
def redemption_state(spark, sf_dir):
    k = F.col("k")
    tracked = k % 2 == 0
    end = derive.redemption_end(F.when(tracked, F.col("redemption_date")), F.when(k % 5 == 0, F.col("redemption_date")), F.col("event_date"), F.coalesce(F.col("status") == "Sold", F.lit(True)))
    rows = feed(spark, sf_dir).withColumn("e", end)
    return rows.select("id", "e.ends", "e.estimated", derive.redemption_state(F.col("e.ends"), F.col("outcome"), tracked, as_of()).alias("state"))


LADDER = f"CASE WHEN expiry + 30 > {D} THEN expiry + 30 WHEN expiry + 60 > {D} THEN expiry + 60 WHEN expiry + 90 > {D} THEN expiry + 90 WHEN expiry + 180 > {D} THEN expiry + 180 END"
CHECKED = f"""c AS (SELECT o_orderkey AS id, o_orderkey % 7 <> 0 AS found, CASE o_orderkey % 6 WHEN 0 THEN 'US Bank Natl as Trustee' WHEN 1 THEN NULL ELSE 'Jane Doe' END AS owner, CASE WHEN o_orderkey % 11 = 0 THEN ' y' END AS forfeit,
    CASE o_orderkey % 5 WHEN 0 THEN expiry + 9 WHEN 1 THEN expiry - 9 END AS sale, expiry - 180 AS anchor, expiry, o_orderkey % 4 AS stage FROM (SELECT *, {D} + CAST(o_orderkey % 400 - 250 AS INT) AS expiry FROM orders))"""


@query("next_check_ladder", f"SELECT o_orderkey, {LADDER} AS next_check FROM (SELECT o_orderkey, {D} + CAST(o_orderkey % 400 - 250 AS INT) AS expiry FROM orders)")
def next_check_ladder(spark, sf_dir):
    expiry = F.date_add(as_of(), (F.col("o_orderkey") % 400 - 250).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", derive.next_check(expiry, as_of()).alias("next_check"))


@query(
    "outcome_decide",
    f"""WITH {CHECKED}, n AS (SELECT *, {LADDER} AS later, found AND coalesce(owner LIKE '%Trustee%', false) AS l, found AND forfeit IS NOT NULL AS f, found AND coalesce(sale > expiry, false) AS a, found AND coalesce(sale > anchor AND sale <= expiry, false) AS i FROM c)
    SELECT id, CASE WHEN l OR f THEN 'foreclosed' WHEN a THEN 'foreclosed_sold' WHEN later IS NULL THEN 'unknown' END AS outcome,
      CASE WHEN l THEN false WHEN f THEN true WHEN a THEN false ELSE i OR later IS NULL END AS ambiguous,
      CASE WHEN NOT found THEN 'missing' WHEN l THEN 'lender_owner' WHEN f THEN 'forfeit_flag' WHEN a THEN 'sale_after_expiry' WHEN i THEN 'sale_in_window' ELSE 'no_signal' END AS why,
      CASE WHEN NOT (l OR f OR a) THEN later END AS next_check, CAST(CASE WHEN l OR f OR a THEN stage WHEN later IS NULL THEN 4 ELSE least(stage + 1, 4) END AS BIGINT) AS stage FROM n""",
)
def outcome_decide(spark, sf_dir):
    i = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("expiry", F.date_add(as_of(), (i % 400 - 250).cast("int")))
    owner = F.when(i % 6 == 0, "US Bank Natl as Trustee").when(i % 6 != 1, "Jane Doe")
    sale = F.when(i % 5 == 0, F.date_add("expiry", 9)).when(i % 5 == 1, F.date_sub("expiry", 9))
    out = derive.decide(i % 7 != 0, owner, F.when(i % 11 == 0, " y"), sale, F.date_sub("expiry", 180), F.col("expiry"), i % 4, as_of())
    return o.select(i.alias("id"), out.alias("d")).select("id", "d.outcome", "d.ambiguous", "d.why", "d.next_check", F.col("d.stage").cast("long").alias("stage"))


@query(
    "deal_math",
    f"""WITH {FEED}, s AS (SELECT id, market_value AS v, event_value AS d, CASE WHEN days_left BETWEEN 0 AND 90 THEN 'expiring_soon' WHEN days_left > 90 THEN 'in_redemption' ELSE 'expired' END AS st FROM feed)
    SELECT id, CAST(round_even(v * 1.25, 0) AS BIGINT) AS est_value, CAST(round_even(v * 0.5, 0) AS BIGINT) AS band_low, CAST(round_even(v * 1.5, 0) AS BIGINT) AS band_high,
      CAST(round_even(v * 0.75 - d, 0) AS BIGINT) AS seller_net, CAST(round_even(round_even(v * 1.25, 0) - d, 0) AS BIGINT) AS equity_spread FROM s WHERE st <> 'expired' AND v > 0 AND d > 0""",
)
def deal_math(spark, sf_dir):
    left = F.col("days_left")
    state = F.when(left.between(0, 90), "expiring_soon").when(left > 90, "in_redemption").otherwise("expired")
    out = derive.deal_math(F.col("market_value"), F.col("event_value"), state, F.lit(1.25), F.lit(0.5), F.lit(0.75), F.lit(1.5))
    return feed(spark, sf_dir).select("id", out.alias("m")).filter("m is not null").select("id", "m.*")


@query(
    "vacancy_clock",
    f"""WITH s AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS a FROM orders), y AS (SELECT *, round_even(date_diff('day', a, DATE '2026-06-15') / 365.25, 1) AS years,
      greatest(make_date(year(a) + 2, month(a), least(day(a), 28)), DATE '2024-12-01') AS st FROM s)
    SELECT id, years, years >= 2 AS over_cap, CAST(round_even(years * 7228.70, 0) AS BIGINT) AS fees, CASE WHEN years >= 2 THEN CAST(greatest(0, (2026 - year(st)) * 12 + 6 - month(st)) * 2000 AS BIGINT) END AS monthly,
      CAST(round_even(CASE id % 3 WHEN 0 THEN years * 2705 WHEN 1 THEN 2705 + greatest(years - 1, 0) * 5410 ELSE years * 5410 END, 0) AS BIGINT) AS other_fees FROM y""",
)
def vacancy_clock(spark, sf_dir):
    day = F.lit("2026-06-15").cast("date")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("a"))
    out = o.select("id", derive.vacancy(F.col("a"), day).alias("v"), derive.vacancy(F.col("a"), day, F.col("id") % 3 + 1).alias("w"))
    return out.select("id", "v.years", "v.over_cap", "v.fees", "v.monthly", F.col("w.fees").alias("other_fees"))


@query(
    "statutory_dates",
    """WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y FROM orders), m AS (SELECT y, make_date(y, 5, 1) AS a, make_date(y + 1, 5, 1) AS b FROM y)
    SELECT y, a + CAST((8 - isodow(a)) % 7 + 7 AS INT) AS judgment, CAST(b + CAST((8 - isodow(b)) % 7 + 7 AS INT) + INTERVAL 36 MONTH AS DATE) AS forfeiture FROM m""",
)
def statutory_dates(spark, sf_dir):
    y = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    return y.select(F.col("y").cast("long").alias("y"), derive.second_monday_of_may(F.col("y")).alias("judgment"), derive.forfeiture_day(F.col("y")).alias("forfeiture"))


@query(
    "tracker_build",
    """WITH s AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN ' Postponed' WHEN 1 THEN NULL ELSE 'sold' END AS status, CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_orderdate AS DATE) END AS sale,
      CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 12 WHEN 2 THEN 6 END AS months, CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_orderdate AS DATE) + 100 END AS county FROM orders)
    SELECT id, CASE WHEN status = ' Postponed' THEN 'not_held' WHEN months = 0 THEN 'no_right' WHEN sale IS NULL THEN 'no_date' WHEN sale > DATE '1998-01-01' THEN 'future' END AS skip,
      coalesce(county, CAST(sale + INTERVAL 1 MONTH * CASE WHEN months > 0 THEN months ELSE 6 END AS DATE)) AS expiry,
      CASE WHEN county IS NOT NULL THEN 'county_stated' WHEN months > 0 THEN 'scraped' ELSE 'default_6mo' END AS period_source FROM s""",
)
def tracker_build(spark, sf_dir):
    i, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(
        i.alias("id"),
        F.when(i % 6 == 0, " Postponed").when(i % 6 != 1, "sold").alias("status"),
        F.when(i % 8 != 0, day).alias("sale"),
        F.when(i % 5 == 0, 0).when(i % 5 == 1, 12).when(i % 5 == 2, 6).alias("months"),
        F.when(i % 9 == 0, F.date_add(day, 100)).alias("county"),
    )
    e = derive.expiry_of(F.col("sale"), F.col("county"), F.col("months"))
    skip = derive.skip_reason(F.col("status"), F.col("sale"), F.col("months"), F.lit("1998-01-01").cast("date"))
    return rows.select("id", skip.alias("skip"), e.alias("e")).select("id", "skip", "e.expiry", "e.period_source")


@query(
    "bands",
    """SELECT c_custkey AS id, CASE WHEN v <= 0 THEN NULL WHEN (v - d) / v * 100 <= 0 THEN 'underwater' WHEN (v - d) / v * 100 <= 19 THEN 'thin' WHEN (v - d) / v * 100 <= 60 THEN 'moderate' ELSE 'wide' END AS equity,
      CASE WHEN t < 0 THEN NULL WHEN t <= 30 THEN 'under 30 days' WHEN t <= 60 THEN '30-60 days' WHEN t <= 90 THEN '60-90 days' WHEN t <= 180 THEN '3-6 months' WHEN t <= 365 THEN '6-12 months' ELSE 'more than a year' END AS timing,
      CASE WHEN v > 0 THEN CAST(greatest(floor(v * 0.9 / 5000) * 5000, 0) AS BIGINT) END AS low, CASE WHEN v > 0 THEN CAST(ceil(v * 1.1 / 5000) * 5000 AS BIGINT) END AS high
    FROM (SELECT c_custkey, CAST(c_custkey % 900 * 1000 - 3000 AS DOUBLE) AS v, CAST(c_custkey % 700 * 997 AS DOUBLE) AS d, c_custkey % 500 - 20 AS t FROM customer)""",
)
def bands(spark, sf_dir):
    i = F.col("c_custkey")
    v, d = (i % 900 * 1000 - 3000).cast("double"), (i % 700 * 997).cast("double")
    rows = table(spark, sf_dir, "customer").select(i.alias("id"), v.alias("v"), d.alias("d"), (i % 500 - 20).alias("t"))
    return rows.select("id", derive.equity_share_band(F.col("v"), F.col("d")).alias("equity"), derive.timing_band(F.col("t")).alias("timing"), derive.value_band(F.col("v")).alias("b")).select("id", "equity", "timing", "b.low", "b.high")


@query(
    "centroid",
    """WITH r AS (SELECT s_suppkey AS id, s_suppkey % 5 AS x, s_suppkey % 7 AS y, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 2 + s_suppkey % 3 END AS h FROM supplier)
    SELECT id, CAST(round(CASE WHEN h = 0 THEN x + 8.0 / 5 ELSE x + 2.0 END, 6) AS DOUBLE) AS cx, CAST(round(CASE WHEN h = 0 THEN y ELSE y + h / 2.0 END, 6) AS DOUBLE) AS cy FROM r""",
)
def centroid(spark, sf_dir):
    i = F.col("s_suppkey")
    x, y, h = (i % 5).cast("double"), (i % 7).cast("double"), F.when(i % 3 == 0, 0).otherwise(2 + i % 3).cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(point(x, y), point(x + 4, y), point(x + 4, y + h), point(x, y + h), point(x, y))
    out = table(spark, sf_dir, "supplier").select(i.alias("id"), ring.alias("ring")).select("id", derive.centroid(F.col("ring")).alias("c"))
    return out.select("id", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"))


@query(
    "event_emission",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'critical' WHEN o_orderkey % 4 = 0 THEN 'high' ELSE 'medium' END AS vacancy, CASE WHEN o_orderdate < TIMESTAMP '2024-01-01' THEN 'critical' ELSE 'high' END AS forfeit,
      CASE WHEN o_orderkey % 6 >= 3 THEN 'high' WHEN o_orderkey % 6 >= 1 THEN 'medium' ELSE 'low' END AS delinquent,
      CASE WHEN o_orderkey % 9 * 1500 >= 2000 AND o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 9 * 1500 >= 10000 THEN 'high' WHEN o_orderkey % 9 * 1500 >= 5000 THEN 'medium' ELSE 'low' END END AS assessment,
      CASE WHEN o_orderkey % 5 = 0 THEN 'tax_forfeit' WHEN o_orderkey % 5 < 3 THEN 'tax_delinquent' END AS kind, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE least(o_orderkey % 7 / (o_orderkey % 4), 1) END AS DOUBLE) AS rate FROM orders""",
)
def event_emission(spark, sf_dir):
    i, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        i.alias("id"),
        emit.vacancy_severity(F.when(i % 3 == 0, day), F.when(i % 4 == 0, day)).alias("vacancy"),
        emit.forfeit_severity(day).alias("forfeit"),
        emit.delinquent_severity(i % 6).alias("delinquent"),
        emit.assessment_signal(i % 9 * 1500, i % 2 == 0, F.lit(True)).alias("assessment"),
        emit.tax_roll_kind(F.when(i % 5 == 0, "t"), F.when(i % 5 < 3, F.lit("21"))).alias("kind"),
        emit.vacancy_rate((i % 7).cast("double"), (i % 4).cast("double")).alias("rate"),
    )


@query(
    "notice_promotion",
    """WITH n AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN [] WHEN 1 THEN [CAST(3000000 + o_orderkey AS VARCHAR)] ELSE [CAST(3000000 + o_orderkey AS VARCHAR), CAST(4000000 + o_orderkey AS VARCHAR)] END AS p, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT 'n' || o_orderkey || CASE WHEN len(p) > 1 THEN '#' || x ELSE '' END AS source_id, x AS parcel_id, CASE WHEN len(p) = 1 THEN CAST(amount AS DOUBLE) END AS event_value FROM (SELECT *, unnest(p) AS x FROM n)
    UNION ALL SELECT 'n' || o_orderkey, 'ANOKA-FC-n' || o_orderkey, CAST(amount AS DOUBLE) FROM n WHERE len(p) = 0""",
)
def notice_promotion(spark, sf_dir):
    i = F.col("o_orderkey")
    a, b = (i + 3000000).cast("string"), (i + 4000000).cast("string")
    pids = F.when(i % 3 == 1, F.array(a)).when(i % 3 == 2, F.array(a, b)).otherwise(F.array().cast("array<string>"))
    staged = table(spark, sf_dir, "orders").select(F.lit("anoka").alias("county"), F.concat(F.lit("n"), i).alias("notice_id"), F.to_date("o_orderdate").alias("sale_date"), F.col("o_totalprice").alias("amount"), F.lit(6).alias("months"), pids.alias("pids"), F.when(i % 4 == 0, "rejected").alias("review"))
    ready = staged.filter(emit.promotable(F.col("notice_id"), F.col("sale_date"), F.col("amount"), F.col("review")))
    events, _, _ = emit.promotion(ready, F.col("pids"))
    return events.select("source_id", "parcel_id", F.col("event_value").cast("double").alias("event_value"))
