"""The enriched event feed over the test tables and the queries that serve it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions.ids import county_slug
from groundwork.operators import search
from groundwork.operators.derive import urgency
from groundwork.operators.resolve import best_per_key
from groundwork.registry import query
from groundwork.session import table

#: The day that every derivation answers for.
AS_OF = "2024-02-15"
SOURCES = ("hennepin_sheriff", "mnpublicnotice", "hennepin_tax_roll", "ramsey_tax_roll", "mpls_vbr", "olmsted_probate", "ramsey_tfl", "mnpn_redemption_notice")
ROLL_TYPES = ("tax_forfeit", "tax_delinquent", "tax_assessment")
OUTCOMES = ("redeemed_by_owner", "foreclosed", "foreclosed_sold", "pending")


def as_of():
    return F.lit(AS_OF).cast("date")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their source, parcel, county and lifecycle columns. Users stand for parcels, nations for counties."""
    e, c, n = (table(spark, sf_dir, t) for t in ("events", "customer", "nation"))
    i, k = F.col("event_id"), F.col("k")
    rows = e.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    rows = rows.join(c, F.col("user_id") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    at = lambda names, x: F.get(F.array(*map(F.lit, names)), x.cast("int"))
    source = at(SOURCES, i % len(SOURCES))
    day = F.when(i % 7 != 0, F.to_date("ts"))
    rows = rows.select(
        i.alias("id"),
        source.alias("source"),
        F.when(source.endswith("tax_roll"), at(ROLL_TYPES, i % 3)).otherwise(F.col("event_type")).alias("event_type"),
        F.when(i % 11 != 0, F.col("user_id")).alias("parcel_key"),
        county_slug(F.col("n_name")).alias("county"),
        F.col("ts").alias("observed_at"),
        day.alias("event_date"),
        F.col("value").alias("event_value"),
        F.col("c_acctbal").alias("market_value"),
        F.col("c_name").alias("owner"),
        k,
        F.when(k < 25, "low").when(k < 50, "medium").when(k < 75, "high").otherwise("critical").alias("severity"),
        F.when(k % 3 != 0, F.date_add(day, (k * 3 - 100).cast("int"))).alias("redemption_date"),
        F.when(k % 10 == 1, "Sale postponed").when(k % 10 == 2, "Sold").alias("status"),
        at(OUTCOMES, k % 4).alias("outcome"),
        F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 2 == 0).alias("is_absentee"),
        F.when(k % 4 != 0, k % 4 == 1).alias("is_redeemed"),
        F.when(k % 6 != 0, 1900 + k).alias("year_built"),
        F.when(F.col("user_id") % 9 != 0, F.col("user_id") * 7).alias("sqft"),
        (F.col("c_acctbal") * 100).alias("emv_total"),
    )
    return rows.withColumn("days_left", F.datediff("redemption_date", as_of()).cast("long"))


def _at(names: tuple[str, ...], x: str) -> str:
    return f"list_extract([{', '.join(repr(n) for n in names)}], CAST({x} + 1 AS INT))"


SOURCE_SQL = _at(SOURCES, f"event_id % {len(SOURCES)}")
FEED = f"""feed0 AS (
  SELECT event_id, {SOURCE_SQL} AS source, event_type AS et, user_id, ts, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
    CASE WHEN event_id % 7 <> 0 THEN CAST(ts AS DATE) END AS event_date FROM events),
feed AS (
  SELECT event_id AS id, source, CASE WHEN source LIKE '%tax_roll' THEN {_at(ROLL_TYPES, 'event_id % 3')} ELSE et END AS event_type,
    CASE WHEN event_id % 11 <> 0 THEN user_id END AS parcel_key, lower(n_name) AS county, ts AS observed_at, event_date, value AS event_value,
    c_acctbal AS market_value, c_name AS owner, k,
    CASE WHEN k < 25 THEN 'low' WHEN k < 50 THEN 'medium' WHEN k < 75 THEN 'high' ELSE 'critical' END AS severity,
    CASE WHEN k % 3 <> 0 THEN event_date + CAST(k * 3 - 100 AS INT) END AS redemption_date,
    CASE WHEN k % 10 = 1 THEN 'Sale postponed' WHEN k % 10 = 2 THEN 'Sold' END AS status, {_at(OUTCOMES, 'k % 4')} AS outcome,
    CASE WHEN user_id % 5 <> 0 THEN user_id % 2 = 0 END AS is_absentee, CASE WHEN k % 4 <> 0 THEN k % 4 = 1 END AS is_redeemed,
    CASE WHEN k % 6 <> 0 THEN 1900 + k END AS year_built, CASE WHEN user_id % 9 <> 0 THEN user_id * 7 END AS sqft, c_acctbal * 100 AS emv_total,
    CASE WHEN k % 3 <> 0 THEN date_diff('day', DATE '{AS_OF}', event_date + CAST(k * 3 - 100 AS INT)) END AS days_left
  FROM feed0 LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""


@query("feed_enriched", f"WITH {FEED} SELECT id, source, event_type, parcel_key, county, event_date, event_value, market_value, market_value - event_value AS equity, k FROM feed")
def feed_enriched(spark, sf_dir):
    return feed(spark, sf_dir).select("id", "source", "event_type", "parcel_key", "county", "event_date", "event_value", "market_value", (F.col("market_value") - F.col("event_value")).alias("equity"), "k")


@query(
    "feed_category_filter",
    f"""WITH {FEED} SELECT id, source, event_type FROM feed WHERE source = 'hennepin_tax_roll' AND event_type = 'tax_forfeit'
    OR source = 'ramsey_tax_roll' AND event_type = 'tax_forfeit' OR source IN ('ramsey_tfl', 'mnpn_redemption_notice')""",
)
def feed_category_filter(spark, sf_dir):
    return feed(spark, sf_dir).filter(search.in_category("tax_forfeit")).select("id", "source", "event_type")


@query("feed_category_compat", f"WITH {FEED} SELECT id, source FROM feed WHERE source IN ('hennepin_tax_roll', 'ramsey_tax_roll', 'ramsey_tfl', 'mnpn_redemption_notice') AND event_type = 'tax_forfeit'")
def feed_category_compat(spark, sf_dir):
    return feed(spark, sf_dir).filter(search.in_category("tax_forfeit", compat=True)).select("id", "source")


@query(
    "feed_range_filters",
    f"""WITH {FEED} SELECT id, county, event_value, market_value FROM feed
    WHERE event_value >= 10 AND event_value <= 60 AND market_value >= 0 AND county = 'nation_3' AND observed_at > TIMESTAMP '2024-01-05' AND is_absentee = false""",
)
def feed_range_filters(spark, sf_dir):
    f = search.Filters(county="Nation 3", observed_since="2024-01-05 00:00:00", ranges={"event_value": (10, 60), "market_value": (0, None)}, absentee=False)
    return search.matching(feed(spark, sf_dir), f, as_of()).select("id", "county", "event_value", "market_value")


@query(
    "feed_redemption_windows",
    f"""WITH {FEED}, s AS (SELECT *, date_diff('day', event_date, DATE '{AS_OF}') AS age FROM feed WHERE status IS NULL),
    w AS (SELECT id, 'in_redemption' AS win FROM s WHERE CASE WHEN redemption_date IS NOT NULL THEN days_left > 90 ELSE age < 92 END
      UNION ALL SELECT id, 'expiring_soon' FROM s WHERE CASE WHEN redemption_date IS NOT NULL THEN days_left BETWEEN 0 AND 90 ELSE age BETWEEN 92 AND 182 END
      UNION ALL SELECT id, 'expired' FROM s WHERE CASE WHEN redemption_date IS NOT NULL THEN days_left < 0 ELSE age > 182 END)
    SELECT id, win FROM w""",
)
def feed_redemption_windows(spark, sf_dir):
    rows = feed(spark, sf_dir)
    parts = [search.matching(rows, search.Filters(status="active", redemption=w), as_of()).select("id", F.lit(w).alias("win")) for w in ("in_redemption", "expiring_soon", "expired")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "feed_urgency_sort",
    f"""WITH {FEED}, b AS (SELECT id, days_left, CASE WHEN days_left >= 0 THEN 0 WHEN days_left < 0 THEN 1 ELSE 2 END AS bucket FROM feed)
    SELECT id, CAST(bucket AS BIGINT) AS bucket, days_left FROM b ORDER BY bucket, days_left ASC NULLS LAST, id LIMIT 100""",
)
def feed_urgency_sort(spark, sf_dir):
    out = search.page(feed(spark, sf_dir), search.Filters(sort="redemption_urgency", descending=False, limit=100), as_of())
    return out.select("id", urgency(F.col("redemption_date"), as_of())["bucket"].cast("long").alias("bucket"), "days_left")


PAGE = f"WITH {FEED} SELECT id, source, county, event_value, market_value FROM feed WHERE source IN ('hennepin_sheriff', 'mnpublicnotice') AND event_value >= 5 ORDER BY market_value - event_value DESC NULLS LAST, id LIMIT 50 OFFSET 20"


@query("feed_page", PAGE)
def feed_page(spark, sf_dir):
    f = search.Filters(category="foreclosure", ranges={"event_value": (5, None)}, sort="equity", descending=True, limit=50, offset=20)
    return search.page(feed(spark, sf_dir), f, as_of()).select("id", "source", "county", "event_value", "market_value")


@query("feed_total", f"WITH {FEED} SELECT count(*) AS total FROM feed WHERE source IN ('mpls_vbr') AND NOT coalesce(is_redeemed, false)")
def feed_total(spark, sf_dir):
    return search.total(feed(spark, sf_dir), search.Filters(category="vacant", redeemed=False), as_of())


RANK = "CASE WHEN event_type = 'tax_forfeit' THEN 2 WHEN source IN ('hennepin_sheriff', 'mnpublicnotice') THEN 1 WHEN source = 'ramsey_tax_roll' THEN 3 WHEN source = 'mpls_vbr' THEN 4 ELSE 9 END"


@query(
    "dedupe_best_row",
    f"""WITH {FEED} SELECT id, parcel_key, source FROM feed WHERE parcel_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parcel_key ORDER BY {RANK}, id) = 1
    UNION ALL SELECT id, parcel_key, source FROM feed WHERE parcel_key IS NULL""",
)
def dedupe_best_row(spark, sf_dir):
    return best_per_key(feed(spark, sf_dir), "parcel_key", [search.actionability(), F.col("id")]).select("id", "parcel_key", "source")


BAND = "CASE WHEN market_value >= 100000 THEN 'high' WHEN market_value >= 40000 THEN 'moderate' WHEN market_value > 0 THEN 'low' END"
LABEL = "CASE lower(event_type) WHEN 'sheriff_sale' THEN 'Foreclosure (sheriff sale)' WHEN 'foreclosure' THEN 'Foreclosure' WHEN 'tax_forfeit' THEN 'Tax-forfeit property' WHEN 'tax_delinquent' THEN 'Tax-delinquent property' WHEN 'tax_assessment' THEN 'Tax assessment' WHEN 'vacant' THEN 'Vacant/registered building' ELSE 'Distressed property' END"
REDACTED = f"""WITH {FEED}, s AS (SELECT *, market_value * 30 AS mv, k >= 50 AS dense FROM feed), b AS (SELECT * EXCLUDE (market_value), mv AS market_value FROM s), t AS (SELECT *, {BAND} AS band, {LABEL} AS label FROM b)"""
LOW = "CAST(NULL AS VARCHAR) AS owner, CAST(NULL AS VARCHAR) AS raw, CAST(NULL AS VARCHAR) AS enrichment, CAST(NULL AS VARCHAR) AS odd, CAST(NULL AS VARCHAR) AS pano, true AS imagery_there, k % 2 = 0 AS tax_redeemed, CAST(NULL AS VARCHAR) AS tax_owner, CAST(NULL AS BIGINT) AS tax_years, CASE WHEN dense THEN county END AS county, NOT dense AND county IS NOT NULL AS county_locked, label || CASE WHEN dense AND county IS NOT NULL THEN ' — ' || county || ' County' ELSE '' END AS title"


@query(
    "redact_tiers",
    f"""{REDACTED}
    SELECT id, 'free' AS tier, {LOW}, label || '.' || coalesce(' Estimated equity band: ' || CASE WHEN dense THEN band END || '.', '') || ' Details locked — upgrade to view owner, address, and amounts.' AS description,
      CAST(NULL AS DOUBLE) AS market_value, CASE WHEN dense THEN band END AS equity_band, NOT dense AS equity_band_locked FROM t
    UNION ALL SELECT id, 'basic', {LOW}, label || '.' || coalesce(' Estimated equity band: ' || band || '.', '') || ' Details locked — upgrade to view owner, address, and amounts.', market_value, band, false FROM t
    UNION ALL SELECT id, 'standard', owner, NULL, 'facts', 'odd', 'pano', true, k % 2 = 0, NULL, k, county, false, 'Sale of ' || owner, owner || ' owes', market_value, band, false FROM t
    UNION ALL SELECT id, 'premium', owner, 'raw', 'facts', 'odd', 'pano', true, k % 2 = 0, owner, k, county, false, 'Sale of ' || owner, owner || ' owes', market_value, NULL, false FROM t
    UNION ALL SELECT id, 'admin', owner, 'raw', 'facts', 'odd', 'pano', true, k % 2 = 0, owner, k, county, false, 'Sale of ' || owner, owner || ' owes', market_value, NULL, false FROM t""",
)
def redact_tiers(spark, sf_dir):
    rows = feed(spark, sf_dir).select(
        "id",
        "county",
        "event_type",
        "owner",
        (F.col("market_value") * 30).alias("market_value"),
        F.concat(F.lit("Sale of "), "owner").alias("title"),
        F.concat("owner", F.lit(" owes")).alias("description"),
        F.lit("raw").alias("raw"),
        F.lit("facts").alias("enrichment"),
        F.lit("odd").alias("odd"),
        F.struct(F.lit(True).alias("available"), F.lit("pano").alias("pano_id")).alias("imagery"),
        F.struct((F.col("k") % 2 == 0).alias("redeemed_since_list"), F.col("owner").alias("owner_name"), F.col("k").alias("years_delinquent")).alias("tax_status"),
        (F.col("k") >= 50).alias("dense"),
    )
    parts = []
    for tier in search.TIERS:
        seen = search.redact(rows, tier, F.col("dense"), shown=("dense",))
        have = seen.columns
        nested = lambda c, f, kind: F.col(c).getField(f) if f in seen.schema[c].dataType.names else F.lit(None).cast(kind)  # noqa: E731, B023
        parts.append(
            seen.select(
                "id", F.lit(tier).alias("tier"), "owner", "raw", "enrichment", "odd", nested("imagery", "pano_id", "string").alias("pano"), F.col("imagery.available").alias("imagery_there"), F.col("tax_status.redeemed_since_list").alias("tax_redeemed"),
                nested("tax_status", "owner_name", "string").alias("tax_owner"), nested("tax_status", "years_delinquent", "bigint").alias("tax_years"), "county", (F.col("county_locked") if "county_locked" in have else F.lit(False)).alias("county_locked"), "title", "description", "market_value",
                (F.col("equity_band") if "equity_band" in have else F.lit(None).cast("string")).alias("equity_band"), (F.col("equity_band_locked") if "equity_band_locked" in have else F.lit(False)).alias("equity_band_locked"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


@query(
    "saved_search_counts",
    f"""WITH {FEED} SELECT 'a' AS search, count(*) AS n FROM feed WHERE source IN ('hennepin_sheriff', 'mnpublicnotice') AND market_value >= 1000
    UNION ALL SELECT 'b', count(*) FROM feed WHERE source = 'olmsted_probate' UNION ALL SELECT 'c', count(*) FROM feed WHERE lower(status) LIKE '%postpon%'""",
)
def saved_search_counts(spark, sf_dir):
    asked = {"a": search.Filters(category="foreclosure", ranges={"market_value": (1000, None)}), "b": search.Filters(category="probate"), "c": search.Filters(status="postponed")}
    return search.saved_search_counts(feed(spark, sf_dir), asked, as_of())


SORT_SQL = {"event_date": "event_date", "event_value": "event_value", "observed_at": "observed_at", "equity": "market_value - event_value", "year_built": "year_built", "sqft": "sqft", "emv_total": "emv_total"}


@query(
    "feed_sorts",
    f"WITH {FEED} " + " UNION ALL ".join(f"SELECT id, '{name}' AS sort, '{d}' AS dir FROM (SELECT id FROM feed ORDER BY {key} {d} NULLS LAST, id LIMIT 60 OFFSET 5)" for name, key in SORT_SQL.items() for d in ("asc", "desc")),
)
def feed_sorts(spark, sf_dir):
    rows = feed(spark, sf_dir)
    pages = [search.page(rows, search.Filters(sort=name, descending=d == "desc", limit=60, offset=5), as_of()).select("id", F.lit(name).alias("sort"), F.lit(d).alias("dir")) for name in SORT_SQL for d in ("asc", "desc")]
    return reduce(DataFrame.unionByName, pages)


HUNTED = "(SELECT id FROM feed WHERE source = 'mpls_vbr' AND is_absentee AND event_value >= 50 AND year_built = 1955 AND CASE WHEN redemption_date IS NOT NULL THEN days_left < 0 ELSE date_diff('day', event_date, DATE '2024-02-15') > 182 END ORDER BY market_value - event_value DESC NULLS LAST, id LIMIT 25)"


@query(
    "filter_gating",
    f"WITH {FEED} SELECT id, 'standard' AS tier FROM (SELECT id FROM feed WHERE source = 'mpls_vbr' ORDER BY event_date DESC NULLS LAST, id LIMIT 25) "
    + " ".join(f"UNION ALL SELECT id, '{t}' FROM {HUNTED}" for t in ("free", "basic", "premium", "admin")),
)
def filter_gating(spark, sf_dir):
    rows = feed(spark, sf_dir)
    asked = search.Filters(category="vacant", ranges={"event_value": (50, None)}, equal={"year_built": 1955}, redemption="expired", absentee=True, sort="equity", descending=True, limit=25)
    return reduce(DataFrame.unionByName, [search.page(rows, search.allowed(asked, t), as_of()).select("id", F.lit(t).alias("tier")) for t in search.TIERS])
