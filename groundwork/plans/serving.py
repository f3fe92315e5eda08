"""Lists that need an outcome, a tracked state or the overlay, owners' pages and county coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.operators import aggregate, search
from groundwork.plans.feed import FEED, as_of, feed
from groundwork.registry import query
from groundwork.session import table

#: Counties of the sources that serve one county: source -> (county, slug).
COUNTIES = {"hennepin_sheriff": ("Hennepin", "hennepin"), "hennepin_tax_roll": ("Hennepin", "hennepin"), "mpls_vbr": ("Hennepin", "hennepin"), "ramsey_tax_roll": ("Ramsey", "ramsey"), "ramsey_tfl": ("Ramsey", "ramsey"), "olmsted_probate": ("Olmsted", "olmsted"), "anoka_sheriff": ("Anoka", "anoka")}
SLUGS = ("hennepin", "ramsey", "anoka")
STATE = "CASE WHEN k % 5 = 0 THEN 'resolved' WHEN days_left < 0 THEN 'outcome_pending' WHEN days_left <= 90 THEN 'expiring_soon' WHEN days_left > 90 THEN 'in_redemption' END"


def _tracked(spark, sf_dir):
    left = F.col("days_left")
    state = F.when(F.col("k") % 5 == 0, "resolved").when(left < 0, "outcome_pending").when(left <= 90, "expiring_soon").when(left > 90, "in_redemption")
    return feed(spark, sf_dir).withColumn("redemption_state", state)


@query(
    "feed_outcome_buckets",
    f"""WITH {FEED} SELECT id, CASE outcome WHEN 'redeemed_by_owner' THEN 'redeemed' WHEN 'redeemed_by_junior' THEN 'redeemed' WHEN 'foreclosed' THEN 'reo' ELSE 'sold' END AS bucket
    FROM feed WHERE outcome IN ('redeemed_by_owner', 'redeemed_by_junior', 'foreclosed', 'foreclosed_sold')""",
)
def feed_outcome_buckets(spark, sf_dir):
    rows = feed(spark, sf_dir)
    asked = [*search.OUTCOME_BUCKETS, "no such bucket"]
    parts = [search.matching(rows, search.allowed(search.Filters(outcome=b), "premium"), as_of()).select("id", F.lit(b).alias("bucket")) for b in asked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("feed_tracker_states", f"WITH {FEED}, s AS (SELECT id, {STATE} AS state FROM feed) SELECT id, state FROM s WHERE state IN ('outcome_pending', 'resolved')")
def feed_tracker_states(spark, sf_dir):
    rows = _tracked(spark, sf_dir)
    parts = [search.matching(rows, search.Filters(redemption=s), as_of()).select("id", F.lit(s).alias("state")) for s in search.TRACKED]
    return parts[0].unionByName(parts[1])


@query(
    "feed_multi_signal",
    f"""WITH {FEED}, o AS (SELECT parcel_key, count(DISTINCT source) AS signal_count FROM feed WHERE parcel_key IS NOT NULL GROUP BY 1),
    r AS (SELECT id, parcel_key, o.signal_count, CASE WHEN event_type = 'tax_forfeit' THEN 2 WHEN source IN ('hennepin_sheriff', 'mnpublicnotice') THEN 1 WHEN source = 'ramsey_tax_roll' THEN 3 WHEN source = 'mpls_vbr' THEN 4 ELSE 9 END AS rank
      FROM feed JOIN o USING (parcel_key) WHERE o.signal_count >= 3)
    SELECT id, parcel_key, signal_count FROM r QUALIFY row_number() OVER (PARTITION BY parcel_key ORDER BY rank, id) = 1""",
)
def feed_multi_signal(spark, sf_dir):
    rows = feed(spark, sf_dir)
    signals = aggregate.overlay(rows, ["parcel_key"], "source", "severity")
    return search.matching(search.with_signals(rows, signals), search.Filters(multi_signal=3), as_of()).select("id", "parcel_key", F.col("signal_count").cast("long").alias("signal_count"))


@query(
    "owners_page",
    f"""WITH {FEED}, p AS (SELECT upper(owner) AS owner_norm, count(DISTINCT parcel_key) AS parcel_count, count(*) AS event_count FROM feed WHERE owner <> '' GROUP BY 1)
    SELECT owner_norm, parcel_count, event_count FROM p WHERE parcel_count >= 1 AND event_count % 2 = 0 ORDER BY parcel_count DESC, owner_norm LIMIT 100 OFFSET 10""",
)
def owners_page(spark, sf_dir):
    p = aggregate.owner_portfolios(feed(spark, sf_dir), "owner", "parcel_key", "is_absentee", "source")
    p = p.withColumn("owner_type", F.when(F.col("event_count") % 2 == 0, "llc").otherwise("individual"))
    return search.owners_page(p, least=1, owner_type="llc", limit=100, offset=10).select("owner_norm", "parcel_count", "event_count")


def _coverage(spark, sf_dir):
    rows = feed(spark, sf_dir)
    known = spark.createDataFrame([(s, *c) for s, c in COUNTIES.items()], "source string, county string, slug string")
    slug = F.get(F.array(*map(F.lit, SLUGS)), F.col("c_nationkey") % 3)
    parcels = table(spark, sf_dir, "customer").groupBy(slug.alias("county_code")).agg(F.count(F.lit(1)).alias("parcels"))
    return rows, aggregate.county_breakdown(aggregate.source_counts(rows), known, parcels), parcels


BREAKDOWN = f"""{FEED}, m AS (SELECT * FROM (VALUES {", ".join(f"('{s}', '{c}', '{g}')" for s, (c, g) in COUNTIES.items())}) v(source, county, slug)),
  pc AS (SELECT [{", ".join(f"'{s}'" for s in SLUGS)}][c_nationkey % 3 + 1] AS county_code, count(*) AS parcels FROM customer GROUP BY 1),
  b AS (SELECT m.county, slug, count(*) AS signals FROM feed JOIN m USING (source) GROUP BY 1, 2)"""


@query("county_breakdown", f"WITH {BREAKDOWN} SELECT county, signals, parcels FROM b LEFT JOIN pc ON slug = county_code")
def county_breakdown(spark, sf_dir):
    return _coverage(spark, sf_dir)[1]


@query(
    "county_coverage",
    f"""WITH {BREAKDOWN} SELECT (SELECT count(*) FROM b) AS counties_covered, (SELECT count(DISTINCT county) FROM feed) AS counties_with_signals,
    (SELECT count(*) FROM pc WHERE parcels > 100) AS counties_with_parcels, (SELECT CAST(sum(parcels) AS BIGINT) FROM pc) AS parcels_indexed""",
)
def county_coverage(spark, sf_dir):
    rows, breakdown, parcels = _coverage(spark, sf_dir)
    return aggregate.coverage(breakdown, rows, parcels)


#: Conditions of the six categories on (source, event_type), as the members name them.
IN_CATEGORY = {name: " OR ".join(f"(source = '{s}'" + (f" AND event_type = '{t}')" if t else ")") for s, t in members) for name, members in search.CATEGORIES.items()}


@query("county_categories", f"WITH {FEED} SELECT county, " + ", ".join(f"count(*) FILTER ({c}) AS {name}" for name, c in IN_CATEGORY.items()) + f" FROM feed WHERE {' OR '.join(IN_CATEGORY.values())} GROUP BY county")
def county_categories(spark, sf_dir):
    """Counties by the six categories; an event may be in several, one that is in none is not counted."""
    rows = feed(spark, sf_dir).select("county", F.explode(aggregate.category_of(F.col("source"), F.col("event_type"), search.CATEGORIES)).alias("category"))
    return aggregate.county_pivot(rows, "county", "category", list(search.CATEGORIES))


KIND, DISTRICT = "CASE k % 3 WHEN 0 THEN 'single_family' WHEN 1 THEN 'condo' END", "'ISD ' || (parcel_key % 7)"


@query(
    "feed_property_filters",
    f"""WITH {FEED}, r AS (SELECT *, {KIND} AS property_type, {DISTRICT} AS school_district FROM feed)
    SELECT 'kind' AS asked, id FROM r WHERE property_type = 'condo' AND school_district = 'ISD 3' UNION ALL SELECT 'range', id FROM r WHERE property_type = 'single_family' AND sqft BETWEEN 100 AND 700 AND event_value >= 40 UNION ALL SELECT 'typed wrong', id FROM r WHERE school_district = 'ISD 1'""",
)
def feed_property_filters(spark, sf_dir):
    """Three parsed sentences; of the last only the district is of a known name and type."""
    k = F.col("k") % 3
    rows = feed(spark, sf_dir).withColumns({"property_type": F.when(k == 0, "single_family").when(k == 1, "condo"), "school_district": F.concat(F.lit("ISD "), (F.col("parcel_key") % 7).cast("string"))})
    asked = {
        "kind": {"equal": {"property_type": "condo", "school_district": "ISD 3"}},
        "range": {"equal": {"property_type": "single_family"}, "ranges": {"sqft": [100, 700], "event_value": [40, None]}},
        "typed wrong": {"equal": {"school_district": "ISD 1", "property_type": 7}, "ranges": {"nope": [1, 2], "sqft": ["a", 2]}, "county": 5},
    }
    parts = [search.matching(rows, search.from_words(a), as_of()).select(F.lit(name).alias("asked"), "id") for name, a in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("feed_counts", f"WITH {FEED} SELECT count(*) FILTER (NOT coalesce(is_redeemed, false)) AS total, count(*) FILTER (coalesce(is_redeemed, false)) AS redeemed FROM feed WHERE source = 'mpls_vbr'")
def feed_counts(spark, sf_dir):
    return search.counts(feed(spark, sf_dir), search.Filters(category="vacant", redeemed=False), as_of())
