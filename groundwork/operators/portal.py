"""Listings, offers and the owners' look-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.addresses import house_number, masked, normalize_address

# An offer stands for this many hours at least; most addresses that a look-up shows.
OFFER_HOURS, MOST_SHOWN = 72, 10


def upsert_listings(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One active listing of each key: incoming rows update its supplied columns or are new; closed listings stay as they are."""
    active, closed = stored.filter("status = 'active'"), stored.filter("status is null or status <> 'active'")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    both = active.alias("o").join(incoming.alias("n"), on, "full_outer")
    new = set(incoming.columns)
    pick = lambda c: F.lit("active") if c == "status" else F.coalesce(f"n.{c}", f"o.{c}") if c in new else F.col(f"o.{c}")
    return both.select(*[pick(c).alias(c) for c in stored.columns]).unionByName(closed)


def dashboard(listings: DataFrame, parcels: DataFrame, offers: DataFrame, owner: Column, keys: Sequence[str]) -> DataFrame:
    """The owner's listings with their parcel (by all its keys) and number of offers, newest first."""
    counted = offers.groupBy("listing_id").agg(F.count(F.lit(1)).alias("n_offers"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"p.{k}"))
    mine = listings.filter(F.col("user_id") == owner)
    rows = mine.alias("l").join(parcels.alias("p"), on, "left").select("l.*", *[f"p.{c}" for c in parcels.columns if c not in listings.columns])
    rows = rows.join(counted, "listing_id", "left").withColumn("n_offers", F.coalesce("n_offers", F.lit(0)).cast("long"))
    return rows.orderBy(F.col("created_at").desc_nulls_last(), "listing_id")


def answer_offers(offers: DataFrame, listings: DataFrame, answers: DataFrame) -> DataFrame:
    """Offers after (offer_id, user_id, answer): only the listing's owner answers, and only what is still submitted."""
    owners = listings.select(F.col("listing_id").alias("__l"), F.col("user_id").alias("__owner"))
    said = answers.select(F.col("offer_id").alias("__o"), F.col("user_id").alias("__by"), "answer")
    rows = offers.join(owners, F.col("listing_id") == F.col("__l"), "left").join(said, F.col("offer_id") == F.col("__o"), "left")
    may = F.coalesce((F.col("__owner") == F.col("__by")) & (F.col("status") == "submitted"), F.lit(False))
    return rows.withColumn("status", F.when(may, F.col("answer")).otherwise(F.col("status"))).select(*offers.columns)


def offer_problem(expires: Column, now: Column, listing_status: Column, allowed: Column, buyer: Column) -> Column:
    """Why an offer is turned down; null if it stands. No list of buyer types allows all."""
    hours = (F.unix_timestamp(expires) - F.unix_timestamp(now)) / 3600
    return (
        F.when(hours.isNull() | (hours < OFFER_HOURS), "expires_too_soon")
        .when(~F.coalesce(listing_status == "active", F.lit(False)), "not_active")
        .when(F.coalesce(F.size(allowed) > 0, F.lit(False)) & ~F.coalesce(F.array_contains(allowed, buyer), F.lit(False)), "buyer_type")
    )


def lookup(queries: DataFrame, query: str, spine: DataFrame, address: str, stub: Column, most: int = MOST_SHOWN) -> DataFrame:
    """Masked addresses that a typed one may mean: either normalised address starts with the other, the same house number.

    The join is on the house number; of a real and a stub parcel of one address the real
    one stays; ``most`` of each query, in address order, is what the feature shows.
    """
    q = queries.withColumn("__q", normalize_address(F.col(query))).withColumn("__h", house_number(F.col("__q")))
    s = spine.withColumn("__a", normalize_address(F.col(address))).withColumn("__n", house_number(F.col("__a"))).withColumn("__stub", stub)
    best = Window.partitionBy("__a").orderBy("__stub", *[c for c in spine.columns])
    s = s.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")
    hits = q.join(s, (F.col("__h") == F.col("__n")) & (F.col("__a").startswith(F.col("__q")) | F.col("__q").startswith(F.col("__a"))))
    shown = Window.partitionBy(*[F.col(c) for c in queries.columns]).orderBy("__a")
    hits = hits.withColumn("place", F.row_number().over(shown)).filter(F.col("place") <= most)
    return hits.withColumn("shown", masked(F.col("__a"))).drop("__q", "__h", "__a", "__n", "__stub")


def open_windows(tracker: DataFrame, as_of: Column) -> DataFrame:
    """Pending windows that have not expired, by county."""
    return tracker.groupBy("county").agg(F.count_if((F.col("outcome") == "pending") & (F.col("expiry") >= as_of)).alias("open"))


def confidence(period_source: Column) -> Column:
    """Only a period read from the notice is stated; any other is assumed."""
    return F.when(period_source == "scraped", "stated").otherwise("assumed")


def market_value(emv_total: Column, legacy: Column) -> Column:
    """The first figure that is neither null nor zero."""
    return F.coalesce(F.nullif(emv_total, F.lit(0)), F.nullif(legacy, F.lit(0)))


def facts(values: dict[str, Column]) -> Column:
    """'name: value' of the values that there are."""
    return F.filter(F.array(*[F.concat(F.lit(f"{k}: "), c.cast("string")) for k, c in values.items()]), lambda x: x.isNotNull())


def top_findings(findings: DataFrame, order: Sequence[Column], most: int = 12) -> DataFrame:
    """The first ``most`` findings of each check, as a report shows them."""
    w = Window.partitionBy("check").orderBy(*order)
    return findings.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
