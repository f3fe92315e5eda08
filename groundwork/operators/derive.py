"""Derived states and figures. Every function takes the day it answers for; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The redemption clock.
DEFAULT_DAYS, SOON_DAYS, DEFAULT_MONTHS = 182, 90, 6
RESOLVED = ("redeemed_by_owner", "redeemed_by_junior", "foreclosed", "foreclosed_sold", "deed_in_lieu", "sale_cancelled")
UNHELD = ("scheduled", "pending", "postponed", "cancelled", "canceled")
CHECK_DAYS = (30, 60, 90, 180)
# Vacancy rates by year and month, and the day the monthly programme began.
VACANT_YEAR, VACANT_MONTH, VACANT_MONTH_FROM = 7228.70, 2000.0, "2024-12-01"
CATEGORY_YEAR, CATEGORY_YEAR_HIGH = 2705.0, 5410.0
# Bands.
TIMING = ((30, "under 30 days"), (60, "30-60 days"), (90, "60-90 days"), (180, "3-6 months"), (365, "6-12 months"))
TIMING_BEYOND = "more than a year"
EQUITY_SHARES = ((0, "underwater"), (19, "thin"), (60, "moderate"))
EQUITY_BEYOND = "wide"
VALUE_STEP, VALUE_HALF = 5_000, 0.10
# Owner names that show a lender took the property.
LENDER_OWNER = (
    r"(?i)FEDERAL NATIONAL MORTGAGE|\bFANNIE\s*MAE\b|FEDERAL HOME LOAN MORTGAGE|FED HOME LOAN MORTGAGE|\bFREDDIE\s*MAC\b|SECRETARY OF HOUSING|\bHUD\b"
    r"|U\.?\s*S\.?\s*BANK.*TRUST|WILMINGTON TRUST|WILMINGTON SAVINGS|DEUTSCHE BANK|PENNYMAC|WELLS FARGO.*TRUST|BANK OF NEW YORK|HSBC BANK.*TRUST|CITIBANK.*TRUST"
    r"|\bAS TRUSTEE\b|\bTRUSTEE\b|MORTGAGE\s+(LLC|CORP|INC|COMPANY|CORPORATION)|\bLOAN\s+(TRUST|SERVICING|SERVICES)\b|\bMTG\s+LOAN\s+TRUST\b|\bMERS\b"
    r"|MORTGAGE ELECTRONIC REGISTRATION|\bLAKEVIEW LOAN\b|\bNEWREZ\b|\bNATIONSTAR\b|\bMR\.?\s*COOPER\b|\bFREEDOM MORTGAGE\b|\bROCKET MORTGAGE\b"
    r"|\bCARRINGTON MORTGAGE\b|\bSELENE FINANCE\b|\bUS BANK NATIONAL ASSOC|\bCREDIT UNION\b|SAVINGS BANK"
)


def redemption_end(tracked: Column, published: Column, sale: Column, completed: Column) -> Column:
    """struct(ends, estimated): the tracker's date, else the published one, else a completed sale and 182 days."""
    guess = F.when(completed, F.date_add(sale, DEFAULT_DAYS))
    return F.struct(F.coalesce(tracked, published, guess).alias("ends"), (tracked.isNull() & published.isNull() & guess.isNotNull()).alias("estimated"))


def redemption_state(ends: Column, outcome: Column, tracked: Column, as_of: Column) -> Column:
    """in_redemption, expiring_soon, outcome_pending, resolved or expired; null without a date."""
    left = F.datediff(ends, as_of)
    resolved = F.coalesce(outcome.isin(*RESOLVED), F.lit(False))
    return (
        F.when(tracked & resolved, "resolved")
        .when(ends.isNull(), F.lit(None))
        .when(left < 0, F.when(tracked, "outcome_pending").otherwise("expired"))
        .when(left <= SOON_DAYS, "expiring_soon")
        .otherwise("in_redemption")
    )


def urgency(ends: Column, as_of: Column) -> Column:
    """struct(bucket, days): open windows first, then closed ones, then rows without a window."""
    days = F.datediff(ends, as_of)
    return F.struct(F.when(days >= 0, 0).when(days < 0, 1).otherwise(2).alias("bucket"), days.alias("days"))


def next_check(expiry: Column, as_of: Column) -> Column:
    """The first check day after ``as_of``; null when the ladder is exhausted."""
    return F.coalesce(*[F.when(F.date_add(expiry, d) > as_of, F.date_add(expiry, d)) for d in CHECK_DAYS])


def decide(found: Column, owner: Column, forfeit: Column, last_sale: Column, anchor: Column, expiry: Column, stage: Column, as_of: Column) -> Column:
    """struct(outcome, ambiguous, why, next_check, stage) of one county look-up, the first rule that fits.

    No outcome while a later check is due; ``unknown`` when the ladder is exhausted.
    """
    later = next_check(expiry, as_of)
    top = F.lit(len(CHECK_DAYS))
    lender = F.coalesce(owner.rlike(LENDER_OWNER), F.lit(False))
    forfeited = F.coalesce(F.upper(F.trim(forfeit)).isin("Y", "T", "1"), F.lit(False))
    after = F.coalesce(last_sale > expiry, F.lit(False))
    inside = F.coalesce((last_sale > anchor) & (last_sale <= expiry), F.lit(False))
    why = F.when(~found, "missing").when(lender, "lender_owner").when(forfeited, "forfeit_flag").when(after, "sale_after_expiry").when(inside, "sale_in_window").otherwise("no_signal")
    settled = found & (lender | forfeited | after)
    outcome = F.when(found & (lender | forfeited), "foreclosed").when(found & after, "foreclosed_sold").when(later.isNull(), "unknown")
    doubt = F.when(found & lender, False).when(found & forfeited, True).when(found & after, False).otherwise((found & inside) | later.isNull())
    return F.struct(
        outcome.alias("outcome"),
        doubt.alias("ambiguous"),
        why.alias("why"),
        F.when(~settled, later).alias("next_check"),
        F.when(settled, stage).when(later.isNull(), top).otherwise(F.least(stage + 1, top)).alias("stage"),
    )


def deal_math(emv: Column, debt: Column, state: Column, ratio: Column, low: Column, median: Column, high: Column) -> Column:
    """struct(est_value, band_low, band_high, seller_net, equity_spread) in whole dollars, half to even; null outside an open window."""
    open_ = state.isin("in_redemption", "expiring_soon") & (debt > 0) & (emv > 0) & ratio.isNotNull()
    whole = lambda c: F.bround(c, 0).cast("long")
    est = whole(emv * ratio)
    parts = F.struct(est.alias("est_value"), whole(emv * low).alias("band_low"), whole(emv * high).alias("band_high"), whole(emv * median - debt).alias("seller_net"), whole(est - debt).alias("equity_spread"))
    return F.when(open_, parts)


def vacancy(anchor: Column, as_of: Column, category: Column | None = None) -> Column:
    """struct(years, over_cap, fees, monthly) since registration; ``category`` 1 to 3 picks the other city's rates. Nulls before the start."""
    days = F.datediff(as_of, anchor)
    years = F.when(days >= 0, F.bround(days / 365.25, 1))
    whole = lambda c: F.bround(c, 0).cast("long")
    if category is not None:
        fees = F.when(category == 1, years * CATEGORY_YEAR).when(category == 2, CATEGORY_YEAR + F.greatest(years - 1, F.lit(0.0)) * CATEGORY_YEAR_HIGH).when(category == 3, years * CATEGORY_YEAR_HIGH)
        nothing = F.lit(None)
        return F.struct(years.alias("years"), nothing.cast("boolean").alias("over_cap"), whole(fees).alias("fees"), nothing.cast("long").alias("monthly"))
    over = years >= 2
    start = F.greatest(F.make_date(F.year(anchor) + 2, F.month(anchor), F.least(F.dayofmonth(anchor), F.lit(28))), F.lit(VACANT_MONTH_FROM).cast("date"))
    months = F.greatest(F.lit(0), (F.year(as_of) - F.year(start)) * 12 + F.month(as_of) - F.month(start))
    return F.struct(years.alias("years"), over.alias("over_cap"), whole(years * VACANT_YEAR).alias("fees"), F.when(over, whole(months * VACANT_MONTH)).alias("monthly"))


def second_monday_of_may(year: Column) -> Column:
    return F.date_add(F.next_day(F.make_date(year, F.lit(4), F.lit(30)), "MO"), 7)


def forfeiture_day(first_unpaid_year: Column) -> Column:
    """Judgment on the second Monday of May after the unpaid year, and three years."""
    return F.add_months(second_monday_of_may(first_unpaid_year + 1), 36)


def expiry_of(anchor: Column, county: Column, months: Column) -> Column:
    """struct(expiry, period_source): the county's date, else the stated months, else six months; clamped to a month's last day."""
    source = F.when(county.isNotNull(), "county_stated").when(months > 0, "scraped").otherwise("default_6mo")
    day = F.coalesce(county, F.add_months(anchor, F.when(months > 0, months).otherwise(DEFAULT_MONTHS)))
    return F.struct(day.alias("expiry"), source.alias("period_source"))


def months_between_days(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.datediff(end, start) / 30.44, 0).cast("int"))


def skip_reason(status: Column, sale: Column, months: Column, as_of: Column) -> Column:
    """Why a sale starts no clock; null if it does."""
    return F.when(F.lower(F.trim(status)).isin(*UNHELD), "not_held").when(months == 0, "no_right").when(sale.isNull(), "no_date").when(sale > as_of, "future")


def equity_share_band(value: Column, owed: Column) -> Column:
    share = F.when(value > 0, (value - owed) / value * 100)
    band = F.lit(EQUITY_BEYOND)
    for top, name in reversed(EQUITY_SHARES):
        band = F.when(share <= top, name).otherwise(band)
    return F.when(share.isNotNull(), band)


def equity_band(value: Column) -> Column:
    return F.when(value >= 100_000, "high").when(value >= 40_000, "moderate").when(value > 0, "low")


def timing_band(days: Column) -> Column:
    band = F.lit(TIMING_BEYOND)
    for top, name in reversed(TIMING):
        band = F.when(days <= top, name).otherwise(band)
    return F.when(days >= 0, band)


def value_band(value: Column) -> Column:
    """struct(low, high): a tenth either way, outwards to the next 5,000."""
    low = F.greatest(F.floor(value * (1 - VALUE_HALF) / VALUE_STEP) * VALUE_STEP, F.lit(0)).cast("long")
    return F.when(value > 0, F.struct(low.alias("low"), (F.ceil(value * (1 + VALUE_HALF) / VALUE_STEP) * VALUE_STEP).cast("long").alias("high")))


def centroid(ring: Column) -> Column:
    """struct(x, y) of a closed ring, array<struct<x, y>>: area-weighted.

    A ring without area, or a sliver whose rounding errors throw the centroid out of the
    ring's own box, has the mean of its points.
    """
    n = F.size(ring)
    steps = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    cross = lambda i: F.get(ring, i)["x"] * F.get(ring, i + 1)["y"] - F.get(ring, i + 1)["x"] * F.get(ring, i)["y"]
    total = lambda f: F.aggregate(F.transform(steps, f), F.lit(0.0), lambda a, v: a + v)
    area = total(cross) / 2
    mean = lambda c: F.try_divide(F.aggregate(F.transform(ring, lambda p: p[c].cast("double")), F.lit(0.0), lambda a, v: a + v), n)
    at = lambda c: F.try_divide(total(lambda i: (F.get(ring, i)[c] + F.get(ring, i + 1)[c]) * cross(i)), 6 * area)
    ends = lambda c: (F.array_min(F.transform(ring, lambda p: p[c])), F.array_max(F.transform(ring, lambda p: p[c])))
    whole = F.coalesce((F.abs(area) > 1e-12) & at("x").between(*ends("x")) & at("y").between(*ends("y")), F.lit(False))
    pick = lambda c: F.when(whole, at(c)).otherwise(mean(c))
    return F.struct(pick("x").alias("x"), pick("y").alias("y"))


def in_box(lat: Column, lng: Column) -> Column:
    """Inside the state's bounding box."""
    return F.coalesce(lat.between(43.0, 49.5) & lng.between(-97.5, -89.0), F.lit(False))
