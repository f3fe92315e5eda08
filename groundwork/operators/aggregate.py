"""Statistics over the event feed. Each is one grouped pass with partial aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severity from low to high.
SEVERITIES = ("low", "medium", "high", "critical")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for n, name in enumerate(SEVERITIES, 1):
        rank = F.when(severity == name, n).otherwise(rank)
    return rank


def source_counts(events: DataFrame) -> DataFrame:
    """Events and newest observation of each source and type."""
    return events.groupBy("source", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("observed_at").alias("newest"))


def category_of(source: Column, event_type: Column, categories: Mapping[str, Sequence[tuple[str, str | None]]]) -> Column:
    """array of the categories that a row is in: members are (source, event type or None for any)."""
    hits = [F.when(F.greatest(F.lit(False), *[(source == s) & (F.lit(True) if t is None else event_type == t) for s, t in members]), name) for name, members in categories.items()]
    return F.filter(F.array(*hits), lambda c: c.isNotNull())


def category_totals(counts: DataFrame, categories: Mapping[str, Sequence[tuple[str, str | None]]]) -> DataFrame:
    """Totals of each category from ``source_counts``; a category without rows has zero."""
    named = counts.select(F.explode(category_of(F.col("source"), F.col("event_type"), categories)).alias("category"), "n", "newest")
    found = named.groupBy("category").agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))
    every = counts.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return every.join(found, "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "newest")


def county_pivot(rows: DataFrame, county: str, category: str, categories: Sequence[str]) -> DataFrame:
    """A column of counts for each category, zero where there are none."""
    out = rows.groupBy(county).pivot(category, list(categories)).agg(F.count(F.lit(1)))
    return out.select(county, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(c) for c in categories])


def county_breakdown(counts: DataFrame, source_counties: DataFrame, parcels: DataFrame) -> DataFrame:
    """county, signals, parcels of each county that a source of its own covers and has rows for.

    ``counts``: source, n. ``source_counties``: source, county, slug, a row for each source.
    ``parcels``: county_code, parcels; a county without any has null.
    """
    found = source_counties.join(counts.groupBy("source").agg(F.sum("n").alias("n")).filter("n > 0"), "source")
    signals = found.groupBy("county", "slug").agg(F.sum("n").alias("signals"))
    return signals.join(parcels, F.col("slug") == F.col("county_code"), "left").select("county", "signals", "parcels")


def coverage(breakdown: DataFrame, events: DataFrame, parcels: DataFrame, least: int = 100) -> DataFrame:
    """One row: counties with a source of their own, with any event, with more than ``least`` parcels (fewer are stubs), parcels in all."""
    own = breakdown.agg(F.count(F.lit(1)).alias("counties_covered"))
    seen = events.agg(F.count_distinct("county").alias("counties_with_signals"))
    spine = parcels.agg(F.count_if(F.col("parcels") > least).alias("counties_with_parcels"), F.coalesce(F.sum("parcels"), F.lit(0)).alias("parcels_indexed"))
    all_three = own.unionByName(seen, allowMissingColumns=True).unionByName(spine, allowMissingColumns=True)
    return all_three.agg(*[F.max(c).alias(c) for c in all_three.columns])


#: Flags of an overlay and the families that set them.
OVERLAY_FLAGS = {
    "has_foreclosure": ("sheriff_sale", "foreclosure"),
    "has_tax": ("tax_forfeit", "tax_delinquent", "tax_assessment", "tax_forfeiture_redemption"),
    "has_vacant": ("vacant", "vbr_listing", "boarded_building", "condemned_building"),
    "has_probate": ("probate_filing",),
    "has_violation": ("code_violation",),
}


def overlay(events: DataFrame, keys: Sequence[str], family: str, severity: str, flags: Mapping[str, Sequence[str]] = OVERLAY_FLAGS) -> DataFrame:
    """Signals of each parcel: distinct families, their sorted list, a flag for each kind of family, the highest severity, events."""
    ranked = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.array_sort(F.collect_set(family)).alias("families"),
        F.max(severity_rank(F.col(severity))).alias("__rank"),
    )
    named = F.when(F.col("__rank") > 0, F.get(F.array(*map(F.lit, SEVERITIES)), F.col("__rank") - 1))
    marks = [F.arrays_overlap("families", F.array(*map(F.lit, members))).alias(name) for name, members in flags.items()]
    return ranked.select(*keys, "n_events", F.size("families").alias("signal_count"), "families", *marks, named.alias("max_severity"))


def owner_portfolios(rows: DataFrame, owner: str, parcel: str, absentee: str, family: str) -> DataFrame:
    """Parcels, events, families of each owner name in upper case; blank names are left out."""
    name = F.upper(F.trim(F.col(owner)))
    return (
        rows.withColumn("owner_norm", name)
        .filter(name != "")
        .groupBy("owner_norm")
        .agg(F.count_distinct(parcel).alias("parcel_count"), F.count(F.lit(1)).alias("event_count"), F.coalesce(F.bool_or(absentee), F.lit(False)).alias("any_absentee"), F.array_sort(F.collect_set(family)).alias("families"))
    )


def differentiators(signals: DataFrame, portfolios: DataFrame) -> DataFrame:
    """One row: parcels with two and with three or more signals, owners with two or more parcels."""
    a, b = signals.select("signal_count", F.lit(0).alias("parcel_count")), portfolios.select(F.lit(0).alias("signal_count"), "parcel_count")
    return a.unionByName(b).agg(
        F.count_if(F.col("signal_count") >= 2).alias("multi_signal"),
        F.count_if(F.col("signal_count") >= 3).alias("triple_signal"),
        F.count_if(F.col("parcel_count") >= 2).alias("multi_parcel_owners"),
    )


def percentile_bands(sales: DataFrame, keys: Sequence[str], share: str, days: str, least: int = 15) -> DataFrame:
    """n, p25, median, p75, mean days of each group, exact and interpolated; groups below ``least`` sales are left out.

    Equal values are one row with a count first; running sums of the counts give each value its
    places in the order, and a percentile lies between the values at two places. No group is
    held in one buffer.
    """
    counted = sales.groupBy(*keys, share).agg(F.count(share).alias("__n"), F.sum(days).alias("__days"), F.count(days).alias("__dated"))
    order = Window.partitionBy(*keys).orderBy(F.col(share).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("__upto", F.sum("__n").over(order))
    sizes = counted.groupBy(*keys).agg(F.sum("__n").alias("n"), (F.sum("__days") / F.sum("__dated")).alias("avg_days")).filter(F.col("n") >= least)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}"))
    both = placed.alias("p").join(sizes.alias("s"), on).select(*[F.col(f"s.{k}").alias(k) for k in keys], "n", "avg_days", F.col(f"p.{share}").alias("__v"), "__upto")
    place = lambda q: (F.col("n") - 1) * F.lit(q)
    ends = [F.min(F.when(F.col("__upto") > edge(place(q)), F.col("__v"))).alias(f"__{side}{k}") for k, q in enumerate((0.25, 0.5, 0.75)) for side, edge in (("low", F.floor), ("high", F.ceil))]
    out = both.groupBy(*keys, "n", "avg_days").agg(*ends)
    weighed = lambda k, q: (F.ceil(place(q)) - place(q)) * F.col(f"__low{k}") + (place(q) - F.floor(place(q))) * F.col(f"__high{k}")
    between = lambda k, q: F.when(F.ceil(place(q)) == F.floor(place(q)), F.col(f"__low{k}")).otherwise(weighed(k, q))
    return out.select(*keys, "n", between(0, 0.25).alias("p25"), between(1, 0.5).alias("median"), between(2, 0.75).alias("p75"), "avg_days")


def value_density(parcels: DataFrame, keys: Sequence[str], value: str, width: int = 50_000, least: int = 5) -> DataFrame:
    """Parcels in each value bucket; ``dense`` where there are enough to hide one."""
    out = parcels.filter(F.col(value) > 0).groupBy(*keys, F.floor(F.col(value) / width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("dense", F.col("n") >= least)


def latest_value(events: DataFrame, keys: Sequence[str], date: str, value: str, tie: str) -> DataFrame:
    """``value`` of the latest dated row of each key, undated rows last, ties to the smaller ``tie``."""
    order = F.struct(F.col(date).isNotNull().alias("dated"), F.col(date).alias("date"), (-F.col(tie)).alias("tie"))
    return events.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(date).alias(date))


def delinquency(details: DataFrame, keys: Sequence[str], year: str, due: str, paid: str, last_paid: str, current_year: Column) -> DataFrame:
    """First unpaid year, unpaid years, what is owed, the last payment and the current cycle of each parcel."""
    by_year = details.groupBy(*keys, year).agg(F.sum(due).alias("__due"), F.sum(paid).alias("__paid"), F.max(last_paid).alias("__last"))
    owed = F.col("__due") - F.coalesce("__paid", F.lit(0))
    unpaid = owed > 0
    return by_year.groupBy(*keys).agg(
        F.min(F.when(unpaid, F.col(year))).alias("first_unpaid_year"),
        F.count_if(unpaid).alias("unpaid_years"),
        F.coalesce(F.sum(F.when(unpaid, owed)), F.lit(0)).alias("total_owed"),
        F.max("__last").alias("last_payment"),
        F.coalesce(F.sum(F.when(F.col(year) == current_year, F.col("__due"))), F.lit(0)).alias("current_due"),
    )


def redemption_stats(rows: DataFrame, state: str, outcome: str) -> DataFrame:
    """Counts of windows by state and outcome, and the resolved share in per cent, one row."""
    s, o = F.col(state), F.col(outcome)
    counts = {
        "total": F.count(F.lit(1)),
        "in_redemption": F.count_if(s == "in_redemption"),
        "expiring_soon": F.count_if(s == "expiring_soon"),
        "outcome_pending": F.count_if(s == "outcome_pending"),
        "resolved": F.count_if(s == "resolved"),
        "redeemed": F.count_if(o.isin("redeemed_by_owner", "redeemed_by_junior")),
        "foreclosed": F.count_if(o == "foreclosed"),
        "sold": F.count_if(o == "foreclosed_sold"),
    }
    out = rows.agg(*[c.alias(k) for k, c in counts.items()])
    return out.withColumn("resolved_pct", F.bround(F.try_divide(F.col("resolved") * 100.0, F.col("total")), 1))


def keyset_page(rows: DataFrame, key: str, after: Column | None, n: int) -> DataFrame:
    """The next ``n`` rows in key order after a cursor."""
    return (rows if after is None else rows.filter(F.col(key) > after)).orderBy(key).limit(n)


def sample_per_group(rows: DataFrame, group: str, key: Column, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each group by a seeded hash of ``key``: the same ones every time. Partial top-n first, so that a hot group is no single task."""
    from pyspark.sql import Window

    draw = rows.withColumn("__h", F.xxhash64(F.lit(seed), key)).withColumn("__salt", F.pmod(F.col("__h"), F.lit(64)))
    order = [F.col("__h"), key]
    some = draw.withColumn("__n", F.row_number().over(Window.partitionBy(group, "__salt").orderBy(*order))).filter(F.col("__n") <= n)
    return some.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__n") <= n).drop("__h", "__salt", "__n")
