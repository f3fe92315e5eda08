"""Data-quality findings, freshness and run health."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Freshness and staleness.
FRESH_DAYS, FRESH_TIMES = 60, 3
STALE_DAYS, STALE_TIMES = 2.0, 1.5
MINOR_DROP, REVIEW_DAYS = 0.05, 45


def findings(checks: Sequence[tuple[str, DataFrame, int, int]]) -> DataFrame:
    """check, n, severity, rank: each check is (name, offending rows, threshold of medium, of high); zero is ok. Worst first."""
    parts = []
    for place, (name, rows, medium, high) in enumerate(checks):
        n = F.col("n")
        severity = F.when(n == 0, "ok").when(n >= high, "high").when(n >= medium, "medium").otherwise("low")
        parts.append(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n", severity.alias("severity"), F.lit(place).alias("place")))
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).when(F.col("severity") == "low", 2).otherwise(3)
    return reduce(DataFrame.unionByName, parts).withColumn("rank", order)


def orphans(rows: DataFrame, spine: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows whose (row column, spine column) keys are set and not in the spine."""
    on, there = F.lit(True), F.lit(True)
    for a, b in keys:
        on, there = on & (F.col(f"r.{a}") == F.col(f"s.{b}")), there & F.col(a).isNotNull()
    return rows.filter(there).alias("r").join(spine.select(*[b for _, b in keys]).alias("s"), on, "left_anti")


def repeated(rows: DataFrame, keys: Sequence[str], what: str, values: bool = False) -> DataFrame:
    """Keys with several values of ``what``, with the least and the greatest; with ``values`` also all of them, sorted.

    Keys with one value are out before any list is made, so a list holds repeats only.
    """
    found = rows.groupBy(*keys).agg(F.min(what).alias("least"), F.max(what).alias("greatest")).filter(F.col("least") < F.col("greatest"))
    if not values:
        return found
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(F.col(f"__{k}"))
    few = found.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return rows.join(few, on).groupBy(*keys).agg(F.array_sort(F.collect_set(what)).alias("values"))


def silent_sources(events: DataFrame, as_of: Column, interval: str) -> DataFrame:
    """Sources without an event for three intervals (60 days at least)."""
    out = events.groupBy("source").agg(F.max("observed_at").alias("newest"), F.max(interval).alias("every"))
    return out.withColumn("days", F.datediff(as_of, F.to_date("newest"))).filter(F.col("days") > F.greatest(F.lit(FRESH_DAYS), F.col("every") * FRESH_TIMES))


def freshness(semantics: Column, newest: Column, interval: Column, last_event: Column, as_of: Column) -> Column:
    """fresh, frozen, exempt, unjudged or unknown: does the source's own date still move?"""
    limit = F.greatest(F.lit(FRESH_DAYS), interval * FRESH_TIMES)
    age, event_age = F.datediff(as_of, newest), F.datediff(as_of, last_event)
    return (
        F.when(F.lower(F.trim(semantics)).isin("semantic", "none"), "exempt")
        .when(newest.isNull(), "unknown")
        .when(newest > as_of, "fresh")
        .when(interval.isNull() | (interval <= 0), "unjudged")
        .when((age > limit) & ~F.coalesce(event_age <= limit, F.lit(False)), "frozen")
        .otherwise("fresh")
    )


def dropped(notes: Column) -> Column:
    part = lambda k: F.regexp_replace(F.regexp_extract(F.lower(notes), r"([0-9][0-9,]*)\s+of\s+([0-9][0-9,]*)\s+records failed", k), ",", "").try_cast("double")
    return F.try_divide(part(1), F.greatest(part(2), F.lit(1.0)))


def health(last_ok: Column, last_fail: Column, failures: Column, notes: Column, interval: Column, as_of: Column) -> Column:
    """shelved, broken, check, unscheduled, unscheduled_review, stale or healthy, the first that fits.

    Notes stay after a recovery, so they count as a failure only while the last run failed.
    """
    low = F.lower(F.trim(F.coalesce(notes, F.lit(""))))
    share = dropped(low)
    failed_now = F.coalesce(last_fail > last_ok, F.lit(False))
    small = F.coalesce(share <= MINOR_DROP, F.lit(False))
    total = low.startswith("all ") & low.contains("failed")
    left_over = total | low.contains("validationerror") | low.contains("literal_error") | F.coalesce(share > MINOR_DROP, F.lit(False))
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(last_ok)) / 86_400
    cadence = F.coalesce(interval > 0, F.lit(False))
    return (
        F.when(low.startswith("shelved"), "shelved")
        .when(last_ok.isNull() | (F.coalesce(failures, F.lit(0)) > 0), "broken")
        .when(failed_now, F.when(small & ~total, "check").otherwise("broken"))
        .when(left_over, "check")
        .when(~cadence, F.when(age > REVIEW_DAYS, "unscheduled_review").otherwise("unscheduled"))
        .when(age > F.greatest(F.lit(STALE_DAYS), interval * STALE_TIMES), "stale")
        .otherwise("healthy")
    )


def run_status(processed: Column, failed: Column) -> Column:
    """failed if every record failed, partial if more than one in twenty did, else success."""
    return F.when((processed > 0) & (failed >= processed), "failed").when(failed > MINOR_DROP * processed, "partial").otherwise("success")
