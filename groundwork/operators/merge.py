"""Writers as plans: deduplicated inserts, upserts, field merges, ownership history, snapshots.

Keys compare null-safely throughout: a null key equals a null key. Every function takes
the stored rows and the incoming rows and returns what to store, so a job writes it to a
new location and swaps, or hands it to a sink with its own merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_key(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of ``keys`` between two aliased frames."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in ``order``; null keys are a key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def dedup_insert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The incoming rows whose key is not stored, one of each key. A second run inserts nothing."""
    fresh = incoming.alias("n").join(stored.select(*keys).alias("o"), same_key("n", "o", keys), "left_anti")
    return newest(fresh, keys, order)


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Incoming rows replace stored rows of their key; of several the first in ``order`` counts."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    return newest(both, keys, [F.col("__new").desc(), *order]).drop("__new")


def missing(value: Column, kind: str) -> Column:
    """Null, blank text and zero count as not filled."""
    if kind == "string":
        return value.isNull() | (value == "")
    if kind in ("boolean", "date", "timestamp") or kind.startswith(("array", "struct", "map")):
        return value.isNull()
    return value.isNull() | (value == 0)


def field_merge(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], overwrite: Sequence[str] = (), union: Sequence[str] = (), owned: Sequence[str] = ()) -> DataFrame:
    """Rows of both sides, merged field by field.

    ``owned`` columns take the incoming value even if it is null (a full refresh),
    ``overwrite`` columns take it if it is not null, ``union`` columns are sorted array
    unions; every other column is only filled where the stored value is missing.
    Both sides must be unique in ``keys``.
    """
    kinds = dict(stored.dtypes)
    both = stored.withColumn("__had", F.lit(True)).alias("o").join(incoming.withColumn("__has", F.lit(True)).alias("n"), same_key("o", "n", keys), "full_outer")

    def merged(c: str) -> Column:
        old, new = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys or c not in incoming.columns:
            return F.when(F.col("__had"), old).otherwise(new) if c in incoming.columns else old
        if c in owned:
            return F.when(F.col("__has"), new).otherwise(old)
        if c in overwrite:
            return F.coalesce(new, old)
        if c in union:
            empty = F.array().cast(kinds[c])
            return F.array_sort(F.array_union(F.coalesce(old, empty), F.coalesce(new, empty)))
        return F.when(missing(old, kinds[c]), F.coalesce(new, old)).otherwise(old)

    return both.select(*[merged(c).alias(c) for c in stored.columns])


def ownership_history(observed: DataFrame, parcel: Sequence[str], owner_fields: Sequence[str], start: str) -> DataFrame:
    """Periods of ownership: parcel, owner fields, start, end date, is_current.

    A change is a change of the letters and digits of the owner fields; cosmetic ones are
    none. A period ends on the day the next one starts.
    """
    key = F.regexp_replace(F.lower(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in owner_fields])), r"[^a-z0-9|]", "")
    order = Window.partitionBy(*parcel).orderBy(start, "__key")
    seen = observed.withColumn("__key", key)
    changed = F.lag("__key").over(order)
    starts = seen.withColumn("__before", changed).filter(~F.col("__key").eqNullSafe(F.col("__before")))
    ends = F.lead(start).over(order)
    return starts.withColumn("end_date", ends).withColumn("is_current", F.col("end_date").isNull()).drop("__key", "__before")


def absentee_flags(mail_city: Column, mail_state: Column, city: Column, state: Column) -> tuple[Column, Column]:
    """(absentee, out of state): another city is absentee; another state alone is absentee too."""
    out = F.upper(F.trim(mail_state)) != F.upper(F.trim(state))
    away = F.lower(F.trim(mail_city)) != F.lower(F.trim(city))
    return F.when(away.isNull() & out, True).otherwise(away), out


#: A snapshot must have parsed this share of what it fetched to retire anything.
LEAST_PARSED = 0.95


def snapshot_complete(fetched: Column, parsed: Column, capped: Column) -> Column:
    return ~capped & (fetched > 0) & (parsed >= LEAST_PARSED * fetched)


def reconcile_snapshot(registry: DataFrame, snapshot: DataFrame, keys: Sequence[str], complete: bool, misses: int = 3) -> DataFrame:
    """The registry (keys, is_active, consecutive_misses) after a snapshot.

    Present rows are active with no misses; absent ones count a miss and are inactive from
    ``misses`` on. An incomplete snapshot retires nothing and counts no miss.
    """
    seen = snapshot.select(*keys).distinct().withColumn("__seen", F.lit(True))
    rows = registry.alias("o").join(seen.alias("n"), same_key("o", "n", keys), "left")
    here = F.coalesce(F.col("__seen"), F.lit(False))
    count = F.when(here, 0).otherwise(F.col("o.consecutive_misses") + (1 if complete else 0))
    active = F.when(here, True).when(count >= misses, False).otherwise(F.col("o.is_active"))
    values = {"consecutive_misses": count, "is_active": active}
    return rows.select(*[values.get(c, F.col(f"o.{c}")).alias(c) for c in registry.columns])


def retire_stale(stored: DataFrame, forfeit_now: DataFrame, delinquent_now: DataFrame, key: str, least_mined: int = 100, most_retired: int = 2_000) -> DataFrame:
    """``key``, kind, retired_as of stored rows (kind forfeit or delinquent) that today's lists no longer back.

    A delinquent that is now forfeited is ``forfeited``, one on no list ``cured``; a
    forfeit on no list is ``source_removed``. With too few mined rows or too many
    retirements nothing is retired: the lists are then suspect, not the rows. The two
    counts behind this guard are scalar subqueries of the same plan.
    """
    f = forfeit_now.select(F.col(key).alias("__f")).distinct()
    d = delinquent_now.select(F.col(key).alias("__d")).distinct()
    marked = stored.join(f, F.col(key) == F.col("__f"), "left").join(d, F.col(key) == F.col("__d"), "left")
    forfeited, listed = F.col("__f").isNotNull(), F.col("__f").isNotNull() | F.col("__d").isNotNull()
    how = F.when((F.col("kind") == "delinquent") & forfeited, "forfeited").when((F.col("kind") == "delinquent") & ~listed, "cured").when((F.col("kind") == "forfeit") & ~listed, "source_removed")
    out = marked.select(key, "kind", how.alias("retired_as")).filter("retired_as is not null")
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return out.filter((count(f.union(d).distinct()) >= least_mined) & (count(out) <= most_retired))


def collapse_cases(rows: DataFrame, case: str, date: str, rank: Column, tie: str) -> DataFrame:
    """The row of each case with the latest date, then the highest rank, then the smaller ``tie``; undated rows lose."""
    return newest(rows.withColumn("__r", rank), [case], [F.col(date).desc_nulls_last(), F.col("__r").desc_nulls_last(), F.col(tie)]).drop("__r")


def merge_duplicates(rows: DataFrame, same: Sequence[str], stub: Column, carry: str, order: Sequence[Column]) -> DataFrame:
    """Stubs with a real twin (equal in ``same``) go; the twin takes over ``carry`` where it has none."""
    marked = rows.withColumn("__stub", stub)
    w = Window.partitionBy(*same)
    lent = F.max(F.when(F.col("__stub"), F.col(carry))).over(w)
    real = F.max(F.when(~F.col("__stub"), 1).otherwise(0)).over(w) == 1
    out = marked.withColumn("__real", real).withColumn("__lent", lent)
    out = out.filter(~(F.col("__stub") & F.col("__real")))
    first = F.row_number().over(w.orderBy(*order)) == 1
    return out.withColumn(carry, F.when(~F.col("__stub") & first, F.coalesce(carry, "__lent")).otherwise(F.col(carry))).drop("__stub", "__real", "__lent")


def upsert_tracker(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deadline rows: a scraped period is never replaced by a default one, and the next check never moves back."""
    both = stored.withColumn("__had", F.lit(True)).alias("o").join(incoming.withColumn("__has", F.lit(True)).alias("n"), same_key("o", "n", keys), "full_outer")
    weaker = F.coalesce((F.col("o.period_source") == "scraped") & (F.col("n.period_source") == "default_6mo"), F.lit(False))
    new = F.col("__has").isNotNull() & ~weaker

    def pick(c: str) -> Column:
        if c in keys:
            return F.when(F.col("__had"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        if c == "next_check":
            return F.greatest(f"o.{c}", f"n.{c}")
        return F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*[pick(c).alias(c) for c in stored.columns])


def postpone(sales: DataFrame, notices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A strictly later date in a notice moves the sale and counts one postponement."""
    latest = notices.groupBy(*keys).agg(F.max("sale_date").alias("__date"))
    rows = sales.alias("o").join(latest.alias("n"), same_key("o", "n", keys), "left")
    later = F.coalesce(F.col("__date") > F.col("o.sale_date"), F.lit(False))
    values = {"sale_date": F.when(later, F.col("__date")).otherwise(F.col("o.sale_date")), "postponement_count": F.col("o.postponement_count") + later.cast("int")}
    return rows.select(*[values.get(c, F.col(f"o.{c}")).alias(c) for c in sales.columns])
