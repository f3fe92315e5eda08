"""Joins that find a row's parcel, and lookups with fallbacks. An ambiguous match is no match."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_index(spine: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """keys, target, n_targets: one row of each key; the target only where it is the only one."""
    spine = spine.filter(F.col(target).isNotNull())
    found = spine.filter(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)) == F.lit(False)).groupBy(*keys).agg(F.min(target).alias("__low"), F.max(target).alias("__high"))
    one = F.col("__low") == F.col("__high")
    return found.select(*keys, F.when(one, F.col("__low")).alias(target), F.when(one, 1).otherwise(2).alias("n_targets"))


def resolve_unique(rows: DataFrame, spine: DataFrame, keys: Sequence[str], target: str, status: str = "status") -> DataFrame:
    """``target`` and match / ambiguous / none of each row. Minimum and maximum stand for a distinct count, so the index is one partial aggregate."""
    index = unique_index(spine, keys, target).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(target), "n_targets")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    said = F.when(F.col("n_targets") == 1, "match").when(F.col("n_targets") > 1, "ambiguous").otherwise("none")
    return rows.join(index, on, "left").withColumn(status, said).drop("n_targets", *[f"__{k}" for k in keys])


def resolve_ladder(rows: DataFrame, spine: DataFrame, steps: Sequence[Sequence[str]], target: str) -> DataFrame:
    """Tries the keys of each step in turn: a miss goes on to the next step, ambiguity stops. ``how`` is the step that decided."""
    out, made = rows, []
    for n, keys in enumerate(steps):
        out = resolve_unique(out, spine, keys, f"{target}", status=f"__s{n}").withColumnRenamed(target, f"__t{n}")
        made += [f"__s{n}", f"__t{n}"]
    status, found, how = F.lit("none"), F.lit(None), F.lit(None).cast("int")
    for n in reversed(range(len(steps))):
        decided = F.col(f"__s{n}") != "none"
        status, found, how = F.when(decided, F.col(f"__s{n}")).otherwise(status), F.when(decided, F.col(f"__t{n}")).otherwise(found), F.when(decided, n + 1).otherwise(how)
    return out.withColumns({"status": status, target: found, "how": how}).drop(*made)


EARTH_M = 6_371_000.0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two points."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Degrees from north, 0 to 360, of the second point seen from the first."""
    d = F.radians(lng2 - lng1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def within_radius(left: DataFrame, right: DataFrame, metres: float, left_at: tuple[str, str] = ("lat", "lng"), right_at: tuple[str, str] = ("lat2", "lng2")) -> DataFrame:
    """Pairs of rows up to ``metres`` apart, with the distance ``metres_apart``.

    Latitude bands are ``metres`` high; each is cut into as many cells as are wide enough at
    the latitude nearest a pole of it and its neighbours (one cell at the poles), counted
    around the globe, so the 180th meridian is no border. Only the right side is copied, to
    the cells around its own, and the join is an equi-join on band and cell. Rows
    without a position have no pair.
    """
    high = math.degrees(metres / EARTH_M) * 1.0001

    def cells(band: Column) -> Column:
        edge = F.least(F.greatest(F.abs((band - 1) * high - 90), F.abs((band + 2) * high - 90)), F.lit(90.0))
        wide = F.degrees(2 * F.asin(F.least(F.lit(1.0), math.sin(min(metres / EARTH_M, math.pi) / 2) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))))) * 1.0001
        return F.greatest(F.floor(360 / wide), F.lit(1)).cast("long")

    band_of = lambda lat: F.floor((F.col(lat) + 90) / high)
    place = lambda lng, n: F.pmod(F.floor((F.col(lng) + 180) / 360 * n), n)
    a = left.withColumn("__y", band_of(left_at[0])).withColumn("__x", place(left_at[1], cells(F.col("__y"))))
    b = right.withColumn("__by", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: band_of(right_at[0]) + d))).withColumn("__n", cells(F.col("__by")))
    around = F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.pmod(place(right_at[1], F.col("__n")) + d, F.col("__n"))))
    b = b.withColumn("__bx", F.explode(around)).drop("__n")
    apart = haversine(F.col(left_at[0]), F.col(left_at[1]), F.col(right_at[0]), F.col(right_at[1]))
    pairs = a.join(b, (F.col("__y") == F.col("__by")) & (F.col("__x") == F.col("__bx"))).withColumn("metres_apart", apart)
    return pairs.filter(F.col("metres_apart") <= metres).drop("__x", "__y", "__bx", "__by")


def package_members(rows: DataFrame, pids: Column) -> DataFrame:
    """One row for each parcel number of a list, with its place from 1; rows without a number stay, with null."""
    return rows.select("*", F.posexplode_outer(pids).alias("__pos", "pid")).withColumn("place", F.col("__pos") + 1).drop("__pos")


def name_candidates(people: DataFrame, owners: DataFrame, name: str, owner: str, agree: Column) -> DataFrame:
    """Pairs whose owner holds the person's last word, checked by ``agree``: a join on words, not on every pair."""
    words = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, r"[^A-Za-z ]", " ")), r"\s+"), lambda w: w != "")
    a = people.withColumn("__last", F.try_element_at(words(F.col(name)), F.lit(-1)))
    b = owners.withColumn("__word", F.explode(F.array_distinct(words(F.col(owner)))))
    return a.join(b, F.col("__last") == F.col("__word")).filter(agree).drop("__last", "__word")


def exact_or_latest(rows: DataFrame, tracker: DataFrame, keys: Sequence[str], date: str, anchor: str, value: str) -> DataFrame:
    """``value`` of the tracker row of the same keys and date, else of the latest anchor of the keys; ``found`` says which."""
    exact = tracker.groupBy(*keys, anchor).agg(F.max(value).alias("__exact"), F.lit(True).alias("__is"))
    latest = tracker.groupBy(*keys).agg(F.max_by(value, F.struct(F.col(anchor), F.col(value))).alias("__latest"), F.lit(True).alias("__any"))
    renamed = lambda df, tag, cols: df.select(*[F.col(c).alias(f"{tag}{c}") for c in cols], *[c for c in df.columns if c not in cols])
    e, late = renamed(exact, "__e_", [*keys, anchor]), renamed(latest, "__l_", keys)
    on_e, on_l = F.col(date) == F.col(f"__e_{anchor}"), F.lit(True)
    for k in keys:
        on_e, on_l = on_e & (F.col(k) == F.col(f"__e_{k}")), on_l & (F.col(k) == F.col(f"__l_{k}"))
    out = rows.join(e, on_e, "left").join(late, on_l, "left")
    found = F.when(F.col("__is"), "exact").when(F.col("__any"), "latest").otherwise("none")
    return out.withColumn("found", found).withColumn(value, F.when(F.col("__is"), F.col("__exact")).otherwise(F.col("__latest"))).select(*rows.columns, "found", value)


def scoped(rows: DataFrame, levels: Sequence[tuple[str, DataFrame, Sequence[str]]], value: str) -> DataFrame:
    """``value`` of the narrowest level that has one: each level is (name, table unique in its keys, keys); ``scope`` is its name.

    A level without keys is one value for all rows: the largest of its table, a scalar subquery.
    """
    out, names = rows, []
    for n, (name, data, keys) in enumerate(levels):
        if not keys:
            out = out.withColumn(f"__v{n}", data.agg(F.max(value).alias("m")).scalar())
            names.append(name)
            continue
        data = data.select(*[F.col(k).alias(f"__{n}_{k}") for k in keys], F.col(value).alias(f"__v{n}"))
        on = F.lit(True)
        for k in keys:
            on = on & (F.col(k) == F.col(f"__{n}_{k}"))
        out = out.join(data, on, "left")
        names.append(name)
    scope = F.lit(None).cast("string")
    for n, name in reversed(list(enumerate(names))):
        scope = F.when(F.col(f"__v{n}").isNotNull(), name).otherwise(scope)
    return out.withColumn(value, F.coalesce(*[F.col(f"__v{n}") for n in range(len(names))])).withColumn("scope", scope).select(*rows.columns, value, "scope")


def best_per_key(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in ``order``; rows without a key all stay. Null keys are spread, not gathered."""
    group = Window.partitionBy(key).orderBy(*order)
    kept = rows.filter(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(group)).filter("__n = 1").drop("__n")
    return kept.unionByName(rows.filter(F.col(key).isNull()))
