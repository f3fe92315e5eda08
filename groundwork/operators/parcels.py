"""Parcel rows: assessor figures, fill-only enrichment, absentee rules, imagery states, notice pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.coerce import plausible_year, positive, square_feet
from groundwork.operators.derive import in_box

# How far from a camera a building and bare land may lie, and the lot size from which a parcel counts as land.
NEAR_M, NEAR_LAND_M, LAND_SQFT = 60, 200, 87_120
# Pieces of a long notice.
LEAST_PIECE, MOST_PIECE = 400, 7_000


def assessor_row(land: Column, building: Column, total: Column, acres: Column, year_built: Column, lat: Column, lng: Column, as_of: Column) -> Column:
    """struct(emv_total, lot_sqft, year_built, lat, lng): zero is no value, the parts stand in for a missing total, points outside the box are dropped."""
    parts = F.when(land.isNotNull() | building.isNotNull(), F.coalesce(land, F.lit(0)) + F.coalesce(building, F.lit(0)))
    inside = in_box(lat, lng)
    return F.struct(
        F.coalesce(positive(total), positive(parts)).alias("emv_total"),
        F.round(square_feet(acres)).cast("long").alias("lot_sqft"),
        plausible_year(year_built, as_of).alias("year_built"),
        F.when(inside, lat).alias("lat"),
        F.when(inside, lng).alias("lng"),
    )


def fill_only(rows: DataFrame, found: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns`` of rows filled from ``found`` (unique in its keys) where they are null; nothing is overwritten."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}"))
    joined = rows.alias("r").join(found.alias("f"), on, "left")
    return joined.select(*[F.coalesce(f"r.{c}", f"f.{c}").alias(c) if c in columns else F.col(f"r.{c}") for c in rows.columns])


def cleaned_raw(values: dict[str, Column]) -> Column:
    """JSON of the values that are neither null nor blank."""
    kept = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[c.cast("string") for c in values.values()])), lambda _, v: v.isNotNull() & (F.trim(v) != ""))
    return F.to_json(kept)


def absentee(homestead: Column, owner_street: Column, street: Column, unknown: bool | None = None) -> Column:
    """A homestead is lived in; else another street is absentee; without both streets ``unknown``."""
    differ = F.upper(F.trim(owner_street)) != F.upper(F.trim(street))
    return F.when(F.upper(F.trim(homestead)).isin("Y", "YES", "1"), False).otherwise(F.coalesce(differ, F.lit(unknown).cast("boolean")))


def near_camera(metres: Column, lot_sqft: Column, has_building: Column) -> Column:
    """Is a picture taken so far away still one of this parcel?"""
    limit = F.when(~has_building & (lot_sqft >= LAND_SQFT), NEAR_LAND_M).otherwise(NEAR_M)
    return F.coalesce(metres <= limit, F.lit(False))


def imagery_status(located: Column, answer: Column, near: Column, blocked: Column) -> Column:
    """no_location, policy_blocked, error, none, too_far or ok, the first that fits."""
    return F.when(~located, "no_location").when(blocked, "policy_blocked").when(answer == "error", "error").when(answer.isNull() | (answer == "zero"), "none").when(~near, "too_far").otherwise("ok")


def to_resolve(parcels: DataFrame, imagery: DataFrame, keys: Sequence[str], policy: str) -> DataFrame:
    """Parcels whose picture has not been looked up, or under another policy than today's."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"p.{k}").eqNullSafe(F.col(f"i.{k}"))
    done = imagery.filter(F.col("policy").eqNullSafe(F.lit(policy)))
    return parcels.alias("p").join(done.select(*keys).alias("i"), on, "left_anti")


def notice_kind(text: Column) -> Column:
    """Which markers a notice has more of; a tie or none is other."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda *ws: F.size(F.filter(F.array(*map(F.lit, ws)), lambda w: low.contains(w)))
    sale = count("mortgage foreclosure", "sheriff", "mortgagor", "power of sale")
    tax = count("delinquent tax", "forfeit", "expiration of redemption", "county auditor")
    return F.when(sale > tax, "foreclosure").when(tax > sale, "tax_forfeit").otherwise("other")


def split_text(text: str | None, heading: str, least: int = LEAST_PIECE, most: int = MOST_PIECE) -> list[str]:
    """Pieces of a text, cut before headings where a piece has ``least`` signs, and at white space where it has ``most``; together they are the text."""
    if not text:
        return []
    seams, start = [], 0
    for m in re.finditer(heading, text):
        if m.start() - start >= least:
            seams.append(m.start())
            start = m.start()
    out = []
    for a, b in zip([0, *seams], [*seams, len(text)]):
        while b - a > most:
            cut = max(text.rfind(" ", a + 1, a + most), text.rfind("\n", a + 1, a + most))
            cut = cut + 1 if cut > a else a + most
            out.append(text[a:cut])
            a = cut
        out.append(text[a:b])
    return out


def notice_pieces(rows: DataFrame, text: str, carry: Sequence[str], heading: str, least: int = LEAST_PIECE, most: int = MOST_PIECE) -> DataFrame:
    """``carry``, piece_no, piece: whole texts in pieces; null and empty texts have none."""
    width = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [split_text(t, heading, least, most) for t in batch.column(width).to_pylist()]
            take = pa.array([i for i, ps in enumerate(made) for _ in ps], pa.int32())
            numbers, pieces = pa.array([n for ps in made for n in range(len(ps))], pa.int32()), pa.array([p for ps in made for p in ps], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(width)), numbers, pieces], names=[*carry, "piece_no", "piece"])

    picked = rows.select(*carry, F.col(text).cast("string"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{head}, piece_no int, piece string")


def without_placeholders(rows: DataFrame, keys: Sequence[str], date: str, placeholder: Column, as_of: Column) -> DataFrame:
    """Placeholder dates are null, unless a row of the same keys is undated already: then the row goes. Future years are a century early."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"u.{k}"))
    undated = rows.filter(F.col(date).isNull()).select(*keys).distinct()
    marked = rows.withColumn("__placeholder", F.coalesce(placeholder, F.lit(False)))
    kept = marked.alias("r").join(undated.alias("u"), on & F.col("r.__placeholder"), "left_anti")
    honest = F.when(~F.col("__placeholder"), F.when(F.col(date) > as_of, F.add_months(date, -1200)).otherwise(F.col(date)))
    return kept.withColumn(date, honest).drop("__placeholder")
