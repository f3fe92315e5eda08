"""Typed signals as rows of the one event feed. Dates are true dates or null, never the day of the scrape."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEED = ("source", "source_id", "county", "parcel_id", "event_type", "event_subtype", "event_date", "event_value", "severity", "title", "description", "raw", "observed_at")


def to_feed(rows: DataFrame, **columns: Column) -> DataFrame:
    """A projection onto the feed; columns that are not named are null."""
    return rows.select(*[columns.get(c, F.lit(None).cast(KINDS[c])).cast(KINDS[c]).alias(c) for c in FEED])


KINDS = {**{c: "string" for c in FEED}, "event_date": "date", "event_value": "decimal(18,2)", "observed_at": "timestamp"}


def fill_county(events: DataFrame, source_counties: Mapping[str, str], slug: Column) -> DataFrame:
    """County from the row, else from its source's fixed county, else from ``slug``; unknown stays null. A map in the plan, as a join would shuffle all rows by a few sources."""
    known = F.create_map(*[x for pair in source_counties.items() for x in map(F.lit, pair)])
    return events.withColumn("county", F.coalesce("county", F.element_at(known, F.col("source")), slug))


def _said(value: Column, otherwise: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(otherwise))


def violation_events(v: DataFrame) -> DataFrame:
    """Code violations; a severity that is not known is medium."""
    return to_feed(v, source=F.col("source"), source_id=F.col("source_id"), county=F.col("county"), parcel_id=F.col("parcel_id"), event_type=F.lit("code_violation"), event_subtype=F.col("violation_type"), event_date=F.col("violation_date"), event_value=F.col("fine"), severity=F.coalesce("severity", F.lit("medium")), title=F.concat(F.lit("Code violation: "), _said(F.col("violation_type"), "unspecified")), description=F.col("violation_description"), raw=F.col("raw"), observed_at=F.col("observed_at"))


def sale_events(s: DataFrame) -> DataFrame:
    """Sheriff sales; the parties are told if either of them is known, an unknown one as None."""
    known = (F.coalesce(F.col("plaintiff"), F.lit("")) != "") | (F.coalesce(F.col("defendant"), F.lit("")) != "")
    parties = F.concat(F.lit("Plaintiff: "), F.coalesce("plaintiff", F.lit("None")), F.lit("; Defendant: "), F.coalesce("defendant", F.lit("None")))
    return to_feed(s, source=F.col("source"), source_id=F.col("case_number"), county=F.col("county"), parcel_id=F.col("parcel_id"), event_type=F.lit("sheriff_sale"), event_date=F.col("sale_date"), event_value=F.col("sale_amount"), severity=F.lit("high"), title=F.concat(F.lit("Sheriff sale: "), _said(F.col("property_address"), "unknown address")), description=F.when(known, parties), raw=F.col("raw"), observed_at=F.col("observed_at"))


def building_events(b: DataFrame) -> DataFrame:
    """Registered vacant buildings: condemned before boarded before listed; a condemned one has the day it was condemned."""
    condemned, boarded, entered = F.coalesce("condemned", F.lit(False)), F.coalesce("boarded", F.lit(False)), F.col("date_entered")
    by = lambda a, b, c: F.when(condemned, a).when(boarded, b).otherwise(c)
    return to_feed(b, source=F.col("source"), source_id=F.col("registration_number"), county=F.col("county"), parcel_id=F.col("parcel_id"), event_type=by("condemned_building", "boarded_building", "vbr_listing"), event_subtype=F.col("registry_type"), event_date=F.when(condemned, F.coalesce("condemned_date", entered)).otherwise(entered), event_value=F.col("annual_fee"), severity=by("critical", "high", "medium"), title=by("Condemned building", "Boarded building", F.concat(F.lit("Vacant building registry: "), _said(F.col("registry_type"), "registered"))), raw=F.col("raw"), observed_at=F.col("observed_at"))


def probate_events(p: DataFrame) -> DataFrame:
    """Estates that are linked to a parcel; the others are no events."""
    died = F.coalesce(F.concat(F.lit(", died "), F.date_format("date_of_death", "yyyy-MM-dd")), F.lit(""))
    linked = p.filter(F.coalesce("parcel_id", F.lit("")) != "")
    return to_feed(linked, source=F.col("source"), source_id=F.col("case_number"), county=F.col("county"), parcel_id=F.col("parcel_id"), event_type=F.lit("probate_filing"), event_subtype=F.col("case_type"), event_date=F.col("filing_date"), severity=F.lit("medium"), title=F.concat(F.lit("Probate: estate of "), _said(F.col("decedent_name"), "unknown")), description=F.concat(_said(F.col("case_type"), "Probate case"), died), raw=F.col("raw"), observed_at=F.col("observed_at"))


def forfeit_events(f: DataFrame, dated_by_sight: bool = False) -> DataFrame:
    """Forfeited parcels (pre_2024: before the forced sales). ``dated_by_sight``: an undated one has the day it was seen."""
    early = F.coalesce("pre_2024", F.lit(False))
    day = F.coalesce("forfeit_date", F.to_date("observed_at")) if dated_by_sight else F.col("forfeit_date")
    title = F.concat(F.lit("Tax-forfeit property — "), F.col("county_name"), F.when(early, " (pre-2024 forfeiture — forced liquidation window)").otherwise(""))
    return to_feed(f, source=F.col("source"), county=F.col("county"), parcel_id=F.col("parcel_id"), event_type=F.lit("tax_forfeit"), event_date=day, event_value=F.col("minimum_bid"), severity=F.when(early, "critical").otherwise("high"), title=title, raw=F.col("raw"), observed_at=F.col("observed_at"))


def sheriff_severity(redemption: Column, as_of: Column) -> Column:
    """Open windows are high, closed ones low, unknown ones medium."""
    return F.when(redemption >= as_of, "high").when(redemption < as_of, "low").otherwise("medium")


def vacancy_severity(condemned: Column, boarded: Column) -> Column:
    return F.when(condemned.isNotNull(), "critical").when(boarded.isNotNull(), "high").otherwise("medium")


def forfeit_severity(forfeited: Column) -> Column:
    return F.when(forfeited < F.lit("2024-01-01").cast("date"), "critical").otherwise("high")


def delinquent_severity(years: Column) -> Column:
    return F.when(years >= 3, "high").when(years >= 1, "medium").otherwise("low")


def assessment_signal(amount: Column, absentee: Column, residential: Column) -> Column:
    """Severity of a special assessment; null if it is no signal."""
    return F.when((amount >= 2_000) & absentee & residential, F.when(amount >= 10_000, "high").when(amount >= 5_000, "medium").otherwise("low"))


def tax_roll_kind(forfeit_flag: Column, year: Column) -> Column:
    """A forfeit flag wins over a delinquency year."""
    return F.when(F.upper(forfeit_flag) == "T", "tax_forfeit").when(year.isNotNull(), "tax_delinquent")


def parcel_precedence(*found: Column) -> Column:
    """The first identifier that there is: own id, tax number, address match, stub."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in found])


def vacancy_rate(vacant: Column, total: Column) -> Column:
    """Share between 0 and 1; no addresses is no vacancy."""
    return F.least(F.coalesce(F.try_divide(vacant, F.nullif(total, F.lit(0))), F.lit(0.0)), F.lit(1.0))


def promotable(parcel: Column, expiry: Column, amount: Column, status: Column) -> Column:
    """A staged notice with all its facts that no review turned down."""
    return parcel.isNotNull() & expiry.isNotNull() & amount.isNotNull() & ~F.coalesce(status, F.lit("")).isin("not_a_parcel", "rejected")


def promotion(notices: DataFrame, pids: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, sales, stub parcels) of extracted notices (county, notice_id, sale_date, amount, months).

    A notice over several parcels becomes a row for each, with the id ``notice#digits`` and
    no amount, as the one amount covers all; a notice without a number has a stub parcel.
    """
    split = notices.withColumn("__n", F.size(pids)).select("*", F.posexplode_outer(pids).alias("__pos", "__pid"))
    digits = F.regexp_replace("__pid", r"[^0-9]", "")
    several = F.col("__n") > 1
    stub = F.concat(F.upper(F.col("county")), F.lit("-FC-"), F.col("notice_id"))
    rows = split.withColumns(
        {
            "__key": F.when(several, F.concat_ws("#", "notice_id", digits)).otherwise(F.col("notice_id")),
            "__parcel": F.coalesce(F.nullif(digits, F.lit("")), stub),
            "__amount": F.when(~several | F.col("__pid").isNull(), F.col("amount")),
        }
    )
    events = to_feed(rows, source=F.lit("mnpublicnotice"), source_id=F.col("__key"), county=F.col("county"), parcel_id=F.col("__parcel"), event_type=F.lit("sheriff_sale"), event_subtype=F.lit("foreclosure_notice"), event_date=F.col("sale_date"), event_value=F.col("__amount"), severity=F.lit("high"))
    sales = rows.select("county", F.col("__parcel").alias("parcel_id"), "sale_date", F.col("__amount").alias("amount"), F.col("months").alias("redemption_period_months"), F.lit("scheduled").alias("sale_status"))
    stubs = rows.filter(F.col("__pid").isNull()).select("county", F.col("__parcel").alias("parcel_id"))
    return events, sales, stubs
