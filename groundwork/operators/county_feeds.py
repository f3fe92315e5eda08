"""County sales and rolls as rows of the one event feed. A row that can't be dated or placed by its own facts is left out or has null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import absence, coerce
from groundwork.operators.emit import assessment_signal, delinquent_severity, parcel_precedence, sheriff_severity, tax_roll_kind, to_feed

# Digits of a Washington number, and land-use codes of homes in the Ramsey roll.
WASHINGTON_DIGITS = 13
HOMES = ("510", "511", "495", "505", "515", "520", "521", "530", "531", "540", "541", "545", "546", "550", "551", "552", "553", "570", "573", "574", "575", "576", "578")


def _text(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def _raw(rows: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))


def _parts(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def hennepin_sales(rows: DataFrame, as_of: Column) -> DataFrame:
    """Completed sales by record number: severity by the published end of the window, the resolved parcel or a placeholder."""
    day = coerce.day_as_written(F.col("dateOfSale"))
    ends = coerce.day_as_written(F.col("redemptionExpirationDate"))
    stub = F.concat(F.lit("HENNEPIN-FC-"), F.col("saleRecordNumber"))
    kept = rows.filter(_text("saleRecordNumber").isNotNull())
    return to_feed(
        kept, source=F.lit("hennepin_sheriff"), source_id=F.col("saleRecordNumber"), county=F.lit("hennepin"), parcel_id=parcel_precedence(F.col("resolved_parcel"), stub), event_type=F.lit("sheriff_sale"), event_subtype=F.lit("completed_sale"),
        event_date=day, event_value=coerce.money(F.col("finalBidAmount")), severity=sheriff_severity(ends, as_of), title=_parts(F.lit("Completed sale:"), F.coalesce(_text("address"), F.lit("address unknown"))), raw=_raw(rows), observed_at=F.col("observed_at"),
    )


def anoka_sales(rows: DataFrame, as_of: Column) -> DataFrame:
    """Pending and completed sales: two facts of one parcel and day, so the subtype is in the id; rows without a day are left out."""
    pending = F.lower(F.coalesce("mode", F.lit(""))).contains("pending")
    day = coerce.day(F.when(pending, F.col("scheduled_date")).otherwise(F.coalesce("recorded_date", "scheduled_date")))
    status = F.lower(F.coalesce("status", F.lit("")))
    open_ = (day >= as_of) & ~status.contains("postpon") & ~status.contains("cancel")
    subtype = F.when(pending, "pending_sale").otherwise("completed_sale")
    parcel = parcel_precedence(F.col("gis_pid"), F.col("tax_parcel_no"), F.col("resolved_parcel"), F.concat(F.lit("ANOKA-FC-"), F.col("detail_id")))
    made = rows.withColumns({"__day": day, "__parcel": parcel, "__subtype": subtype, "__raw": _raw(rows)}).filter("__day is not null and __parcel is not null")
    return to_feed(
        made, source=F.lit("anoka_sheriff"), source_id=F.concat_ws("-", "__parcel", F.date_format("__day", "yyyy-MM-dd"), "__subtype"), county=F.lit("anoka"), parcel_id=F.col("__parcel"), event_type=F.lit("sheriff_sale"), event_subtype=F.col("__subtype"),
        event_date=F.col("__day"), event_value=coerce.money(F.col("amount_due")), severity=F.when(~pending, "low").when(open_, "high").otherwise("medium"), title=_parts(F.when(pending, "Scheduled sale:").otherwise("Completed sale:"), F.coalesce(_text("address"), F.lit("address unknown"))), raw=F.col("__raw"), observed_at=F.col("observed_at"),
    )


def dakota_sales(rows: DataFrame, as_of: Column) -> DataFrame:
    """Features of yearly layers: the recent month is high, this year medium, older ones low."""
    severity = F.when(_text("Recent") == "Y", "high").when(F.col("layer_year") >= F.year(as_of), "medium").otherwise("low")
    stub = F.concat_ws("-", F.lit("DAKOTA-FC"), F.col("layer_year"), F.col("OBJECTID"))
    return to_feed(
        rows.filter("OBJECTID is not null"), source=F.lit("dakota_sheriff"), source_id=F.col("OBJECTID"), county=F.lit("dakota"), parcel_id=parcel_precedence(F.col("resolved_parcel"), stub), event_type=F.lit("sheriff_sale"), event_subtype=F.lit("completed_sale"),
        event_date=coerce.day_of_epoch_ms(F.col("SaleDate")), event_value=coerce.money(F.col("SaleAmount")), severity=severity, title=_parts(F.lit("Completed sale:"), F.coalesce(_text("GeoAddress"), F.lit("address unknown")), _text("City")), raw=_raw(rows), observed_at=F.col("observed_at"),
    )


def washington_sales(rows: DataFrame) -> DataFrame:
    """Recorded sales: what they secure is the subtype; a number of other than 13 digits is a document, not a parcel. Two parcels may share a document."""
    pid = F.regexp_replace("pid", r"\s+", "")
    kind = F.upper(F.coalesce("instrument_desc", F.lit("")))
    mortgage = kind.contains("MORTGAGE")
    made = rows.withColumns({"__pid": pid, "__raw": _raw(rows)}).filter(F.coalesce("__pid", F.lit("")) != "")
    return to_feed(
        made, source=F.lit("washington_sheriff"), source_id=F.concat_ws("-", "__pid", "docnum"), county=F.lit("washington"), parcel_id=F.when(F.col("__pid").rlike(f"^[0-9]{{{WASHINGTON_DIGITS}}}$"), F.col("__pid")).otherwise(F.concat(F.lit("WASHINGTON-FC-"), "__pid")),
        event_type=F.lit("sheriff_sale"), event_subtype=F.when(mortgage, "mortgage_foreclosure").when(kind.contains("ASSESSMENT"), "assessment_lien").otherwise("other_lien"), event_date=coerce.day(F.col("sale_date")), event_value=coerce.money(F.col("sale_amount")),
        severity=F.when(mortgage, "medium").otherwise("low"), title=_parts(F.lit("Completed sale"), F.concat(F.lit("of "), _text("owner"))), raw=F.col("__raw"), observed_at=F.col("observed_at"),
    )


def tax_roll_events(parcels: DataFrame, as_of: Column) -> DataFrame:
    """Forfeited and delinquent parcels of a roll (forfeit_flag, delq_year): forfeit wins. The roll has no balance and no bid, so no value."""
    year = coerce.full_year(F.col("delq_year"), as_of)
    kind = tax_roll_kind(F.col("forfeit_flag"), _text("delq_year"))
    forfeit = kind == "tax_forfeit"
    made = parcels.withColumns({"__kind": kind, "__year": F.when(~forfeit, year), "__raw": _raw(parcels)}).filter("__kind is not null and parcel_id is not null")
    forfeit = F.col("__kind") == "tax_forfeit"
    late = F.year(as_of) - F.col("__year")
    return to_feed(
        made, source=F.lit("hennepin_tax_roll"), source_id=F.col("parcel_id"), county=F.col("county"), parcel_id=F.col("parcel_id"), event_type=F.col("__kind"), event_subtype=F.when(forfeit, "state_forfeited_land").otherwise("property_tax_delinquent"),
        event_date=F.make_date("__year", F.lit(1), F.lit(1)), severity=F.when(forfeit, "medium").otherwise(delinquent_severity(F.coalesce(late, F.lit(0)))), title=F.when(forfeit, "Forfeited to the state").otherwise(F.concat(F.lit("Taxes unpaid since "), F.coalesce(F.col("__year").cast("string"), F.lit("an unknown year")))), raw=F.col("__raw"), observed_at=F.col("observed_at"),
    )


def assessment_events(parcels: DataFrame) -> DataFrame:
    """Large special assessments of homes whose owner is elsewhere; undated, as the roll has no day."""
    amount = coerce.money(F.col("assessment"))
    said = assessment_signal(amount, absence.by_mailing(F.col("site"), F.col("mailing")), _text("land_use").isin(*HOMES))
    made = parcels.withColumns({"__amount": amount, "__severity": said, "__raw": _raw(parcels)}).filter("__severity is not null and parcel_id is not null")
    return to_feed(
        made, source=F.lit("ramsey_tax_roll"), source_id=F.col("parcel_id"), county=F.col("county"), parcel_id=F.col("parcel_id"), event_type=F.lit("tax_assessment"), event_subtype=F.lit("special_assessment_burden"), event_value=F.col("__amount"), severity=F.col("__severity"),
        title=F.concat(F.lit("Special assessment of $"), F.format_number("__amount", 0)), raw=F.col("__raw"), observed_at=F.col("observed_at"),
    )


def redemption_notices(staged: DataFrame, feed: DataFrame, good: Column) -> DataFrame:
    """Staged notices that pass the gate ``good`` and are not in the feed yet, dated by the end of the window."""
    made = staged.filter(F.coalesce(good, F.lit(False)))
    there = feed.filter("source = 'mnpn_redemption_notice'").select("county", "parcel_id", F.col("event_date").alias("expiry"))
    fresh = made.join(there, ["county", "parcel_id", "expiry"], "left_anti")
    return to_feed(fresh, source=F.lit("mnpn_redemption_notice"), source_id=F.col("notice_id"), county=F.col("county"), parcel_id=F.col("parcel_id"), event_type=F.lit("tax_forfeiture_redemption"), event_subtype=F.lit("expiration_of_redemption"), event_date=F.col("expiry"), event_value=F.col("amount"), severity=F.lit("high"), title=F.lit("Right of redemption ends"), observed_at=F.col("observed_at"))
