"""The property list: filters, sorts, pages, saved searches and access tiers, all as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.ids import county_slug
from groundwork.operators.aggregate import category_of
from groundwork.operators.derive import equity_band
from groundwork.operators.resolve import best_per_key

# Members of each category, (source, event type or None for any).
CATEGORIES: dict[str, list[tuple[str, str | None]]] = {
    "foreclosure": [(s, None) for s in ("anoka_sheriff", "dakota_sheriff", "hennepin_sheriff", "ramsey_sheriff", "washington_sheriff", "scott_sheriff", "carver_sheriff", "startribune_legal", "postbulletin_legal", "fillmore_legal", "mnpublicnotice")],
    "tax_forfeit": [("hennepin_tax_roll", "tax_forfeit"), ("ramsey_tax_roll", "tax_forfeit"), ("ramsey_tfl", None), ("mn_dor_red_book", None), ("mnpn_redemption_notice", None)],
    "vacant": [(s, None) for s in ("mpls_vbr", "saint_paul_vacant", "saint_paul_dsi", "mpls_311")],
    "tax_delinquent": [("hennepin_tax_roll", "tax_delinquent"), ("olmsted_delq_list", None), ("ramsey_tax_roll", "tax_delinquent")],
    "tax_assessment": [("ramsey_tax_roll", "tax_assessment")],
    "probate": [("fillmore_probate", None), ("olmsted_probate", None)],
}
# Access tiers.
TIERS = {"free": 0, "basic": 1, "standard": 2, "premium": 3, "admin": 99}
# Columns hidden below a tier.
LEVERAGE = ("owner_portfolio", "overlay", "redemption_outcome", "redemption_outcome_label", "redemption_outcome_ambiguous", "redemption_resale_price", "redemption_resale_date", "deal_math", "vacancy_est_fees_paid", "vacancy_est_pve_exposure", "vacancy_cost_basis")
LOCATORS = ("address", "city", "zip", "owner", "owner_mailing", "tax_parcel_no", "parcel_id", "municipality", "neighborhood", "lat", "lng")
DATES = ("sale_date", "sale_time", "redemption_ends_at", "registered_date")
PARCEL_FACTS = ("lot_sqft", "property_type_name")
VALUES = ("market_value", "amount", "original_principal")
TAX_OWNER = ("owner_name", "owner_name_2", "owner_mailing_address", "owner_mailing_city_state_zip")
# Words for an event type in titles that locate nothing.
LABELS = {
    "sheriff_sale": "Foreclosure (sheriff sale)",
    "foreclosure": "Foreclosure",
    "tax_forfeit": "Tax-forfeit property",
    "tax_delinquent": "Tax-delinquent property",
    "tax_assessment": "Tax assessment",
    "vacant": "Vacant/registered building",
}
# Outcomes of each bucket, and the states that only a tracked sale has.
OUTCOME_BUCKETS = {"redeemed": ("redeemed_by_owner", "redeemed_by_junior"), "reo": ("foreclosed",), "sold": ("foreclosed_sold",)}
TRACKED = ("outcome_pending", "resolved")
OTHER_LABEL = "Distressed property"
LOCKED_TEXT = "Details locked — upgrade to view owner, address, and amounts."
#: Columns that locate nothing, shown at every tier; below standard a column in no list is hidden.
SAFE = ("id", "source", "source_id", "event_type", "event_subtype", "severity", "category", "county", "status", "sale_status", "observed_at", "redemption_state", "redemption_relative", "equity_band", "vacancy_years", "is_redeemed", "days_listed", "tier", "tax_status", "imagery")


def in_category(category: str, compat: bool = False) -> Column:
    """Rows of a category, each member by its own rule.

    ``compat``: a category whose members name just one event type takes that type for
    every member, also for those that name none.
    """
    members = CATEGORIES[category]
    types = {t for _, t in members if t is not None}
    if compat:
        hit = F.col("source").isin(*[s for s, _ in members])
        return hit & (F.col("event_type") == next(iter(types))) if len(types) == 1 else hit
    return F.size(category_of(F.col("source"), F.col("event_type"), {category: members})) > 0


@dataclass(frozen=True)
class Filters:
    """What a page asks for. None means no limit; ranges are inclusive and leave out nulls."""

    category: str | None = None
    compat: bool = False
    source: str | None = None
    county: str | None = None
    observed_since: str | None = None
    status: str | None = None  # active or postponed
    ranges: dict[str, tuple[Any, Any]] = field(default_factory=dict)
    equal: dict[str, Any] = field(default_factory=dict)
    redemption: str | None = None  # in_redemption, expiring_soon, expired or one of TRACKED
    outcome: str | None = None  # a bucket; one that is not known has no rows
    outcomes: tuple[str, ...] = ()
    multi_signal: int | None = None
    absentee: bool | None = None
    redeemed: bool | None = None  # False hides only rows known to be redeemed
    sort: str = "event_date"
    descending: bool = False
    limit: int = 50
    offset: int = 0


#: Sorts by name; every one ends in the id.
SORTS = {
    "event_date": lambda: [F.col("event_date")],
    "year_built": lambda: [F.col("year_built")],
    "sqft": lambda: [F.col("sqft")],
    "emv_total": lambda: [F.col("emv_total")],
    "observed_at": lambda: [F.col("observed_at")],
    "event_value": lambda: [F.col("event_value")],
    "market_value": lambda: [F.col("market_value")],
    "equity": lambda: [F.col("market_value") - F.col("event_value")],
    "redemption_urgency": lambda: [F.when(F.col("days_left") >= 0, 0).when(F.col("days_left") < 0, 1).otherwise(2), F.col("days_left")],
}
#: What the standard tier may not hunt by: every range and exact value, the redemption window, signals and absence.
HUNTING = ("ranges", "equal", "redemption", "multi_signal", "absentee")


def published_window(name: str, as_of: Column) -> Column:
    """Windows by published date in days, or by sale date where none is published."""
    end, sale = F.col("redemption_date"), F.col("event_date")
    left = F.datediff(end, as_of)
    age = F.datediff(as_of, sale)
    rules = {
        "in_redemption": (left > 90, age < 92),
        "expiring_soon": (left.between(0, 90), age.between(92, 182)),
        "expired": (left < 0, age > 182),
    }
    by_end, by_sale = rules[name]
    return F.when(end.isNotNull(), by_end).otherwise(by_sale)


def conditions(f: Filters, as_of: Column) -> list[Column]:
    """One condition for each filter on single rows."""
    out = []
    if f.category:
        out.append(in_category(f.category, f.compat))
    if f.source:
        out.append(F.col("source") == f.source)
    if f.county is not None:
        out.append(F.col("county") == county_slug(F.lit(f.county)))
    if f.observed_since:
        out.append(F.col("observed_at") > F.lit(f.observed_since).cast("timestamp"))
    if f.status:
        out.append(F.lower("status").contains("postpon") if f.status == "postponed" else F.col("status").isNull())
    for name, (low, high) in f.ranges.items():
        out += [F.col(name) >= low] if low is not None else []
        out += [F.col(name) <= high] if high is not None else []
    out += [F.col(name) == value for name, value in f.equal.items()]
    if f.redemption:
        out.append(F.col("redemption_state") == f.redemption if f.redemption in TRACKED else published_window(f.redemption, as_of))
    if f.outcome:
        out.append(F.col("outcome").isin(*OUTCOME_BUCKETS.get(f.outcome, ())))
    if f.outcomes:
        out.append(F.col("outcome").isin(*f.outcomes))
    if f.absentee is not None:
        out.append(F.col("is_absentee") == f.absentee)
    if f.redeemed is not None:
        known = F.coalesce("is_redeemed", F.lit(False))
        out.append(known if f.redeemed else ~known)
    if f.multi_signal:
        out.append(F.col("signal_count") >= f.multi_signal)
    return out


def matching(rows: DataFrame, f: Filters, as_of: Column) -> DataFrame:
    """Every row that the filters keep, in no order; one of each parcel if several signals are asked for."""
    for ok in conditions(f, as_of):
        rows = rows.filter(ok)
    return best_per_key(rows, "parcel_key", [actionability(), F.col("id")]) if f.multi_signal else rows


def with_signals(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """The rows with their parcel's ``signal_count``; null without a parcel or without signals (one row of each parcel)."""
    return rows.join(signals.filter("parcel_key is not null").select("parcel_key", "signal_count"), "parcel_key", "left")


def owners_page(portfolios: DataFrame, least: int = 2, owner_type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Owners of ``least`` parcels or more, those of most parcels first, ties by name."""
    rows = portfolios.filter(F.col("parcel_count") >= least)
    if owner_type:
        rows = rows.filter(F.col("owner_type") == owner_type)
    return rows.orderBy(F.col("parcel_count").desc(), "owner_norm").offset(offset).limit(limit)


def page(rows: DataFrame, f: Filters, as_of: Column) -> DataFrame:
    """One page, nulls last in either direction, ties by id."""
    if not 1 <= f.limit <= 200:
        raise ValueError("limit must be 1 to 200")
    keys = SORTS[f.sort]()
    bucket, keys = (keys[:1], keys[1:]) if f.sort == "redemption_urgency" else ([], keys)
    order = [*[b.asc() for b in bucket], *[k.desc_nulls_last() if f.descending else k.asc_nulls_last() for k in keys], F.col("id").asc()]
    return matching(rows, f, as_of).orderBy(*order).offset(f.offset).limit(f.limit)


def total(rows: DataFrame, f: Filters, as_of: Column) -> DataFrame:
    return matching(rows, f, as_of).agg(F.count(F.lit(1)).alias("total"))


def counts(rows: DataFrame, f: Filters, as_of: Column) -> DataFrame:
    """One row: ``total`` of the filters, and ``redeemed``, how many rows the redeemed filter alone takes out. One pass over the rows."""
    if f.multi_signal:
        raise ValueError("rows are counted, not parcels")
    known = F.coalesce("is_redeemed", F.lit(False))
    kept = F.lit(True) if f.redeemed is None else known if f.redeemed else ~known
    others = matching(rows, replace(f, redeemed=None), as_of)
    return others.agg(F.count_if(kept).alias("total"), F.count_if(~kept).alias("redeemed"))


def actionability() -> Column:
    """Lower is more urgent: 1 foreclosure, 2 forfeited, 3 tax roll, 4 vacant, 9 other."""
    source = F.col("source")
    named = lambda *c: source.isin(*[s for k in c for s, _ in CATEGORIES[k]])
    return (
        F.when(F.col("event_type") == "tax_forfeit", 2)
        .when(named("foreclosure"), 1)
        .when(source.isin("mn_dor_red_book"), 2)
        .when(source == "ramsey_tax_roll", 3)
        .when(named("vacant") & (source != "mpls_311"), 4)
        .otherwise(9)
    )


def allowed(f: Filters, tier: str) -> Filters:
    """What is left of the filters at a tier.

    Standard alone reads full rows and may not hunt: it loses HUNTING and takes the default
    sort, in the direction asked for. Free and basic filter rows whose fields are locked.
    Outcomes are for premium.
    """
    if TIERS.get((tier or "free").lower(), 0) < TIERS["premium"]:
        f = replace(f, outcome=None, outcomes=())
    if (tier or "free").lower() != "standard":
        return f
    plain = Filters()
    return replace(f, **{name: getattr(plain, name) for name in HUNTING}, sort=plain.sort)


#: Columns that a parsed sentence may ask a range or a value of, and the type of their values.
ASKED = {"year_built": int, "sqft": int, "lot_sqft": int, "emv_total": float, "market_value": float, "event_value": float, "num_units": int, "property_type": str, "school_district": str}


def from_words(asked: dict[str, Any]) -> Filters:
    """Filters of a parsed sentence: names, columns and values that are not known or of the wrong type are dropped."""

    def fits(value: Any, kind: type) -> bool:
        return not isinstance(value, bool) and (isinstance(value, kind) or kind is float and isinstance(value, int))

    def some(value: Any) -> dict:
        return value if isinstance(value, dict) else {}

    checks = {
        "category": lambda v: v in CATEGORIES if isinstance(v, str) else False,
        "sort": lambda v: v in SORTS if isinstance(v, str) else False,
        "limit": lambda v: fits(v, int) and 1 <= v <= 200,
        "offset": lambda v: fits(v, int) and v >= 0,
        "multi_signal": lambda v: fits(v, int) and v >= 1,
        "status": lambda v: v in ("active", "postponed"),
        "redemption": lambda v: isinstance(v, str) and v in ("in_redemption", "expiring_soon", "expired", *TRACKED),
        "outcome": lambda v: isinstance(v, str) and v in OUTCOME_BUCKETS,
        **{name: (lambda v: isinstance(v, str) and v.strip() != "") for name in ("county", "source", "observed_since")},
        **{name: (lambda v: isinstance(v, bool)) for name in ("absentee", "redeemed", "descending", "compat")},
    }
    kept = {k: v for k, v in asked.items() if k in checks and checks[k](v)}
    ends = {c: tuple(v) for c, v in some(asked.get("ranges")).items() if c in ASKED and ASKED[c] is not str and isinstance(v, list | tuple) and len(v) == 2}
    ranges = {c: v for c, v in ends.items() if any(x is not None for x in v) and all(x is None or fits(x, ASKED[c]) for x in v)}
    equal = {c: v for c, v in some(asked.get("equal")).items() if c in ASKED and fits(v, ASKED[c])}
    return Filters(**kept, ranges=ranges, equal=equal)


def saved_search_counts(rows: DataFrame, searches: dict[str, Filters], as_of: Column) -> DataFrame:
    """search, n: plain searches are counted in one pass over the rows; each that wants one row of a parcel takes its own."""
    out = rows.sparkSession.createDataFrame([], "search string, n bigint")
    plain = {name: reduce(and_, conditions(f, as_of), F.lit(True)) for name, f in searches.items() if not f.multi_signal}
    if plain:
        counts = rows.agg(*[F.count_if(ok).alias(name) for name, ok in plain.items()])
        pairs = F.array(*[F.struct(F.lit(name).alias("search"), F.col(f"`{name}`").alias("n")) for name in plain])
        out = out.unionByName(counts.select(F.inline(pairs)))
    for name, f in searches.items():
        if f.multi_signal:
            out = out.unionByName(matching(rows, f, as_of).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("search"), "n"))
    return out


def alert_due(cadence: Column, last_sent: Column, now: Column) -> Column:
    """Daily after 20 hours, weekly after 6 days and 20 hours; never sent is due."""
    hours = (F.unix_timestamp(now) - F.unix_timestamp(last_sent)) / 3600
    return F.coalesce(last_sent.isNull() | ((cadence == "daily") & (hours >= 20)) | ((cadence == "weekly") & (hours >= 164)), F.lit(False))


def _label() -> Column:
    known = F.create_map(*[x for pair in LABELS.items() for x in map(F.lit, pair)])
    return F.coalesce(F.element_at(known, F.lower("event_type")), F.lit(OTHER_LABEL))


def redact(rows: DataFrame, tier: str, dense: Column | None = None, shown: tuple[str, ...] = ()) -> DataFrame:
    """The rows as a tier may see them: hidden columns are null and have a ``_locked`` column beside them.

    Coarse cues (equity band, relative redemption) are added first. ``dense`` says whether
    a row's county has enough rows to be named below standard. Below premium ``raw`` is
    hidden and ``tax_status`` loses its owner; below standard ``enrichment`` is hidden,
    ``tax_status`` and ``imagery`` (structs) keep one flag each, title and description
    become texts that locate nothing, and so is every column in no list here or in ``shown``.
    A county that is not named is not named in the title either.
    """
    rank = TIERS.get((tier or "free").lower(), 0)
    if rank >= TIERS["premium"]:
        return rows
    below = rank < TIERS["standard"]
    dense = F.coalesce(dense, F.lit(False)) if dense is not None else F.lit(True)
    have, kinds = rows.columns, dict(rows.dtypes)
    hidden = {*LEVERAGE, "raw"}
    if below:
        hidden |= {*LOCATORS, *DATES, *PARCEL_FACTS, "redemption_days_left", "enrichment"}
        hidden |= set(have) - {*SAFE, *VALUES, "title", "description", *shown}
    if rank < TIERS["basic"]:
        hidden |= set(VALUES)
    band = F.col("equity_band") if "equity_band" in have else equity_band(F.col("market_value")) if "market_value" in have else F.lit(None).cast("string")
    label = _label() if "event_type" in have else F.lit(OTHER_LABEL)
    county = F.when(dense, F.col("county")) if "county" in have else F.lit(None).cast("string")

    def block(c: str, name: str) -> list[Column]:
        """A nested block, cut down; one that is no struct is hidden."""
        if not kinds[c].startswith("struct<"):
            return [F.lit(None).cast(kinds[c]).alias(c), F.lit(True).alias(f"{c}_locked")]
        names = rows.schema[c].dataType.names
        flag = F.col(c).getField(name) if name in names else F.lit(None).cast("boolean")
        if below:
            safe = F.struct((F.coalesce(flag.cast("boolean"), F.lit(False)) if c == "imagery" else flag).alias(name), F.lit(True).alias("locked"))
        elif c == "imagery":
            safe = F.col(c)
        else:
            kept = [(F.lit(None).cast(rows.schema[c].dataType[n].dataType) if n in TAX_OWNER else F.col(c).getField(n)).alias(n) for n in names]
            safe = F.struct(*kept, F.lit(True).alias("owner_locked"))
        return [F.when(F.col(c).isNotNull(), safe).alias(c)]

    out = []
    for c in have:
        if c == "equity_band":
            continue
        if c == "tax_status":
            out += block(c, "redeemed_since_list")
        elif c == "imagery":
            out += block(c, "available")
        elif c == "county" and below:
            out += [county.alias(c), (~dense & F.col(c).isNotNull()).alias("county_locked")]
        elif c == "title" and below:
            out += [F.concat(label, F.coalesce(F.concat(F.lit(" — "), F.nullif(county, F.lit("")), F.lit(" County")), F.lit(""))).alias(c), F.lit(True).alias("title_locked")]
        elif c == "description" and below:
            cue = F.when(dense, band) if rank < TIERS["basic"] else band
            out += [F.concat_ws(" ", F.concat(label, F.lit(".")), F.concat(F.lit("Estimated equity band: "), cue, F.lit(".")), F.lit(LOCKED_TEXT)).alias(c), F.lit(True).alias("description_locked")]
        elif c in hidden:
            out += [F.lit(None).cast(kinds[c]).alias(c), F.lit(True).alias(f"{c}_locked")]
        else:
            out.append(F.col(c))
    if "market_value" in have or "equity_band" in have:
        out += [F.when(dense, band).alias("equity_band"), (~dense).alias("equity_band_locked")] if rank < TIERS["basic"] else [band.alias("equity_band")]
    if "redemption_state" in have and "redemption_relative" not in have:
        state = F.col("redemption_state")
        out.append(F.when(state.isin("expired", "outcome_pending"), "expired").when(state == "expiring_soon", "ending_soon").when(state == "in_redemption", "active").when(state == "resolved", "resolved").alias("redemption_relative"))
    return rows.select(*out)
