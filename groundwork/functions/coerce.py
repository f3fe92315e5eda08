"""Values as publishers write them: numbers, money, dates, times, sentinels. What can't be read is null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of "nothing here".
SENTINELS = ("", "n/a", "na", "none", "null", "unknown", "-", "--")


def clean(text: Column) -> Column:
    """Trimmed text; blanks and sentinels are null."""
    t = F.trim(text)
    return F.when(~F.lower(t).isin(*SENTINELS), t)


def whole(text: Column) -> Column:
    return F.expr("null").cast("long") if text is None else clean(text.cast("string")).try_cast("double").cast("long")


def money(text: Column) -> Column:
    """'$1,234.50', '$.00' and '(12.00)' as decimal(18,2); brackets are a minus."""
    t = clean(text)
    negative = t.startswith("(") | t.startswith("-")
    value = F.regexp_replace(t, r"[^0-9.]", "").try_cast("decimal(18,2)")
    return F.when(negative, -value).otherwise(value).cast("decimal(18,2)")


def positive(value: Column) -> Column:
    """Zero and less mean that the publisher has no value."""
    return F.when(value > 0, value)


#: Patterns that publishers use, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "dd-MMM-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyyMMdd")


def day(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    t = F.trim(text)
    return F.coalesce(*[F.try_to_date(t, f) for f in formats])


def day_short_year(text: Column) -> Column:
    """'22-APR-26' is 2026-04-22: two-digit years belong to this century."""
    t = F.initcap(F.lower(F.trim(text)))
    return F.try_to_date(F.regexp_replace(t, r"^([0-9]{1,2}-[A-Za-z]{3}-)([0-9]{2})$", "$120$2"), "d-MMM-yyyy")


def day_of_epoch_ms(ms: Column) -> Column:
    """Zero and less are placeholders."""
    return F.when(ms > 0, F.to_date(F.timestamp_millis(ms.cast("long"))))


def day_as_written(text: Column) -> Column:
    """The first ten signs: a date that no time zone may shift."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def clock(text: Column) -> Column:
    """'1:05 PM' is 13:05:00; null if it is no time of day. What follows the time is not read."""
    words = F.split(F.trim(F.regexp_replace(F.upper(text), r"([AP]M)", " $1 ")), r"\s+")
    with_half = F.concat_ws(" ", F.get(words, 0), F.when(F.get(words, 1).isin("AM", "PM"), F.get(words, 1)))
    read = F.coalesce(F.try_to_timestamp(with_half, F.lit("h:mm a")), F.try_to_timestamp(F.get(words, 0), F.lit("H:mm")))
    return F.date_format(read, "HH:mm:ss")


def full_year(two_digits: Column, as_of: Column) -> Column:
    """A year of two digits is the latest one that is not in the future."""
    y = two_digits.cast("int") + 2000
    return F.when(y > F.year(as_of), y - 100).otherwise(y)


def plausible_year(year: Column, as_of: Column, first: int = 1800) -> Column:
    return F.when((year >= first) & (year <= F.year(as_of) + 1), year)


def square_feet(acres: Column, most_acres: float = 49_000) -> Column:
    """43,560 square feet an acre; beyond the cap the figure is an error."""
    return F.when((acres > 0) & (acres <= most_acres), acres * 43_560)


def dropped_share(message: Column) -> Column:
    """'12 of 1,300 rows dropped' as a share; null without such a pair or of zero rows."""
    part = lambda k: F.regexp_replace(F.regexp_extract(message, r"([0-9][0-9,]*)\s+of\s+([0-9][0-9,]*)", k), ",", "").try_cast("double")
    return F.try_divide(part(1), part(2))
